import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagelore.llm import pagelines as P
from pagelore.llm import residue as R

SCHEMA = "key long, page long, url string, text string, site string, slots int"


def says(line):
    return bool(R.messages(P.bare(P.read(pa.array([line]), [""]).text))[0][0])


@pytest.mark.parametrize("line", ["404 Not Found", "Tarvok: This site requires scripts.", "Seite nicht gefunden [ref tarvok]", "이 페이지를 보려면 자바스크립트를 켜 주세요.", "Dolor sit amet lorem, tempor incididunt.", "Your headline goes here", "HTTP 503", "Traceback (most recent call last):"])
def test_messages_are_worded(line):
    assert says(line)


@pytest.mark.parametrize("line", ["Found an error? Tell us", "Photos are for illustration only.", "Status", "© 2024 Acme Ltd.", "Report a problem with Tarvok", "Sample prices from 2024", "The access denied counter of Tarvok goes up by one."])
def test_explanations_and_notices_are_not(line):
    assert not says(line)


def test_template_hashes():
    t = R.Templates(np.array([5, 6, 7, 5, 9, 7]), np.array([0, 3, 6]))
    a, b = t.hashes()
    m = t.masked(1)
    assert a != b and m[1] == m[4] and len({*m[:3].tolist(), m[3], m[5]}) == 5
    assert m[1] == R.Templates(np.array([5, 1, 7]), np.array([0, 3])).hashes()[0]


@pytest.mark.parametrize("value,bad", [("2026-01-02T03:04:05Z", False), (" 2026-01-02 03:04:05+09:00", False), ("2026-01-02t03:04:05.5z", False), ("1771118122", False), ("2026-01-02", False), ("2026-01-02T${t}", True), ("TBD", True), ("", True), ("NaN-NaN", True), (None, False), ("2026-13-02T03:04:05Z", True)])
def test_times(spark, value, bad):
    assert spark.createDataFrame([(value,)], "v string").select(R.not_a_time(F.col("v")).alias("x")).first().x is bad


def test_pages_and_blocks(spark):
    url = "https://www.acme.example/docs/%s.html?v=2"
    names = ["tarvok", "melquin", "sorbane", "pelvrit"]
    pages, blocks = [], []
    for i, n in enumerate(names):
        say = f"{n.capitalize()} keeps every block for {i} days unless a hold is placed on it."
        pages.append((i, i, url % n, f"Home\n{say}\nThe page said {{{{ name }}}} once. – {n}"))
        pages.append((10 + i, i, url % n, "Home\nThe lights went out, sorry."))
        pages.append((20 + i, i, url % n, f"Home\nHello {{{{ v{i} }}}}, meet ${{who}} ({n})"))
        pages.append((30 + i, i, url % n, f"Templates in {n.capitalize()} write {{{{ name }}}} and escape it by default."))
        blocks += [(100 + i, i, url % n, "The lights went out, sorry."), (110 + i, i, url % n, say), (120 + i, i, url % n, f"Use [brackets] in {n.capitalize()} for optional words."), (130 + i, i, url % n, "Home")]
    pages += [(90, 9, None, None), (91, 9, None, ""), (92, None, url % "tarvok", "x" * 100_000), (93, 9, url % "tarvok", "Home")]
    mk = lambda rows: spark.createDataFrame([(*r, "acme", 0) for r in rows + rows[:5]], SCHEMA)
    got = sorted(map(tuple, R.find_residue(mk(pages), mk(blocks)).collect()))
    want = [("visible_text", k + i) for k in (10, 20) for i in range(4)] + [("block_text", 100 + i) for i in range(4)]
    assert got == sorted(want)
    none = spark.createDataFrame([], SCHEMA)
    assert R.find_residue(none, none).count() == 0


@pytest.mark.parametrize("slug", ["%s", "a/id7700%s", "x"])
def test_slots_are_induced_by_alignment_whatever_the_address(spark, slug):
    fills = ["Anna", "Berta", "Clara", "Dora", "", "FIRSTNAME", "~name~", ":first_name:", "{{" + "x" * 120 + "}}", "{{name}}", "user_name"]
    letters = [(i, i, f"https://www.acme.example/{slug % i if '%' in slug else slug}", f"Dear {f}, thank you for your order", "", 0) for i, f in enumerate(fills)]
    names = ["Tarvok", "Melquin", "Sorbane", "Pelvrit"]
    good = [(50 + i, 50 + i, f"https://www.acme.example/a/id7701{i}", f"Home\n{n} keeps every block for {i} days unless a hold is placed on it.\nAll rights reserved.", "", 0) for i, n in enumerate(names)]
    df = spark.createDataFrame(letters + good, SCHEMA)
    got = {(r.field, r.row_key) for r in R.find_residue(df, df).collect()}
    assert got == {(f, i) for f in ("visible_text", "block_text") for i in range(4, len(fills))}


@pytest.mark.parametrize(
    "line",
    ["Dear %s, thank you for your order " + " ".join(f"and part {chr(97 + i % 26)}x" for i in range(14)), "Dear %s, thank you for your order" + " of one more thing" * 1500, "Hello,%s,welcome", "Where an internal server error appears for %s nobody has to write to the people who keep it running."],
    ids=["of 49 words", "of 6007 words", "without blanks", "with a wording"],
)
def test_lines_of_any_length_and_wording_fill_a_slot(spark, line):
    fills = ["Anna", "Berta", "Clara", "Dora", "user_name"]
    df = spark.createDataFrame([(i, i, f"https://www.acme.example/{i}", line % f, "", 0) for i, f in enumerate(fills)], SCHEMA)
    assert {(r.field, r.row_key) for r in R.find_residue(df, df).collect()} == {("visible_text", 4), ("block_text", 4)}
    few = df.where("key > 1")
    assert R.find_residue(few, few).count() == 0


def test_string_keys(spark):
    df = spark.createDataFrame([("k1", "p1", None, "Hello {{ a }}"), ("k2", "p2", None, "Hello {{ b }}"), ("k3", None, None, "Hello world")], "key string, page string, url string, text string")
    assert {r.row_key for r in R.find_residue(df, df.limit(0)).collect()} == {"k1", "k2"}
