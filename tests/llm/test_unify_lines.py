import random
import unicodedata

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_codepoints import brute

from pagelore.llm import site_lines as L
from pagelore.llm import unify as U


def test_pairs_equal_brute_force(spark):
    rnd = random.Random(4)
    forms = ["Tea time", "Ｔea time", "Tea  time ", "Те​a time", "tea time", "Téa time", "Téa time", "Coffee", "", "​", None]
    rows = [(i, rnd.choice([1, 2, 3, None]), rnd.choice(forms), "x", 0) for i in range(90)] + [(None, 1, "Tea time", "x", 0)]
    # one page holds a third of all rows, most of them the same text
    rows += [(200 + i, 9, "Tea time" if i % 12 else "Ｔea time", "x", 0) for i in range(45)]
    df = spark.createDataFrame(rows + rows[:20], "id long, page long, text string, r1 string, w long")
    got = [tuple(r) for r in U.same_reading_pairs(df, "id", "text", ["page"]).collect()]
    want = {(p, a, b) for a, p, x, *_ in rows for b, q, y, *_ in rows if None not in (a, b, p) and p == q and a < b and x is not None and y is not None and x != y and brute(x) == brute(y)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert U.same_reading_pairs(df.limit(0), "id", "text", ["page"]).count() == 0


def test_unified_column(spark):
    df = spark.createDataFrame([("Ａ b", 1), (None, 2), ("", 3), ("x" * 100_000 + "​", 4)], "text string, unify long")
    got = {r.unify: r.u for r in df.select("unify", U.unify("text").alias("u")).collect()}
    assert got == {1: "A b", 2: None, 3: "", 4: "x" * 100_000}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 6), st.integers(1, 5))
def test_summaries_never_miss(items, capacity, parts):
    """Merged counts plus the error bound are never below the true counts."""
    true = pd.Series(items, dtype="int64").value_counts()
    merged, err = pd.Series(dtype="int64"), 0
    for k in range(parts):
        c, off = L.reduce_summary(pd.Series(items[k::parts], dtype="int64").value_counts(), capacity)
        merged, err = merged.add(c, fill_value=0), err + off
    assert all(merged.get(i, 0) + err >= n for i, n in true.items())


def letters(line):
    return "".join(c for c in brute(line).casefold() if unicodedata.category(c)[0] in "LM")


def rows_of_sites():
    rnd = random.Random(7)
    shared = ["All rights reserved 2024.", "ALL RIGHTS  RESERVED 1999!", "Аll rights reserved", "Share this | print", "Groß", "GROSS", "12 – 34", ""]
    rows = []
    for i in range(260):
        site = rnd.choice(["a.example", "a.example", "b.example", "c.example", None])
        lines = [rnd.choice(shared) for _ in range(rnd.randint(0, 3))] + [f"Own line {rnd.choice('abcdefghij')} {rnd.choice('klmnopqrst')}"]
        rows.append((i, site, rnd.choice([*range(40), None]), "\n".join(rnd.sample(lines, len(lines))) if i % 17 else None, 1, "x"))
    return rows


@pytest.mark.parametrize("capacity", [1, 3, 1000])
def test_repeated_lines_equal_brute_force(spark, capacity):
    rows = rows_of_sites()
    df = spark.createDataFrame(rows + rows[:60], "block long, host string, page long, text string, line_no int, h1 string").repartition(3)
    got = [tuple(r) for r in L.find_repeated(df, "host", "page", "block", "text", capacity=capacity).collect()]
    pages, at = {}, {}
    for k, s, p, t, *_ in rows:
        for i, l in enumerate((t or "").split("\n"), 1):
            if s is not None and t is not None and (x := letters(l)):
                at.setdefault((s, x), set()).add((k, i))
                if p is not None:
                    pages.setdefault((s, x), set()).add(p)
    want = {o for key, ps in pages.items() if len(ps) >= 5 for o in at[key]}
    assert len(got) == len(set(got)) and set(got) == want and want


def test_texts_without_repeated_lines(spark):
    rows = [(i, "a.example", i, f"Own {'abcdefgh'[i]}\nAll rights reserved {i}\nend {'ijklmnop'[i]}", 0) for i in range(8)] + [(90, "a.example", 1, "All rights reserved", 0), (91, "a.example", 1, None, 0), (92, "z.example", 1, "All rights reserved", 0)]
    df = spark.createDataFrame(rows, "id long, host string, page long, text string, __key int").drop("__key")
    got = {r.id: r.clean_text for r in L.without_repeated(df, "host", "page", "id", "text").collect()}
    assert got[0] == "Own a\nend i" and got[90] == "" and got[91] is None and got[92] == "All rights reserved" and len(got) == 11
    assert L.without_repeated(df.limit(0), "host", "page", "id", "text").count() == 0
    assert L.find_repeated(df.where(F.lit(False)), "host", "page", "id", "text").count() == 0
