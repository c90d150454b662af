import numpy as np
import pytest

from pagelore.llm import mainbody as M

SCHEMA = "key long, capture long, site string, page long, kind string, zone string, url string, text string, content int, h long"


def test_body_of_pages(spark):
    hosts = ["www.acme.example", "borlin.test", "help.corvane.invalid"]
    names = ["tarvok", "melquin", "sorbane", "pelvrit", "dunweld", "harkess"]
    rows, want = [], set()

    def add(page, host, kind, text, body, zone="body", capture=None):
        key = len(rows)
        rows.append((key, page if capture is None else capture, host, page, kind, zone, f"https://{host}/p/{names[page % 6]}{'.html' if page % 2 else ''}", text, 0, 0))
        if not body:
            want.add(key)

    for page in range(18):
        host, n = hosts[page // 6], names[page % 6].capitalize()
        other = names[(page + 1) % 6].capitalize()
        say = f"{n} keeps every block for {page} days unless a hold is placed on it."
        add(page, host, "metadata", f"{n} - {host}", True, "head")
        add(page, host, "list", "- Docs\n- Pricing", False)
        add(page, host, "text", f"{host.split('.')[-2].capitalize()} > Docs > {n}", False)
        add(page, host, "heading", f"{n}: overview", True)
        add(page, host, "heading", f"How {n} works", True)
        add(page, host, "text", say, True)
        add(page, host, "text", " ".join([say] * 5) + "\nThis site uses cookies.", True)
        add(page, host, "link", f"Download {n} {page}.1 for your platform", True)
        add(page, host, "link", f"Next after {n}: {other}", False)
        add(page, host, "text", f"Our {other if page % 6 else n} report is out now, get your copy today.", False)
        add(page, host, "button", f"Edit {n}", False)
        add(page, host, "text", "This site requires scripts.", False)
        add(page, host, "text", "© 2024 All rights reserved", False, "footer")
        add(page, host, "text", None, True)
    add(3, hosts[0], "list", "- Docs\n- Pricing", False, capture=100)
    add(3, hosts[0], "heading", "The lights went out", True, capture=100)
    add(4, hosts[0], "text", "This site requires scripts.", True, capture=101)
    add(5, None, "text", "Somewhere else", True, capture=102)
    add(5, hosts[0], "text", "word " * 60_000, True, capture=103)
    df = spark.createDataFrame(rows + rows[:30], SCHEMA)
    got = [r.key for r in M.boilerplate(df).collect()]
    assert len(got) == len(set(got))
    assert {rows[k][:8] for k in set(got) ^ want} == set()
    assert M.boilerplate(df.limit(0)).count() == 0


def test_main_text_of_html(spark):
    rows = []
    for page in range(8):
        n = ["Tarvok", "Melquin", "Sorbane", "Pelvrit", "Dunweld", "Harkess", "Corvane", "Borlin"][page]
        html = f"<html><head><title>{n} - Acme</title></head><body><nav><a href='/d'>Docs</a></nav><div><h1>{n} limits</h1><p>{n} keeps every block for {page} days unless a hold is placed on it.</p></div><p>All rights reserved.</p></body></html>"
        rows.append((page, page, "www.acme.example", f"https://www.acme.example/{n.lower()}", html, "x"))
    rows += [(50, 50, "www.acme.example", "https://www.acme.example/none", None, "x"), (51, 51, "www.acme.example", "https://www.acme.example/empty", "", "x")]
    df = spark.createDataFrame(rows + rows[:3], "id long, page long, host string, url string, html string, text string")
    got = {r.id: r.main_text for r in M.main_text(df, "id", "page", "host", "url", "html").collect()}
    assert set(got) == set(range(8)) and got[2] == "Sorbane - Acme\nSorbane limits\nSorbane keeps every block for 2 days unless a hold is placed on it."


def test_a_subtree_is_named_by_its_lines():
    leaves = np.array([3, 4, 5, 3, 4], np.int64)
    h = M.subtree(leaves, np.array([0, 3, 0, 2]), np.array([2, 5, 1, 3]))
    assert h[0] == h[1] and h[2] == 3 and h[3] == 5


def host(slug, n=8, names=("Tarvok", "Melquin", "Sorbane", "Pelvrit", "Dunweld", "Harkess", "Corvane", "Borlin")):
    rows, pages = [], []
    for i in range(n):
        say = f"{names[i]} keeps every block for {i} days unless a hold is placed on it."
        url = f"https://www.acme.example/{slug(names[i], i)}"
        chrome = ["Docs | Pricing | Support", "We use cookies. Accept all", "All rights reserved by Acme."]
        for j, t in enumerate([chrome[0], f"How {names[i]} works", say, *chrome[1:]]):
            rows.append((f"{i}/{j}", f"c{i}", "www.acme.example", f"p{i}", "heading" if j == 1 else "text", None, url, t))
        pages.append((f"c{i}", "www.acme.example", f"p{i}", f"<main><ul><li>{chrome[0]}</ul><h1>How {names[i]} works</h1><p>{say}<div><p>{chrome[1]}<p>{chrome[2]}</div></main>"))
    return rows, pages


@pytest.mark.parametrize("slug", [lambda n, i: n.lower(), lambda n, i: n[:3].lower(), lambda n, i: f"a/id7700{i}", lambda n, i: ""])
def test_the_address_does_not_decide(spark, slug):
    rows, pages = host(slug)
    df = spark.createDataFrame(rows, "key string, capture string, site string, page string, kind string, zone string, url string, text string")
    html = spark.createDataFrame(pages, "capture string, site string, page string, html string")
    want = {f"{i}/{j}" for i in range(8) for j in (0, 3, 4)}
    assert {r.key for r in M.boilerplate(df).collect()} == want
    assert {r.key for r in M.boilerplate(df, html).collect()} == want


def test_html_alone_shows_what_recurs(spark):
    """Blocks of two pages, whose host's other pages are only there as html."""
    rows, pages = host(lambda n, i: n.lower())
    df = spark.createDataFrame(rows, "key string, capture string, site string, page string, kind string, zone string, url string, text string")
    html = spark.createDataFrame(pages, "capture string, site string, page string, html string")
    few = df.where("capture in ('c0', 'c1') or key like '%/2'")
    assert {r.key for r in M.boilerplate(few).collect()} == set()
    assert {r.key for r in M.boilerplate(few, html).collect()} == {f"{i}/{j}" for i in (0, 1) for j in (0, 3, 4)}


def test_a_quotation_on_few_pages_of_a_large_host_is_no_template(spark):
    rows = []
    for i in range(2000):
        text = f"Page {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}q says something of its very own here."
        rows += [(f"{i}/0", f"c{i}", "www.acme.example", f"p{i}", "text", None, "", text), (f"{i}/1", f"c{i}", "www.acme.example", f"p{i}", "text", None, "", "All rights reserved.")]
        if i < 3:
            rows.append((f"{i}/2", f"c{i}", "www.acme.example", f"p{i}", "text", None, "", "To be or not to be, that is the question."))
    df = spark.createDataFrame(rows, "key string, capture string, site string, page string, kind string, zone string, url string, text string")
    assert {r.key for r in M.boilerplate(df).collect()} == {f"{i}/1" for i in range(2000)}
