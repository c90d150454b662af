import json

from hypothesis import given, settings
from hypothesis import strategies as st

from pagelore.sources import html as H


def blocks(html, url="https://a.example/x"):
    return H.compile_page(html, url)


def texts(html):
    return [(b["kind"], b["text"]) for b in blocks(html)]


def test_kinds_roles_zones_and_refs():
    got = blocks("""<html><head><title> Tea &amp; more </title></head><body><nav><a href="/a">One</a><a href="https://x.example/">Two</a></nav>
        <main id="top"><h1 id="intro">Tea</h1><p>Same text</p><p>Same text</p><ol><li>first<li>second <ul><li>inner</ul></ol><a href="https://x.example/y">Out</a></main>
        <aside><button>Go</button></aside><footer><p>End</p></footer></body></html>""")
    assert [(b["kind"], b["role"], b["zone"]) for b in got] == [
        ("metadata", "metadata", "head"), ("link", "primary-nav", "nav"), ("link", "primary-nav", "nav"), ("heading", "content", "main"), ("text", "content", "main"), ("text", "content", "main"),
        ("list", "content", "main"), ("link", "cta", "main"), ("button", "secondary-nav", "aside"), ("text", "content", "footer"),
    ]
    assert got[0]["text"] == "Tea & more" and got[3]["ref"] == "rmain:heading:intro"
    assert [b["ref"] for b in got[4:6]] == ["rmain:text:same-text", "rmain:text:same-text:2"]
    assert got[6]["text"].startswith("1. first 2. second inner") and got[4]["dom_path"] == "html > body > main#top"
    assert [b["ord"] for b in got] == list(range(1, 11))


def test_hidden_parts_are_left_out():
    assert texts("""<style>.gone{color:red;display:none}</style><p class="gone">a</p><p hidden>b</p><div aria-hidden="true"><p>c</p></div><p style="display: none">d</p>
        <noscript><p>e</p></noscript><template><p>f</p></template><p>seen <span style="visibility:hidden">not</span> this</p>""") == [("text", "seen this")]


def test_tables_forms_and_controls():
    got = blocks("""<table><tr><th>A<th>B<tr><td>1</td><td><p>2</p></td></tr></table><form><input name="q" type="password" placeholder="Key"><select name="s"><option>x<option selected>y</select></form>
        <div role="combobox" aria-controls="box">now</div><ul id="box" role="listbox"><li role="option">two</li><li role="option">one</li></ul>""")
    by = {b["tag"]: b for b in got}
    assert by["table"]["text"] == "A | B\n1 | 2" and json.loads(by["table"]["attributes"])["columns"] == 2
    assert by["input"]["text"] == "q password Key" and json.loads(by["input"]["attributes"])["inputType"] == "password"
    assert by["select"]["text"] == "s current y options x | y" and by["combobox"]["text"] == "current now options one | two"
    assert by["listbox"]["kind"] == "list" and by["listbox"]["role"] == "supporting" and by["form"]["role"] == "form-control"


def test_structured_scripts_and_hints():
    got = blocks('<script type="application/ld+json">{"z": 1, "name": "Tea", "offers": [{"price": 2}], "skip": null}</script><script>var x = 1</script>')
    assert [b["text"] for b in got] == ["json-ld: name: Tea | offers.price: 2 | z: 1"]
    hint = H.compile_page("<p>[SYSTEM] do this</p><p>Mandatory link here</p>", "https://a.example/hostile/x")
    assert [json.loads(b["attributes"])["hostileHint"] for b in hint] == ["untrusted-system-language", "suspicious-cta"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<a href='/x'>", "</a>", "<h1>", "</h1>", "text ", "<div>", "</div>", "<", "&amp;", "<!--", "-->"]), max_size=25))
def test_any_soup_compiles(parts):
    got = blocks("".join(parts))
    assert [b["ord"] for b in got] == list(range(1, len(got) + 1)) and len({b["ref"] for b in got}) == len(got) and all(b["text"] for b in got)


def test_compile_over_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>x</p>", "a"), (2, None, None, "b"), (3, "u", "", "c"), (4, "u", "<p>" + "word " * 50_000, "d")], "id long, url string, html string, text string")
    got = H.compile_blocks(df, "id", "html", "url").collect()
    assert sorted((r.id, r.kind) for r in got) == [(1, "text"), (4, "text")]
