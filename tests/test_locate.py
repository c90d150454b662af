import json

from pagelore.plans import more_queries as M

COLS = "block_key long, page_id long, capture_id long, ord int, block_kind string, text string, attributes string, dom_path_hint string"


def located(spark, at, *controls):
    """(key, capture, order, kind, text, tag, href, path) of one page."""
    rows = [(k, 1, cap, o, kind, text, json.dumps({n: v for n, v in (("tagName", tag), ("href", href)) if v}), path) for k, cap, o, kind, text, tag, href, path in controls]
    spark.createDataFrame(rows, COLS).write.parquet(f"{at}/snapshot_blocks.parquet")
    return {r.block_key: (r.found_key, r.score) for r in M.l01_locate(spark, str(at)).collect()}


def test_places_of_the_reference(spark, tmp_path):
    menu = "html > body > nav"
    got = located(
        spark, tmp_path,
        (1, 1, 1, "link", "Release notes", "a", "/release", menu), (2, 1, 2, "link", "Contact", "a", "/contact", None), (3, 1, 3, "button", "Open", "button", None, None),
        (4, 1, 4, "link", "Größe", "a", None, "html > body"), (5, 1, 5, "link", "Nowhere", "a", None, None), (6, 1, 6, "link", "Docs and guides", "a", "/docs", menu),
        (7, 1, 7, "link", "Twice", "a", None, menu), (8, 1, 8, "button", "Save", "button", None, "html > body > button"),
        (11, 2, 1, "link", "All  release NOTES", "a", "/release", menu), (12, 2, 2, "link", "Contact", "a", "/elsewhere", None), (13, 2, 3, "link", "Open", "a", None, None),
        (14, 2, 4, "link", "GRÖSSE größe", "a", "/size", "html > body > div.main"), (16, 2, 6, "link", "docs", "a", None, "html > body > nav#top.bar"),
        (17, 2, 7, "link", "twice", "a", "/x", None), (18, 2, 8, "link", "Twice", "a", "/y", menu), (19, 2, 9, "button", "save", "button", None, "html > body"),
    )
    # text, target, tag, path and kind: containment 3, another target or tag rules out, paths 6, 5 and 2
    assert got == {1: (11, 3 + 4 + 2 + 6 + 1), 4: (14, 3 + 2 + 2 + 1), 6: (16, 3 + 0 + 2 + 6 + 1), 7: (18, 5 + 2 + 6 + 1), 8: (19, 5 + 2 + 5 + 1)}


def test_texts_are_compared_without_what_a_browser_takes_for_blanks(spark, tmp_path):
    said = ["Open\ufeff", "\ufeffOpen the\u3000page", "Save\x85", "\u00a0\ufeff"]
    old = [(i, 1, i, "button", t, "button", None, None) for i, t in enumerate(["Open", "Open the page", "Save", "None"])]
    got = located(spark, tmp_path, *old, *((10 + i, 2, i, "button", t, "button", None, None) for i, t in enumerate(said)))
    # an equal text, tag and kind; U+0085 is no blank there, so one text holds the other; nothing but blanks is no text
    assert got == {0: (10, 8), 1: (11, 8), 2: (12, 6)}
