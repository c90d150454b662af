"""Page boilerplate removed by element subtrees that recur over the pages of a host.

An element's subtree is named by the letters of the text lines it holds, whatever its tags, so an element of a page's html
and a block made from it have the same hash. Subtrees are hashed bottom-up from their lines, counted over the pages of their
host (and, with the site's own name masked, over hosts), and those that recur are deleted with all their lines.

What does not recur is body, unless it points elsewhere: lines that name another page, or that follow a template which
mostly stands with other pages' names. Which words name a page is read off the places that name it (title, headings,
address) by how few pages share them there; a page that has no such word loses nothing but that last test.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm import codepoints as C
from pagelore.llm import pagelines as P
from pagelore.llm import residue as R
from pagelore.session import cut
from pagelore.sources.html import compile_blocks, element_lines

#: A subtree recurs on a host if it stands on at least MIN_PAGES of its pages and on SHARE of them (a tenth of that if it holds
#: several lines), or if it stands on MIN_SITES hosts and one of them repeats it. A sentence on fewer than MIN_PAGES pages in all is a page's own.
MIN_PAGES, SHARE, MIN_SITES = 3, 0.002, 3
#: A word names a page if at most so many pages have it in a naming place, and at most so many others, or that share of all, mention it.
NAMED_PAGES, MENTIONS, MENTION_SHARE = 3, 3, 0.05
#: Longer lines are no teasers, whatever they name.
TEASER_WORDS = 24
# --- fixed values -------------------------------------------------------------------------------------------------
CONTROLS = {"button", "input", "form"}
TITLE = {"metadata"}
CHROME_ZONES = {"nav", "footer", "header"}
# --- end of fixed values ------------------------------------------------------------------------------------------
LINE, CONTROL, HEAD = range(3)
_SCRIPT = re.compile(R.SCRIPT + "|^loading ")
_MAYBE_CRUMBS = r"\S\s[>›»]\s\S"
#: The mark of a page's own name in a line's words.
OWN = int(P.word_hash(["ownsubject"])[0])
_MIX = np.uint64(0x9E3779B97F4A7C15)


def subtree(leaves: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of the subtrees that hold the lines first..last: a line's own if there is one, else of all lines' together."""
    with np.errstate(over="ignore"):
        s = np.concatenate([np.zeros(1, np.uint64), np.cumsum(C._mix(leaves.view(np.uint64) ^ _MIX), dtype=np.uint64)])
        many = C._mix(s[last] - s[first] + (last - first).astype(np.uint64) * _MIX).view(np.int64)
    if not len(leaves):
        return many
    return np.where(last - first == 1, leaves[np.minimum(first, len(leaves) - 1)], many)


def page_elements(pages: DataFrame) -> DataFrame:
    """site, page, capture, h and leaves of every element of the html of `pages` (capture, site, page, html): its subtree's hash
    and, if it holds several lines, theirs. Null and empty html have none."""
    src = pages.select("capture", F.xxhash64("site").alias("site"), "page", "site", "html").toDF("capture", "site", "page", "name", "html").where("html <> '' and name is not null")
    t = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            brands = [P.brand_of(s) for s in b.column(3).to_pylist()]
            texts, spans, n_lines, own = [], [], [], []
            for h in b.column(4).to_pylist():
                lines, links, sp = element_lines(h)
                texts.append("\n".join(lines + links))
                spans.append(sp)
                n_lines.append(len(lines))
                own.append(len(lines) + len(links))
            # lines and links are squeezed, so each is one line of its text
            x = P.read(pa.array(texts, pa.string()), brands)
            leaf = P.letters(x.text)[0][x.which]
            start = np.concatenate([[0], np.cumsum(np.maximum(own, 1))])
            n_span = np.array([len(s) for s in spans])
            row = np.repeat(np.arange(len(spans)), n_span)
            pairs = np.array([p for s in spans for p in s], np.int64).reshape(-1, 2) + start[row][:, None]
            h = subtree(leaf, pairs[:, 0], pairs[:, 1])
            size = np.where(pairs[:, 1] - pairs[:, 0] > 1, pairs[:, 1] - pairs[:, 0], 0)
            ends = np.concatenate([[0], np.cumsum(size)])
            flat = leaf[np.repeat(pairs[:, 0] - ends[:-1], size) + np.arange(ends[-1])]
            # each line on its own is an element too, be it of its element's several or a link
            alone = np.flatnonzero(np.array(own)[x.row] > 0)
            rows = np.concatenate([row, x.row[alone]])
            at = pa.array(rows)
            leaves = pa.ListArray.from_arrays(pa.array(np.concatenate([ends, np.full(len(alone), ends[-1])]).astype(np.int32)), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(np.concatenate([h, leaf[alone]])), leaves], names=["capture", "site", "page", "h", "leaves"])

    return src.mapInArrow(run, f"capture {t['capture']}, site long, page {t['page']}, h long, leaves array<long>")


def block_lines(blocks: DataFrame) -> DataFrame:
    """The lines of `blocks` (key, capture, site, page, kind, zone, text): hash of the letters, what the line is, and, of lines of at
    most TEASER_WORDS blanks, the hashes of its words. Form controls and titles are told by `cls`. Null texts have no lines."""
    src = blocks.select("key", "capture", "page", F.xxhash64("site").alias("s"), "site", "kind", "zone", "text").toDF("key", "capture", "page", "site", "name", "kind", "zone", "text").where("text is not null")
    t = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    schema = f"key {t['key']}, capture {t['capture']}, page {t['page']}, site long, line_no int, cls int, naming boolean, sentence boolean, message boolean, script boolean, zoned boolean, crumbs boolean, h long, toks array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            sites, kinds, zones = (b.column(i).to_pylist() for i in (4, 5, 6))
            x = P.read(b.column(7), [P.brand_of(s) for s in sites])
            bare = P.bare(x.text)
            h, weight = P.letters(bare)
            sentence = P.stops(x.text) & (weight >= P.SENTENCE_LETTERS)
            message, script = R.messages(bare)
            message[list(x.slots)] = True
            short = pc.less(pc.count_substring(bare, " "), TEASER_WORDS)
            flat, ends = P.words(pc.if_else(short, bare, ""))
            crumbs, branded = np.zeros(len(bare), bool), np.zeros(len(bare), bool)
            for i in np.flatnonzero(P.hits(bare, _MAYBE_CRUMBS)).tolist():
                crumbs[i] = bool(P.CRUMBS.match(bare[i].as_py()))
                branded[i] = crumbs[i] and P.BRAND in bare[i].as_py()
            # from distinct lines to the lines of the rows
            filled, w = P.filled(bare), x.which
            cls = np.array([CONTROL if k in CONTROLS else HEAD if k in TITLE else LINE for k in kinds], np.int32)[x.row]
            naming = np.array([k in TITLE or k == "heading" for k in kinds], bool)[x.row]
            zoned = np.array([z in CHROME_ZONES for z in zones], bool)[x.row] | branded[w]
            keep = np.flatnonzero(filled[w] | (cls != LINE))
            sentence, message, script, crumbs, h = ((sentence & ~message)[w], message[w], script[w], crumbs[w], h[w])
            toks = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)).take(pa.array(w[keep]))
            at = pa.array(x.row[keep])
            flags = [pa.array(v[keep]) for v in (cls, naming, sentence & ~message, message, script, zoned, crumbs)]
            yield pa.RecordBatch.from_arrays([*(b.column(i).take(at) for i in range(4)), pa.array(x.no[keep].astype(np.int32)), *flags, pa.array(h[keep]), toks], names=names)

    return src.mapInArrow(run, schema)


def address_names(blocks: DataFrame) -> DataFrame:
    """page and the hash of each word of its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ws = [P.address_words(u) for u in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(ws)), [len(w) for w in ws])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(P.word_hash([w for v in ws for w in v]))], names=["page", "name"])

    src = blocks.select("page", "url").where("url is not null").distinct()
    return src.mapInArrow(run, f"page {src.schema['page'].dataType.simpleString()}, name long")


def page_names(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page, name): the words that name a page, by its title, its address or several of its headings, and hardly any other page."""
    said = lines.where("naming").select("page", "cls", "h", F.explode(F.array_distinct("toks")).alias("name")).groupBy("page", "name")
    said = said.agg(F.max("cls").alias("cls"), F.min("h").alias("a"), F.max("h").alias("b")).where((F.col("cls") == HEAD) | (F.col("a") != F.col("b")))
    all_ = said.select("page", "name").union(address_names(blocks)).where(F.col("page").isNotNull()).distinct()
    few = all_.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") <= NAMED_PAGES)
    return all_.join(few, "name", "left_semi")


def recurring(elements: DataFrame, min_pages: int, share: float, min_sites: int) -> tuple[DataFrame, DataFrame]:
    """(site, h) of the lines that recurring subtrees of a host hold, and h of the lines on `min_sites` hosts that one of them repeats; elements are (site,
    page, h, leaves)."""
    e = elements.where("page is not null")
    per = cut(e.select("site", "page", "h").distinct().groupBy("site", "h").agg(F.count("*").alias("pages")))
    # only hosts that have a recurring subtree need their size
    some = per.where(F.col("pages") >= min_pages)
    size = e.select("site", "page").distinct().groupBy("site").agg(F.count("*").alias("n"))
    often = cut(some.join(size, "site").where(F.col("pages") >= share / 10 * F.col("n")).withColumn("single", F.col("pages") >= share * F.col("n")).select("site", "h", "single"))
    held = e.where(F.size("leaves") > 1).join(often.select("site", "h"), ["site", "h"], "left_semi").select("site", F.explode("leaves").alias("h"))
    here = often.where("single").select("site", "h").union(held.distinct()).distinct()
    wide = per.groupBy("h").agg(F.count("*").alias("sites"), F.max("pages").alias("most")).where((F.col("sites") >= min_sites) & (F.col("most") > 1)).select("h")
    return here, wide


def boilerplate(blocks: DataFrame, pages: DataFrame | None = None, min_pages: int = MIN_PAGES, share: float = SHARE, min_sites: int = MIN_SITES) -> DataFrame:
    """key of every block that does not belong to the main body of its page.

    `blocks` are (key, capture, site, page, kind, zone, url, text), `pages` (capture, site, page, html) the captures they come
    from; keys of any type. A block goes if each of its lines goes. Form controls go; the title stays. A line goes if a
    subtree that holds it recurs, counted over captures with a sentence of their own or about
    themselves; if it points to another page; if it is a
    path of names, or stands in a navigation, header or footer zone and does not name its page. Messages and unfilled slots
    are what a page without content shows and stay, but a demand for scripts beside anything else goes. Blocks with null or
    blank text are not reported; a block delivered twice is reported once; null sites have no recurring subtrees.
    """
    t = cut(block_lines(blocks))
    mine = t.where("sentence and page is not null")
    said = mine.select("h", "page").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_PAGES).select("h")
    names = cut(page_names(t, blocks))
    mine = mine.where(F.col("cls") == LINE)
    # sentences that stand on several pages are content only of those that they name
    rep = mine.join(said, "h", "left_semi")
    of = rep.select("h", "toks").dropDuplicates(["h"]).select("h", F.explode("toks").alias("name")).join(names, "name").select("h", "page").distinct()
    content = cut(mine.join(said, "h", "left_anti").select("capture").union(rep.join(of, ["h", "page"], "left_semi").select("capture")).distinct())
    line = t.where(F.col("cls") == LINE)
    seen = line.where("site is not null").select("capture", "site", "page", "h", F.array().cast("array<long>").alias("leaves"))
    if pages is not None:
        seen = seen.unionByName(cut(page_elements(pages)))
    here, wide = recurring(seen.join(content, "capture", "left_semi"), min_pages, share, min_sites)
    p = line.join(here.withColumn("here", F.lit(True)), ["site", "h"], "left").join(wide.withColumn("wide", F.lit(True)), "h", "left")
    p = cut(p.withColumn("recurs", F.coalesce("here", "wide", F.lit(False))).drop("here", "wide", "naming"))
    short = F.size("toks") > 0
    one = F.lit(1).cast("long").alias("w")
    # names in each short line that recurrence does not settle, and once in each element that it does
    once = p.where(F.col("recurs") & short).groupBy("h").agg(F.max("toks").alias("toks"), F.count("*").alias("w"))
    open_ = p.where(~F.col("recurs") & short)
    word = open_.select("key", "line_no", "page", F.explode(F.array_distinct("toks")).alias("name"))
    hit = cut(word.join(names.withColumnRenamed("page", "of"), "name").select("key", "line_no", "page", "name", "of"))
    n = names.select("page").distinct().count()
    vague = hit.groupBy("name", "page").agg(F.max(F.col("page") == F.col("of")).alias("own")).where("not own").groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > max(MENTIONS, MENTION_SHARE * n)).select("name")
    hit = hit.join(vague, "name", "left_anti").groupBy("key", "line_no", "name").agg(F.max(F.col("page") == F.col("of")).alias("own"))
    per = hit.groupBy("key", "line_no").agg(F.collect_set(F.when(F.col("own"), F.col("name"))).alias("own"), F.collect_set(F.when(~F.col("own"), F.col("name"))).alias("others"))
    known = names.join(vague, "name", "left_anti").select("name").distinct()
    elsewhere = once.select("h", "w", "toks", F.explode(F.array_distinct("toks")).alias("name")).join(known, "name").groupBy("h").agg(F.max("w").alias("w"), F.max("toks").alias("toks"), F.collect_set("name").alias("others"))
    none = F.array().cast("array<long>")
    masked: Column = F.xxhash64(F.transform("toks", lambda w: F.when(F.array_contains(F.col("marks"), w), F.lit(OWN)).otherwise(w)))
    x = open_.join(per, ["key", "line_no"], "left").withColumns({"own": F.coalesce("own", none), "others": F.coalesce("others", none)})
    x = x.withColumns({"named": F.size("own") > 0, "other": F.size("others") > 0})
    # a sentence about its page may mention others; its template is taken with its own name alone
    x = x.withColumn("marks", F.when(F.col("sentence") & F.col("named"), F.col("own")).otherwise(F.array_union("own", "others"))).withColumn("t", masked)
    x = cut(x.select("key", "capture", "line_no", "sentence", "message", "script", "zoned", "crumbs", "named", "other", "t"))
    told = x.select("t", (F.col("other") & ~(F.col("sentence") & F.col("named"))).alias("other"), one)
    told = told.union(elsewhere.withColumn("marks", F.col("others")).select(masked.alias("t"), F.lit(True).alias("other"), "w"))
    campaign = told.groupBy("t").agg(F.sum(F.when(F.col("other"), F.col("w")).otherwise(0)).alias("x"), F.sum("w").alias("n")).where("x > 0 and 2 * x >= n").select("t", F.lit(True).alias("campaign"))
    x = x.join(campaign, "t", "left").withColumn("campaign", F.coalesce("campaign", F.lit(False)))
    shown = F.col("message") & ~F.col("script")
    named = F.col("named") & ~F.col("crumbs")
    body = F.when(named & F.col("sentence"), ~F.col("campaign")).when(named & ~F.col("message"), ~F.col("other") & ~F.col("campaign"))
    body = body.otherwise(shown | (~F.col("other") & ~F.col("zoned") & ~(F.col("crumbs") & F.col("named")) & ~F.col("script")))
    decided = x.select("key", "capture", "script", body.alias("body"))
    long_ = p.where(~F.col("recurs") & ~short).select("key", "capture", "script", (F.col("sentence") | shown | (~F.col("zoned") & ~F.col("script"))).alias("body"))
    gone = p.where("recurs").select("key", "capture", "script", shown.alias("body"))
    lines = decided.union(long_).union(gone)
    # a demand for scripts is what a page shows that shows nothing else
    demand = p.where("script").select("key", "capture").distinct().join(content, "capture", "left_anti")
    shows = lines.where("body").select("capture").distinct()
    alone = demand.join(shows, "capture", "left_anti").select("key", F.lit(True).alias("body"))
    rest = t.where(F.col("cls") != LINE).select("key", (F.col("cls") != CONTROL).alias("body"))
    return lines.select("key", "body").union(alone).union(rest).groupBy("key").agg(F.max("body").alias("body")).where("not body").select("key")


def main_text(captures: DataFrame, capture: str, page: str, site: str, url: str, html: str, **how) -> DataFrame:
    """`capture` and main_text of each page in html: its elements, compiled in page order, without those `boilerplate` names.

    Pages without html, or without anything but boilerplate, have no row; a capture delivered twice counts once.
    """
    p = captures.select(F.col(capture).alias("c"), F.col(page).alias("p"), F.col(site).alias("s"), F.col(url).alias("u"), F.col(html).alias("h")).dropDuplicates(["c"])
    e = compile_blocks(p.select("c", "u", "h"), "c", "h", "u").select("c", "ord", "kind", "zone", "text")
    e = cut(e.join(p.select("c", "p", "s", "u"), "c").withColumn("key", F.struct("c", "ord")))
    blocks = e.select("key", F.col("c").alias("capture"), F.col("s").alias("site"), F.col("p").alias("page"), "kind", "zone", F.col("u").alias("url"), "text")
    gone = boilerplate(blocks, p.select(F.col("c").alias("capture"), F.col("s").alias("site"), F.col("p").alias("page"), F.col("h").alias("html")), **how)
    kept = e.join(gone, "key", "left_anti").groupBy("c").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("x"))
    return kept.select(F.col("c").alias(capture), F.array_join(F.transform("x", lambda b: b["text"]), "\n").alias("main_text"))
