"""Page views: which blocks a reader, an agent or a navigator sees, and how a page's content measures up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import text as T

# --- fixed values -------------------------------------------------------------------------------------------------
KIND_CODES = {"text": "p", "list": "l", "table": "t", "link": "a", "button": "b", "input": "i", "metadata": "m", "form": "f"}
LAYOUT_ZONES = ["main", "nav", "aside", "header", "footer"]
DIGEST_WORDS = 12
# --- end of fixed values ------------------------------------------------------------------------------------------


def attr(path: str) -> Column:
    return F.get_json_object("attributes", f"$.{path}")


def layout_zone() -> Column:
    """The zone a block states, else the first part of its path that names one, else navigation by its role."""
    z = attr("zone")
    parts = F.transform(F.split(F.lower("dom_path_hint"), " > "), lambda p: F.regexp_extract(p, r"^(main|nav|aside|header|footer)\b", 1))
    by_path = F.element_at(F.filter(parts, lambda p: p != ""), 1)
    return F.coalesce(F.when(z.isin(LAYOUT_ZONES), z), F.when(F.size(F.filter(parts, lambda p: p != "")) > 0, by_path), F.when(F.col("role").isin("primary-nav", "secondary-nav"), "nav"))


def salient() -> Column:
    """Short, or with a digit, a price, a percentage or a standard's number."""
    words = F.size(F.filter(F.split(T.squeeze(F.col("text")), " "), lambda w: w != ""))
    return (words <= 10) | F.col("text").rlike("[0-9$%]") | F.lower("text").contains("rfc")


def keep_compact() -> Column:
    k, r = F.col("kind"), F.col("role")
    return (
        F.when(k == "metadata", ~F.col("has_heading")).when(k.isin("heading", "table"), True).when(k == "text", salient())
        .when(k == "list", r.isin("content", "supporting") | salient()).when(k == "link", r.isin("content", "cta") & salient()).when(k == "button", (r == "cta") & salient()).otherwise(False)
    )


def toc_like() -> Column:
    ref, path, text = F.lower("ref"), F.lower(F.coalesce("dom_path_hint", F.lit(""))), F.lower(T.trim_all(F.col("text")))
    return ref.rlike("table-of-contents|:toc") | path.rlike("table-of-contents|#toc|toc\\.") | text.isin("contents", "table of contents") | F.coalesce((F.col("kind") == "link") & attr("href").startswith("#"), F.lit(False))


def keep_reading() -> Column:
    k, r = F.col("kind"), F.col("role")
    body = F.when(k.isin("heading", "table"), True).when(k == "text", salient()).when(k == "list", r.isin("content", "supporting") | salient()).when(k == "link", (r == "content") & salient()).otherwise(False)
    return ~toc_like() & ~(F.col("has_heading") & (k == "metadata")) & body


def keep_navigation() -> Column:
    return F.col("role").isin("primary-nav", "secondary-nav", "cta", "form-control") | F.col("kind").isin("link", "button", "input")


def with_page_flags(blocks: DataFrame) -> DataFrame:
    """Blocks (page, ord, kind, role, ref, text, attributes, dom_path_hint) with what their page has."""
    flags = blocks.groupBy("page").agg(F.max(F.col("kind") == "heading").alias("has_heading"), F.max(F.coalesce(layout_zone() == "main", F.lit(False))).alias("has_main"))
    return blocks.withColumn("text", F.coalesce("text", F.lit(""))).join(flags, "page")


def keep_main() -> Column:
    z = layout_zone()
    return keep_reading() & F.when(F.col("has_main"), F.coalesce(z == "main", F.lit(False))).otherwise(~F.coalesce(z.isin("nav", "aside", "header", "footer"), F.lit(False)))


def compact_line() -> Column:
    """A block as one line: its kind, what identifies it, the start of its text."""
    k = F.col("kind")
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(attr("level").cast("int"), F.lit(1))))
    code = F.when(k == "heading", F.concat(F.lit("h"), level))
    for kind, c in KIND_CODES.items():
        code = code.when(k == kind, c)
    href = F.regexp_extract(F.trim(F.lower(F.regexp_replace(F.trim(attr("href")), "^https?://", "")), F.lit("/")), "^([^/]*)", 1)
    rows, cols = attr("rows"), attr("columns")
    mark = F.when((k == "link") & ~attr("href").startswith("#") & (href != ""), F.concat(F.lit("@"), href)).when(k == "input", F.concat(F.lit("="), attr("inputType")))
    mark = mark.when(k == "table", F.when(rows.isNotNull() & cols.isNotNull(), F.concat(rows, F.lit("x"), cols)).when(rows.isNotNull(), F.concat(F.lit("r"), rows)).when(cols.isNotNull(), F.concat(F.lit("c"), cols)))
    text = T.squeeze(F.col("text"))
    digest = F.when(k.isin("heading", "link", "button", "input"), text).otherwise(F.array_join(F.slice(F.split(text, " "), 1, DIGEST_WORDS), " "))
    return F.concat_ws(" ", code, mark, F.nullif(digest, F.lit("")))


def markdown_line() -> Column:
    k, text = F.col("kind"), T.squeeze(F.col("text"))
    level = F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(attr("level").cast("int"), F.lit(1))))
    return F.when(k == "heading", F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).when(k == "link", F.concat(F.lit("["), text, F.lit("]("), F.coalesce(attr("href"), F.lit("")), F.lit(")"))).when(k == "list", T.trim_all(F.col("text"))).when(k == "table", T.trim_all(F.col("text"))).otherwise(text)


def rendered(kept: DataFrame, line: Column, out: str) -> DataFrame:
    """The lines of a page's kept blocks in page order; a page's blocks are one bounded document."""
    rows = kept.select("page", "ord", line.alias("line"))
    return rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias(out))


def envelope(views: DataFrame, text: str) -> DataFrame:
    t = F.col(text)
    return views.select("page", F.size(F.split(t, "\n")).alias("lines"), F.length(t).alias("chars"), T.token_estimate(t).alias("tokens"))


def diagnostics(blocks: DataFrame) -> DataFrame:
    """What a capture holds, and whether it looks like a page that needs a browser."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    k = F.col("kind")
    d = blocks.withColumn("text", F.coalesce("text", F.lit(""))).groupBy("page").agg(
        F.count("*").alias("blocks"), *[n(k == x).alias(f"{x}s") for x in ("heading", "text", "list", "table", "link", "button", "input")], n(layout_zone() == "main").alias("main_blocks"),
        F.sum(F.when(F.col("role") == "content", F.length("text")).otherwise(0)).alias("content_chars"), n(F.col("role").isin("primary-nav", "secondary-nav")).alias("nav_blocks"),
    )
    shell = (F.col("content_chars") < 200) & (F.col("headings") + F.col("texts") <= 2)
    nav = F.col("nav_blocks") * 2 > F.col("blocks")
    quality = F.when(shell, "poor").when(nav | (F.col("content_chars") < 600), "fair").otherwise("good")
    return d.withColumns({"quality": quality, "reason": F.when(shell, "shell").when(nav, "mostly-navigation").when(F.col("content_chars") < 600, "thin")})
