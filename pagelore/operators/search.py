"""Search results out of pages: result rows, snippets, scores, recommendations, and the state of search profiles over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.functions import text as T

# --- fixed values -------------------------------------------------------------------------------------------------
OFFICIAL = r"^docs\.|^developer\.|developers\.|developer\.|docs\.|\.gov$|\.edu$|mdn"
SNIPPET_BLOCKS, SNIPPET_CHARS, TITLE_BYTES = 6, 220, 6
TRACKING = "utm_[a-z]+|gclid|fbclid|ref|src"
# --- end of fixed values ------------------------------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """Without fragment, tracking parameters, trailing slash; scheme and host in lower case."""
    u = F.regexp_replace(url, "#.*$", "")
    u = F.regexp_replace(u, rf"(?i)(?<=[?&])(?:{TRACKING})=[^&]*&?", "")
    u = F.regexp_replace(u, "[?&]$", "")
    origin = F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    return F.regexp_replace(F.concat(F.lower(origin), F.substr(u, F.length(origin) + 1)), "/$", "")


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1)), "^www\\.", "")


def clean_title(title: Column) -> Column:
    """What follows the last separator of a path of names."""
    t = F.regexp_replace(title, "^.*›", "")
    return T.squeeze(t)


def results(blocks: DataFrame) -> DataFrame:
    """Links of each page (page, ord, kind, role, ref, text, attributes, url) as ranked results: navigation, calls to action and short
    titles are passed over, of one address the first link counts."""
    href = F.get_json_object("attributes", "$.href")
    link = blocks.where((F.col("kind") == "link") & ~F.col("role").isin("primary-nav", "secondary-nav", "cta", "form-control") & href.isNotNull())
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("/"), F.concat(F.regexp_extract("url", "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), href)).otherwise(F.concat(F.regexp_replace("url", "[^/]*$", ""), href))
    link = link.withColumns({"target": canonical_url(full), "title": clean_title(F.col("text"))}).where(F.octet_length("title") >= TITLE_BYTES)
    first = link.withColumn("nth", F.row_number().over(W.partitionBy("page", "target").orderBy("ord", "ref"))).where("nth = 1")
    ranked = first.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy("ord", "ref")))
    return ranked.withColumn("domain", domain(F.col("target"))).select("page", "ord", "rank", "title", "target", "domain", "ref")


def snippets(blocks: DataFrame) -> DataFrame:
    """For each link block, the text of up to six blocks after it, up to the next heading or link."""
    text = T.trim_all(F.coalesce("text", F.lit("")))
    usable = F.col("kind").isin("text", "list", "metadata") & F.col("role").isin("content", "supporting") & (text != "")
    me = F.struct(F.col("kind").isin("heading", "link").alias("stop"), F.when(usable, text).alias("t"))
    after = F.collect_list(me).over(W.partitionBy("page").orderBy("ord").rowsBetween(1, SNIPPET_BLOCKS))
    fold = F.aggregate(
        "after", F.struct(F.lit(False).alias("done"), F.lit("").alias("s")),
        lambda a, x: F.when(a["done"] | x["stop"], F.struct(F.lit(True).alias("done"), a["s"].alias("s"))).when(x["t"].isNull(), a).otherwise(
            T.let(F.concat(a["s"], F.when(a["s"] == "", "").otherwise(" "), x["t"]), lambda s: F.struct((F.octet_length(s) >= SNIPPET_CHARS).alias("done"), s.alias("s")))),
        lambda a: a["s"],
    )
    b = blocks.withColumn("after", after).where("kind = 'link'")
    return b.select("page", "ord", T.truncate(F.nullif(fold, F.lit("")), SNIPPET_CHARS).alias("snippet"))


def selection(found: DataFrame, query: Column) -> DataFrame:
    """Results with how much they are worth opening for a query, best three of a page marked."""
    tokens = T.search_tokens(query)
    official = F.col("domain").rlike(OFFICIAL) | F.exists(tokens, lambda t: (F.length(t) >= 4) & F.col("domain").contains(t))
    named = F.size(F.filter(tokens, lambda t: F.lower("title").contains(t))) / F.greatest(F.size(tokens), F.lit(1))
    s = F.lit(0.6) / F.col("rank") + F.when(official, 0.25).otherwise(0.0) + named * 0.15
    f = found.withColumns({"official": official, "score": T.round2(F.least(F.lit(1.0), s))})
    return f.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(F.desc("score"), F.desc("official"), "rank"))).withColumn("recommended", F.col("place") <= 3)


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Results of two extractions of a page: the second adds the addresses that the first lacks; ranks run on."""
    both = first.withColumn("part", F.lit(0)).unionByName(second.withColumn("part", F.lit(1)))
    once = both.withColumn("nth", F.row_number().over(W.partitionBy("page", "target").orderBy("part", "rank"))).where("nth = 1")
    return once.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy("part", "rank"))).drop("nth", "part")


def profile_runs(states: DataFrame, key: list[str], at: str, failures: str) -> DataFrame:
    """Islands of consecutive states of a profile with and without challenges: first and last time, states, greatest count."""
    bad = F.coalesce(F.col(failures), F.lit(0)) > 0
    w = W.partitionBy(*key).orderBy(at, "state_id")
    x = states.withColumn("bad", bad).withColumn("island", F.row_number().over(w) - F.row_number().over(W.partitionBy(*key, "bad").orderBy(at, "state_id")))
    return x.groupBy(*key, "bad", "island").agg(F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("states"), F.max(failures).alias("most")).drop("island")
