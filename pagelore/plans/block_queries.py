"""Queries of sources, page compilation and block operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.functions import text as T
from pagelore.operators import budget
from pagelore.session import table
from pagelore.sources import html as H


def pages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Captures, each once."""
    return table(spark, d, "captures").dropDuplicates(["capture_id"]).select("capture_id", *cols)


def blocks(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Snapshot blocks, each once."""
    return table(spark, d, "snapshot_blocks", "block_key", *cols).dropDuplicates(["block_key"])


def b01_compile(spark, d):
    """Every page compiled to its blocks."""
    return H.compile_blocks(pages(spark, d, "source_url", "current_html"), "capture_id", "current_html", "source_url")


def kind_of(tag):
    out = F.when(tag.rlike("^h[1-6]$"), "heading")
    for t, k in H.KIND.items():
        out = out.when(tag == t, k)
    return out.otherwise("text")


def b09_kind_role(spark, d):
    b = blocks(spark, d, "attributes", "block_zone").where("attributes is not null")
    tag, ext = F.get_json_object("attributes", "$.tagName"), F.get_json_object("attributes", "$.external")
    role = (
        F.when(tag == "title", "metadata").when(tag == "script", "supporting").when(F.col("block_zone") == "nav", "primary-nav").when(F.col("block_zone") == "aside", "secondary-nav")
        .when(tag.isin(*H.CONTROLS), "form-control").when(tag == "listbox", "supporting").when((tag == "a") & (ext == "true"), "cta").otherwise("content")
    )
    return b.select("block_key", kind_of(tag).alias("kind"), role.alias("role"))


def b10_priority(spark, d):
    m = lambda of, col, els: F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col(col)], F.lit(els))
    return blocks(spark, d, "block_kind", "block_role").select("block_key", (m(H.KIND_PRIORITY, "block_kind", 0) + m(H.ROLE_PRIORITY, "block_role", 0)).alias("priority"))


def b11_slug(spark, d):
    s = T.slugify(F.col("text"))
    return blocks(spark, d, "text").where("text is not null").select("block_key", F.when(s == "", "block").otherwise(s).alias("slug"))


def b12_stable_ref(spark, d):
    """The zone, kind and slug of a block, numbered within its capture from the second one on."""
    s = T.slugify(F.col("text"))
    b = blocks(spark, d, "capture_id", "ord", "block_zone", "block_kind", "text")
    b = b.withColumn("base", F.concat_ws(":", F.concat(F.lit("r"), F.coalesce("block_zone", F.lit("body"))), "block_kind", F.when(F.coalesce(s, F.lit("")) == "", "block").otherwise(s)))
    n = F.row_number().over(W.partitionBy("capture_id", "base").orderBy("ord", "block_key"))
    return b.withColumn("n", n).select("block_key", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws(":", "base", "n")).alias("ref"))


def b16_budget(spark, d):
    """Blocks that a page's recommended budget, a quarter of it so that it binds, keeps."""
    b = table(spark, d, "snapshot_blocks").dropDuplicates(["block_key"]).selectExpr("capture_id", "ord", "block_kind kind", "block_role role", "block_zone zone", "priority", "token_cost")
    return budget.within_budget(b, "capture_id", F.lit(128))


def b17_adaptive_budget(spark, d):
    return pages(spark, d, "current_html").where("current_html is not null").select("capture_id", budget.recommended_tokens(F.col("current_html")).alias("tokens"))


def b19_title(spark, d):
    t = F.regexp_extract("current_html", "(?is)<title[^>]*>(.*?)</title", 1)
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return pages(spark, d, "current_html").where("current_html is not null").select("capture_id", F.nullif(T.squeeze(t), F.lit("")).alias("title"))


def s02_catalog(spark, d):
    """One page for each address and each alias (the address it ended at): the last capture holds."""
    p = table(spark, d, "captures").select("capture_id", "source_url", "final_url", "captured_at").distinct()
    keyed = p.select(F.col("source_url").alias("key"), "capture_id", "captured_at").union(p.where("final_url <> source_url").select("final_url", "capture_id", "captured_at"))
    return keyed.groupBy("key").agg(F.max(F.struct("captured_at", "capture_id")).alias("m")).select("key", "m.capture_id")


def s03_resolve_link(spark, d):
    """Links of blocks resolved against the page: fragment, then site path to a page whose last segment it begins."""
    b = blocks(spark, d, "site", "source_url", "attributes").where("attributes is not null").withColumn("href", F.get_json_object("attributes", "$.href")).where("href is not null")
    last = F.regexp_extract(F.regexp_replace("source_url", "[?#].*$", ""), "([^/]+)/?$", 1)
    known = b.select("site", F.col("source_url").alias("target"), last.alias("segment")).distinct().groupBy("site", "segment").agg(F.min("target").alias("target"))
    want = b.withColumn("segment", F.regexp_extract("href", "^/([^/?#]+)", 1))
    hit = want.join(known, ["site", "segment"], "left")
    return hit.select("block_key", F.when(F.col("href").startswith("#"), F.col("source_url")).otherwise(F.col("target")).alias("target"))


def s05_final_hop(spark, d):
    """A redirect chain's last hop and its length, from a chain of the address, the canonical one and the final one."""
    chain = F.array_distinct(F.array("source_url", F.regexp_replace("source_url", "#.*$", ""), "final_url"))
    return pages(spark, d, "source_url", "final_url").select("capture_id", F.element_at(chain, -1).alias("final_url"), (F.size(chain) - 1).alias("hops"))


def s07_cache_key(spark, d):
    return pages(spark, d, "final_url").select("capture_id", F.regexp_replace("final_url", "#.*$", "").alias("key"))


def s08_cache(spark, d):
    """Captures that a cache with a lifetime of 60 seconds after the last fetch would have answered."""
    p = pages(spark, d, "final_url", "captured_at").withColumn("key", F.regexp_replace("final_url", "#.*$", ""))
    before = F.lag("captured_at").over(W.partitionBy("key").orderBy("captured_at", "capture_id"))
    return p.select("capture_id", F.coalesce(F.col("captured_at") <= before + F.expr("interval 60 seconds"), F.lit(False)).alias("hit"))


def s11_origin_key(spark, d):
    u = F.col("source_url")
    scheme, host, port = F.lower(F.regexp_extract(u, "^([A-Za-z]+)://", 1)), F.lower(F.regexp_extract(u, "^[A-Za-z]+://([^/:?#]+)", 1)), F.regexp_extract(u, "^[A-Za-z]+://[^/:?#]+:([0-9]+)", 1)
    return pages(spark, d, "source_url").select("capture_id", F.concat(scheme, F.lit("://"), host, F.lit(":"), F.when(port != "", port).when(scheme == "https", "443").otherwise("80")).alias("origin"))


def s17_search_url(spark, d):
    """Every statement as the query of a search address: the percent bytes of its UTF-8, a blank as a plus."""
    c = table(spark, d, "claim_outcomes", "outcome_id", "claim_statement").where("claim_statement is not null").distinct()
    return c.select("outcome_id", F.concat(F.lit("https://search.example/?q="), F.url_encode("claim_statement")).alias("url"))


QUERIES = [b01_compile, b09_kind_role, b10_priority, b11_slug, b12_stable_ref, b16_budget, b17_adaptive_budget, b19_title, s02_catalog, s03_resolve_link, s05_final_hop, s07_cache_key, s08_cache, s11_origin_key, s17_search_url]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    B = "(SELECT * FROM snapshot_blocks QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY ingested_at) = 1) b"
    P = "(SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY ingested_at) = 1) p"
    q = lambda ws: ", ".join(f"'{w}'" for w in sorted(ws))
    tag = "json_extract_string(attributes, '$.tagName')"
    case = lambda of, col: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in of.items()) + " ELSE "
    slug = "regexp_replace(left(regexp_replace(regexp_replace(lower(text), '[^0-9a-z]+', '-', 'g'), '^-+|-+$', '', 'g'), 48), '-+$', '')"
    count = lambda t: f"((length(current_html) - length(replace(current_html, '{t}', ''))) // {len(t)})"
    heads = "(" + " + ".join(count(f"<h{i}") for i in range(1, 7)) + ")"
    score = f"(strlen(current_html) // 12000 + {count('<a')} // 20 + {heads} // 10 + {count('<p')} // 30 + {count('<li')} // 40 + {count('<table')} * 3 + {count('<button')} // 10 + {count('<input')} // 10)"
    level = lambda s, a, c, t: f"WHEN strlen(current_html) >= {s} OR {count('<a')} >= {a} OR {score} >= {c} THEN {t}"
    unescape = "regexp_extract(current_html, '<title[^>]*>(.*?)</title', 1, 'is')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        unescape = f"replace({unescape}, '{a}', '{b}')"
    last = "regexp_extract(regexp_replace(source_url, '[?#].*$', ''), '([^/]+)/?$', 1)"
    return {
        "b09_kind_role": f"""SELECT block_key, CASE WHEN regexp_matches({tag}, '^h[1-6]$') THEN 'heading' ELSE {case(H.KIND, tag)} 'text' END END AS kind,
            CASE WHEN {tag} = 'title' THEN 'metadata' WHEN {tag} = 'script' THEN 'supporting' WHEN block_zone = 'nav' THEN 'primary-nav' WHEN block_zone = 'aside' THEN 'secondary-nav'
            WHEN {tag} IN ({q(H.CONTROLS)}) THEN 'form-control' WHEN {tag} = 'listbox' THEN 'supporting' WHEN {tag} = 'a' AND json_extract_string(attributes, '$.external') = 'true' THEN 'cta' ELSE 'content' END AS role
            FROM {B} WHERE attributes IS NOT NULL""",
        "b10_priority": f"SELECT block_key, {case(H.KIND_PRIORITY, 'block_kind')} 0 END + {case(H.ROLE_PRIORITY, 'block_role')} 0 END AS priority FROM {B}",
        "b11_slug": f"SELECT block_key, CASE WHEN {slug} = '' THEN 'block' ELSE {slug} END AS slug FROM {B} WHERE text IS NOT NULL",
        "b12_stable_ref": f"""SELECT block_key, CASE WHEN n = 1 THEN base ELSE base || ':' || n END AS ref FROM (SELECT block_key, base, row_number() OVER (PARTITION BY capture_id, base ORDER BY ord, block_key) AS n FROM (
            SELECT *, 'r' || coalesce(block_zone, 'body') || ':' || block_kind || ':' || CASE WHEN coalesce({slug}, '') = '' THEN 'block' ELSE {slug} END AS base FROM {B}) x) y""",
        "b17_adaptive_budget": f"SELECT capture_id, CASE {level(150000, 120, 24, 4096)} {level(60000, 45, 10, 2048)} {level(20000, 20, 4, 1024)} ELSE 512 END AS tokens FROM {P} WHERE current_html IS NOT NULL",
        "b19_title": f"SELECT capture_id, nullif(trim(regexp_replace({unescape}, '[\\s\\x{{0B}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')), '') AS title FROM {P} WHERE current_html IS NOT NULL",
        "s02_catalog": """SELECT key, arg_max(capture_id, (captured_at, capture_id)) AS capture_id FROM (SELECT source_url AS key, capture_id, captured_at FROM captures
            UNION SELECT final_url, capture_id, captured_at FROM captures WHERE final_url <> source_url) x GROUP BY key""",
        "s03_resolve_link": f"""WITH b AS (SELECT *, json_extract_string(attributes, '$.href') AS href FROM {B} WHERE json_extract_string(attributes, '$.href') IS NOT NULL),
            k AS (SELECT site, {last} AS segment, min(source_url) AS target FROM b GROUP BY 1, 2)
            SELECT block_key, CASE WHEN starts_with(href, '#') THEN source_url ELSE k.target END AS target FROM b LEFT JOIN k ON k.site = b.site AND k.segment = regexp_extract(href, '^/([^/?#]+)', 1)""",
        "s05_final_hop": f"SELECT capture_id, final_url, CAST(len(list_distinct([source_url, regexp_replace(source_url, '#.*$', ''), final_url])) - 1 AS INT) AS hops FROM {P}",
        "s07_cache_key": f"SELECT capture_id, regexp_replace(final_url, '#.*$', '') AS key FROM {P}",
        "s08_cache": f"""SELECT capture_id, coalesce(captured_at <= lag(captured_at) OVER (PARTITION BY regexp_replace(final_url, '#.*$', '') ORDER BY captured_at, capture_id) + INTERVAL 60 SECOND, false) AS hit FROM {P}""",
        "s11_origin_key": f"""SELECT capture_id, lower(regexp_extract(source_url, '^([A-Za-z]+)://', 1)) || '://' || lower(regexp_extract(source_url, '^[A-Za-z]+://([^/:?#]+)', 1)) || ':' ||
            coalesce(nullif(regexp_extract(source_url, '^[A-Za-z]+://[^/:?#]+:([0-9]+)', 1), ''), CASE WHEN starts_with(lower(source_url), 'https') THEN '443' ELSE '80' END) AS origin FROM {P}""",
        "s17_search_url": "SELECT outcome_id, 'https://search.example/?q=' || replace(replace(url_encode(claim_statement), '%20', '+'), '%2A', '*') AS url FROM (SELECT DISTINCT outcome_id, claim_statement FROM claim_outcomes WHERE regexp_full_match(claim_statement, '[ -~]*')) x",
    }
