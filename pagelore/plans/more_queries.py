"""Further queries: glosses, numbers with units, structure bonuses, support texts, locators, page states, markdown reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.functions import lexicon as L
from pagelore.functions import sqltext as S
from pagelore.functions import text as T
from pagelore.operators import evidence as E
from pagelore.operators import search as Q
from pagelore.plans import block_queries, evidence_queries
from pagelore.session import table
from pagelore.sources import html as H

# --- fixed values: particles that end Korean words; the parameters of a 64-bit hash over bytes; what a browser takes for white space
PARTICLES = "에서는 에게서 으로써 으로는 에서 에게 으로 까지 부터 에는 와는 과는 은 는 이 가 을 를 의 에 로 와 과 도".split()
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
PLACES = {"text": 5, "head": 3, "href": 4, "tag": 2, "kind": 1}
PATHS = {"parent": 6, "full": 5, "under": 2}
BLANKS = r"[\t-\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"
# --- end of fixed values ------------------------------------------------------------------------------------------


def claims(spark, d):
    return table(spark, d, "claim_outcomes", "outcome_id", "page_id", "claim_statement").where("claim_statement is not null").distinct()


def t10_glosses(spark, d):
    return claims(spark, d).where(T.is_cjk(F.col("claim_statement"))).select("outcome_id", F.array_join(T.glosses(F.col("claim_statement")), " ").alias("glosses"))


def t18_numbers_with_units(spark, d):
    """Each number of a claim with the unit or the word after it."""
    w = T.split_words(T.normalize(F.col("claim_statement")))
    c = claims(spark, d).select("outcome_id", F.posexplode(w).alias("i", "v"), w.alias("w")).where("v rlike '^[0-9]+$'")
    after = F.get("w", F.col("i") + 1)
    return c.select("outcome_id", "v", F.coalesce(T.unit_of(after), F.when(T.month_of(after).isNotNull(), "month"), F.lit("")).alias("unit")).distinct()


def t26_byte_hash(spark, d):
    """A 64-bit hash over the bytes of each address, all rows of a batch one byte position at a time."""

    def fnv(urls: pa.Array) -> pa.Array:
        rows = [(u or "").encode() for u in urls.to_pylist()]
        h = np.full(len(rows), FNV_OFFSET, np.uint64)
        n = np.array([len(r) for r in rows])
        data = np.zeros((len(rows), int(n.max()) if len(rows) else 0), np.uint64)
        for i, r in enumerate(rows):
            data[i, : len(r)] = np.frombuffer(r, np.uint8)
        with np.errstate(over="ignore"):
            for j in range(data.shape[1]):
                h = np.where(j < n, (h ^ data[:, j]) * np.uint64(FNV_PRIME), h)
        return pa.array([f"{x:016x}" for x in h.tolist()])

    c = table(spark, d, "captures", "capture_id", "final_url").distinct()
    return c.select("capture_id", F.arrow_udf(fnv, "string")("final_url").alias("hash"))


def t27_stems_of_korean(spark, d):
    """Korean words without their particle."""
    w = F.filter(T.split_words(T.normalize(F.col("claim_statement"))), lambda x: x.rlike("^[가-힣]+$"))
    return claims(spark, d).where("claim_statement rlike '[가-힣]'").select("outcome_id", F.array_join(F.transform(w, lambda x: T.strip_hangul_suffix(x, PARTICLES)), " ").alias("stems"))


def e05_scripts_of_pages(spark, d):
    """Latin and CJK letters of a page's content, and whether it is matched across languages."""
    b = block_queries.blocks(spark, d, "capture_id", "block_role", "text")
    return E.scripts(b.withColumnsRenamed({"capture_id": "page", "block_role": "role"})).withColumnRenamed("page", "capture_id")


def e16_structure(spark, d):
    """What kind, role and region of a block add to a score."""
    b = evidence_queries.blocks(spark, d)
    region = F.lit(0.0)
    for k, v in L.REGION_ADJUSTMENT.items():
        region = F.when(F.lower("ref").startswith(k), v).otherwise(region)
    return b.select("page", "ord", F.round(E.mapped(L.KIND_BONUS, "kind", 0.0) + E.mapped(L.ROLE_ADJUSTMENT, "role", 0.0) + region, 6).alias("bonus"))


def e27_support_text(spark, d):
    """The texts of a claim's support in order of rank."""
    top = E.top_support(E.scored(evidence_queries.claims(spark, d), evidence_queries.blocks(spark, d)))
    return top.groupBy("claim").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "passage_search"))), lambda x: x["passage_search"]), " ").alias("text"))


def e34_outcomes(spark, d):
    """Verdicts with their snippets: one for each supporting block, the first is the primary one; cited only if supported."""
    c, b = evidence_queries.claims(spark, d), evidence_queries.blocks(spark, d)
    v = E.verdicts(c, b)
    text = b.select("page", "ref", T.snippet(F.col("text")).alias("snippet")).groupBy("page", "ref").agg(F.min("snippet").alias("snippet"))
    s = v.select("page", "claim", F.posexplode("support").alias("i", "ref")).join(text, ["page", "ref"], "left")
    s = s.groupBy("page", "claim").agg(F.array_sort(F.collect_list(F.struct("i", F.when(F.col("i") == 0, "primary").otherwise("context").alias("role"), "ref", "snippet"))).alias("snippets"))
    url = table(spark, d, "captures", "capture_id", "source_url").distinct().withColumnRenamed("capture_id", "page")
    x = v.join(s, ["page", "claim"], "left").join(url, "page", "left")
    return x.select("claim", "verdict", "support_score", F.to_json("snippets").alias("snippets"), F.when(F.col("verdict") == "evidence-supported", F.col("source_url")).alias("cited"))


def l01_locate(spark, d):
    """Each link or control of a page's first capture found again in its last one: by text, target, tag, DOM path and kind; ties by
    order. Texts are equal or one holds the other; another target or tag rules a candidate out, a missing one does not."""
    # rows delivered twice are the same, so they may go after the others
    b = table(spark, d, "snapshot_blocks", "block_key", "page_id", "capture_id", "ord", "block_kind", "text", "attributes", "dom_path_hint").where(F.col("block_kind").isin("link", "button", "input") & F.col("text").isNotNull())
    of = lambda key: F.coalesce(F.get_json_object("attributes", f"$.{key}"), F.lit(""))
    cols = {"href": of("href"), "tag": F.lower(of("tagName")), "said": F.lower(F.trim(F.regexp_replace("text", BLANKS, " "))), "hint": F.coalesce(F.lower("dom_path_hint"), F.lit(""))}
    ends = b.groupBy("page_id").agg(F.min("capture_id").alias("first"), F.max("capture_id").alias("last")).where("first < last")
    b = b.join(ends, "page_id").where("capture_id in (first, last)").withColumns(cols).drop("text", "attributes", "dom_path_hint").dropDuplicates(["block_key"])
    # the paths of a candidate are of tags alone
    b = b.withColumn("parent", F.regexp_replace("hint", "[#.][^ ]*", "")).withColumn("full", F.concat_ws(" > ", "parent", F.nullif("tag", F.lit(""))))
    t, c = b.where("capture_id = first").alias("t"), b.where("capture_id = last and (said <> '' or href <> '')").alias("c")
    # all pairs of a page's controls: both captures are bounded documents
    x = t.join(c, F.col("t.page_id") == F.col("c.page_id"))
    mine, other = (lambda k: F.col(f"t.{k}")), (lambda k: F.col(f"c.{k}"))
    given = lambda k: F.when(mine(k) == "", 0)
    # null where a candidate is ruled out
    text = given("said").when(mine("said") == other("said"), PLACES["text"]).when(other("said").contains(mine("said")) | mine("said").contains(other("said")), PLACES["head"])
    href = given("href").when(mine("href") == other("href"), PLACES["href"]).when(other("href") == "", 0)
    tag = given("tag").when(mine("tag") == other("tag"), PLACES["tag"]).when(other("tag") == "", 0)
    path = F.when((mine("hint") == "") | (other("hint") == ""), 0).when(other("parent") == mine("hint"), PATHS["parent"]).when(other("full") == mine("hint"), PATHS["full"])
    path = path.when(other("full").startswith(F.concat(mine("hint"), F.lit(" >"))), PATHS["under"]).otherwise(0)
    s = text + href + tag + path + F.when(mine("block_kind") == other("block_kind"), PLACES["kind"]).otherwise(0)
    best = x.select(F.col("t.block_key").alias("block_key"), s.alias("s"), F.struct(s.alias("score"), (-F.col("c.ord")).alias("o"), (-F.col("c.block_key")).alias("k")).alias("m")).where("s > 0").groupBy("block_key").agg(F.max("m").alias("m"))
    return best.select("block_key", (-F.col("m.k")).alias("found_key"), F.col("m.score").alias("score"))


def m03_memory_turns(spark, d):
    """Up to three notes of each capture: its supported claims, else its first headings and texts."""
    o = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"]).where("verdict = 'evidence-supported'").select("capture_id", F.lit(0).alias("part"), F.col("outcome_id").alias("o"), F.col("claim_statement").alias("note"))
    b = block_queries.blocks(spark, d, "capture_id", "ord", "block_kind", "text").where(F.col("block_kind").isin("heading", "metadata", "text") & (F.col("text") != "")).select("capture_id", F.lit(1).alias("part"), F.col("ord").cast("long").alias("o"), F.col("text").alias("note"))
    both = o.union(b).withColumn("least", F.min("part").over(W.partitionBy("capture_id"))).where("part = least")
    once = both.groupBy("capture_id", "note").agg(F.min("o").alias("o"))
    return once.withColumn("place", F.row_number().over(W.partitionBy("capture_id").orderBy("o", "note"))).where("place <= 3").select("capture_id", "place", "note")


def m08_replay(spark, d):
    """Each user's journal replayed: what is left after its last signup, in order."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    last = F.max(F.when(F.col("event_type") == "signup", F.col("seq"))).over(W.partitionBy("user_id"))
    x = e.withColumn("seq", F.row_number().over(w)).withColumn("last", last).where("last is null or seq >= last")
    return x.groupBy("user_id").agg(F.count("*").alias("entries"), F.min("seq").alias("from_seq"), F.max_by("event_type", "seq").alias("state"))


def q02_results_of_html(spark, d):
    """Results from the links of compiled html."""
    p = block_queries.pages(spark, d, "source_url", "current_html")
    b = H.compile_blocks(p, "capture_id", "current_html", "source_url").join(p.select("capture_id", F.col("source_url").alias("url")), "capture_id").withColumnRenamed("capture_id", "page")
    return Q.results(b).select("page", "rank", "title", "target")


def q09_page_status(spark, d):
    """Whether a page is a challenge, by the words of its first 24 blocks."""
    b = block_queries.blocks(spark, d, "capture_id", "ord", "text").where("ord <= 24")
    hit = T.any_phrase(F.coalesce("text", F.lit("")), ["unusual traffic", "captcha", "verify you are human", "confirm that you are a person", "checking took too long"])
    return b.groupBy("capture_id").agg(F.when(F.max(hit), "challenge").otherwise("ready").alias("status"))


def v13_report(spark, d):
    """A page's claims as markdown, by bucket."""
    o = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])
    x = o.groupBy("page_id", "verdict").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- "), "claim_statement"))), "\n").alias("lines"))
    part = F.concat(F.lit("## "), "verdict", F.lit("\n"), "lines")
    return x.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "\n\n").alias("report"))


def x03_page_rates(spark, d):
    """Shares of a host's captures with a title, with html, with text, and late by more than a day."""
    c = table(spark, d, "captures").dropDuplicates(["capture_id"])
    r = lambda x: F.round(F.avg(F.coalesce(x, F.lit(False)).cast("int")), 6)
    return c.groupBy("site").agg(r(F.col("title").isNotNull()).alias("titled"), r(F.length("current_html") > 0).alias("with_html"), r(F.length("visible_text") >= 200).alias("with_text"), r(F.col("ingested_at") > F.col("captured_at") + F.expr("interval 1 day")).alias("late"))


def x09_task_pass(spark, d):
    """A page passes if at least half of its claims are supported and one is cited."""
    o = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])
    a = o.groupBy("page_id").agg(F.avg((F.col("verdict") == "evidence-supported").cast("int")).alias("r"), F.count_if(F.col("citation.url") != "").alias("cited"))
    return a.select("page_id", ((F.col("r") >= 0.5) & (F.col("cited") > 0)).alias("passed"))


QUERIES = [t10_glosses, t18_numbers_with_units, t26_byte_hash, t27_stems_of_korean, e05_scripts_of_pages, e16_structure, e27_support_text, e34_outcomes, l01_locate, m03_memory_turns, m08_replay, q02_results_of_html, q09_page_status, v13_report, x03_page_rates, x09_task_pass]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    C = "(SELECT DISTINCT outcome_id, page_id, claim_statement FROM claim_outcomes WHERE claim_statement IS NOT NULL) c"
    O = "(SELECT * FROM claim_outcomes QUALIFY row_number() OVER (PARTITION BY outcome_id ORDER BY ingested_at) = 1)"
    B = "(SELECT * FROM snapshot_blocks QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY ingested_at) = 1)"
    P = "(SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY ingested_at) = 1)"
    words = S.split_words(S.normalize("claim_statement"))
    unit = "CASE " + " ".join(f"WHEN n IN ({S.Q(w.split())}) THEN '{u}'" for u, w in L.UNITS.items()) + f" WHEN n IN ({S.Q([*L.MONTHS, *(m[:3] for m in L.MONTHS), 'sept'])}) THEN 'month' ELSE '' END"
    case = lambda of, col: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in of.items()) + " ELSE 0::DOUBLE END"
    region = "CASE " + " ".join(f"WHEN starts_with(lower(stable_ref), '{k}') THEN {v}::DOUBLE" for k, v in L.REGION_ADJUSTMENT.items()) + " ELSE 0::DOUBLE END"
    gloss = " ".join([f"WHEN starts_with(t, '{k}') THEN [{', '.join(repr(x) for x in v)}]" for k, v in L.KOREAN_GLOSSES.items()] + [f"WHEN contains(t, '{k}') THEN [{', '.join(repr(x) for x in v)}]" for k, v in L.CHINESE_GLOSSES.items()])
    glosses = f"list_sort(list_distinct(list_filter(flatten(list_transform({words}, lambda t: CASE WHEN NOT {S.is_cjk('t')} THEN [{S.stem('t')}] ELSE CASE {gloss} ELSE [] END END)), lambda s: {S.is_significant('s')})))"
    both = f"list_sort(list_distinct(list_filter(list_concat({glosses}, list_transform({glosses}, lambda y: {S.stem('y')})), lambda s: {S.is_significant('s')})))"
    suffix = "|".join(sorted(PARTICLES, key=len, reverse=True))
    hits = ["unusual traffic", "captcha", "verify you are human", "confirm that you are a person", "checking took too long"]
    href, tag = "coalesce(json_extract_string(attributes, '$.href'), '')", "coalesce(json_extract_string(attributes, '$.tagName'), '')"
    rate = lambda c: f"round(avg(CAST(coalesce({c}, false) AS INT)), 6)"
    said = S.phrase("coalesce(text, '')")
    spoken = " OR ".join(f"contains({said}, ' {p} ')" for p in hits)
    return {
        "t10_glosses": f"SELECT outcome_id, array_to_string({both}, ' ') AS glosses FROM {C} WHERE {S.is_cjk('claim_statement')}",
        "t18_numbers_with_units": f"SELECT DISTINCT outcome_id, v, {unit} AS unit FROM (SELECT outcome_id, w[i] AS v, w[i + 1] AS n FROM (SELECT outcome_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT outcome_id, {words} AS w FROM {C}) x) y) z WHERE regexp_matches(v, '^[0-9]+$')",
        "t27_stems_of_korean": f"SELECT outcome_id, array_to_string(list_transform(list_filter({words}, lambda w: regexp_matches(w, '^[가-힣]+$')), lambda w: coalesce(nullif(regexp_extract(w, '^(.{{2,}}?)(?:{suffix})$', 1), ''), w)), ' ') AS stems FROM {C} WHERE regexp_matches(claim_statement, '[가-힣]')",
        "e05_scripts_of_pages": f"""SELECT *, latin >= 48 AND latin >= greatest(cjk * 3, 12) AS crosses FROM (SELECT capture_id, CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS latin, CAST(sum(length(regexp_replace(text, '[^{L.CJK}]', '', 'g'))) AS BIGINT) AS cjk
            FROM {B} b WHERE block_role IN ('content', 'supporting', 'metadata') AND text IS NOT NULL GROUP BY 1) x""",
        "e16_structure": f"SELECT capture_id AS page, ord, round({case(L.KIND_BONUS, 'block_kind')} + {case(L.ROLE_ADJUSTMENT, 'block_role')} + {region}, 6) AS bonus FROM {B} b",
        "l01_locate": f"""WITH b AS (SELECT block_key, page_id, capture_id, ord, block_kind, {S.normalize('text')} AS norm, {href} AS href, {tag} AS tag FROM {B} x WHERE block_kind IN ('link', 'button', 'input') AND text IS NOT NULL),
            e AS (SELECT page_id, min(capture_id) AS f, max(capture_id) AS l FROM b GROUP BY 1 HAVING min(capture_id) < max(capture_id))
            SELECT block_key, found_key, score FROM (SELECT t.block_key, c.block_key AS found_key, 5 + CASE WHEN t.href = c.href THEN 4 ELSE 0 END + CASE WHEN t.tag = c.tag THEN 2 ELSE 0 END + CASE WHEN t.block_kind = c.block_kind THEN 1 ELSE 0 END AS score, c.ord
            FROM e JOIN b t ON t.page_id = e.page_id AND t.capture_id = e.f JOIN b c ON c.page_id = e.page_id AND c.capture_id = e.l AND c.norm = t.norm) x QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY score DESC, ord, found_key) = 1""",
        "m03_memory_turns": f"""WITH n AS (SELECT capture_id, 0 AS part, outcome_id AS o, claim_statement AS note FROM {O} o WHERE verdict = 'evidence-supported' UNION ALL SELECT capture_id, 1, ord, text FROM {B} b WHERE block_kind IN ('heading', 'metadata', 'text') AND text <> ''),
            k AS (SELECT capture_id, note, min(o) AS o FROM (SELECT * FROM n QUALIFY part = min(part) OVER (PARTITION BY capture_id)) x GROUP BY 1, 2)
            SELECT capture_id, place, note FROM (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY o, note) AS place FROM k) y WHERE place <= 3""",
        "m08_replay": """SELECT user_id, count(*) AS entries, min(seq) AS from_seq, arg_max(event_type, seq) AS state FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN seq END) OVER (PARTITION BY user_id) AS last
            FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) x) y WHERE last IS NULL OR seq >= last GROUP BY user_id""",
        "q09_page_status": f"SELECT capture_id, CASE WHEN bool_or({spoken}) THEN 'challenge' ELSE 'ready' END AS status FROM {B} b WHERE ord <= 24 GROUP BY 1",
        "v13_report": f"""SELECT page_id, string_agg('## ' || verdict || chr(10) || lines, chr(10) || chr(10) ORDER BY '## ' || verdict || chr(10) || lines) AS report FROM (SELECT page_id, verdict, string_agg(DISTINCT '- ' || claim_statement, chr(10) ORDER BY '- ' || claim_statement) AS lines FROM {O} o GROUP BY 1, 2) x GROUP BY 1""",
        "x03_page_rates": f"SELECT site, {rate('title IS NOT NULL')} AS titled, {rate('length(current_html) > 0')} AS with_html, {rate('length(visible_text) >= 200')} AS with_text, {rate('ingested_at > captured_at + INTERVAL 1 DAY')} AS late FROM {P} p GROUP BY site",
        "x09_task_pass": f"SELECT page_id, r >= 0.5 AND cited > 0 AS passed FROM (SELECT page_id, avg(CAST(verdict = 'evidence-supported' AS INT)) AS r, count(*) FILTER (citation.url <> '') AS cited FROM {O} o GROUP BY 1) x",
    }
