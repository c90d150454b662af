"""Queries of the evidence pipeline over captures' blocks and the claims asked of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.functions import lexicon as L
from pagelore.functions import sqltext as S
from pagelore.functions import text as T
from pagelore.operators import evidence as E
from pagelore.operators import guards as G
from pagelore.session import cut, table


def blocks(spark, d):
    b = table(spark, d, "snapshot_blocks").dropDuplicates(["block_key"])
    return b.select(F.col("capture_id").alias("page"), "ord", F.col("block_kind").alias("kind"), F.col("block_role").alias("role"), F.col("stable_ref").alias("ref"), "text", "attributes")


def claims(spark, d):
    c = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])
    return c.select(F.col("capture_id").alias("page"), F.col("outcome_id").alias("claim"), F.col("claim_statement").alias("statement"))


def e02_claim_analysis(spark, d):
    c = E.prepare_claims(claims(spark, d))
    return c.select("claim", "normalized", *[F.array_join(x, " ").alias(x) for x in ("claim_tokens", "numbers", "qualifiers", "anchors", "units")])


def e03_candidates(spark, d):
    return E.candidates(E.prepare_blocks(blocks(spark, d))).select("page", "ord", "seg_no", "passage")


def e06_idf(spark, d):
    c, b = E.prepare_claims(claims(spark, d)), E.prepare_blocks(blocks(spark, d))
    w = E.claim_weights(c, b).join(c.select("claim", "claim_tokens"), "claim")
    return w.select("claim", F.explode(F.arrays_zip(F.col("claim_tokens").alias("token"), F.col("weights").alias("weight"))).alias("x")).select("claim", F.col("x.token"), F.round("x.weight", 6).alias("weight"))


def e07_search_text(spark, d):
    return E.prepare_blocks(blocks(spark, d)).select("page", "ord", F.array_join("tokens", " ").alias("tokens"))


def e09_context(spark, d):
    b = E.prepare_blocks(blocks(spark, d))
    return b.select("page", "ord", F.col("heading.ord").alias("heading_ord"), F.size("around").alias("context_tokens"))


def e10_primary_heading(spark, d):
    b = E.prepare_blocks(blocks(spark, d)).where("kind = 'heading'")
    return b.groupBy("page").agg(F.min_by("ord", F.struct(F.coalesce(F.col("level") != 1, F.lit(True)), "ord")).alias("ord"))


def e19_score(spark, d):
    """Scores before polarity."""
    b = E.prepare_blocks(blocks(spark, d))
    c = E.matching_claims(claims(spark, d), b)
    p = E.score(c.join(E.claim_weights(c, b), ["page", "claim"]).join(E.candidates(b), "page"))
    return p.select("claim", "ord", "seg_no", *[F.round(x, 5).alias(x) for x in ("lexical", "exact", "numeric")])


def e20_contradictions(spark, d):
    b = E.prepare_blocks(blocks(spark, d))
    p = E.prepare_claims(claims(spark, d)).join(E.candidates(b), "page")
    return E.contradictions(p).where("contradictory").select("claim", "ord", "seg_no")


def e21_ranked(spark, d):
    return E.scored(claims(spark, d), blocks(spark, d)).select("claim", "ord", "seg_no", F.round("score", 6).alias("score"), "contradictory", "rank")


def e24_checked_refs(spark, d):
    return E.checked_refs(E.scored(claims(spark, d), blocks(spark, d))).select("claim", "ref", "n")


def e26_top_support(spark, d):
    return E.top_support(E.scored(claims(spark, d), blocks(spark, d))).select("claim", "place", "ref", "seg_no", F.round("score", 6).alias("score"))


def e29_guards(spark, d):
    """What the numeric, scope, status and qualifier guards say of each claim's support."""
    b = cut(E.prepare_blocks(blocks(spark, d)))
    c = cut(E.matching_claims(claims(spark, d), b))
    return G.guarded(c, E.top_support(E.ranked(c, b)), b).drop("page", "explicit")


def e32_verdicts(spark, d):
    return E.verdicts(claims(spark, d), blocks(spark, d)).withColumnRenamed("claim", "outcome_id").drop("page")


def e33_confidence_band(spark, d):
    c = table(spark, d, "claim_outcomes", "outcome_id", "support_score").distinct()
    s = F.col("support_score")
    return c.select("outcome_id", F.when(s >= 0.92, "high").when(s >= 0.82, "medium").when(s.isNotNull(), "review").alias("band"))


def e35_conflicts(spark, d):
    c = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"]).where("verdict = 'evidence-supported'")
    return E.conflicts(c.select(F.col("page_id").alias("page"), F.col("outcome_id").alias("claim"), F.col("claim_statement").alias("statement")))


def e36_buckets(spark, d):
    c = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])
    ok = (F.col("verdict") != "evidence-supported") | (F.col("citation.url") != "")
    kinds = {"supported": "evidence-supported", "contradicted": "contradicted", "insufficient": "insufficient-evidence", "more": "needs-more-browsing"}
    return c.where(ok).groupBy("page_id").agg(*[F.count_if(F.col("verdict") == v).alias(k) for k, v in kinds.items()])


def e38_adjudicate(spark, d):
    """Claims asked again on a page: the latest other outcome of the statement serves as the outside verdict and overrules."""
    c = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"]).select("outcome_id", "page_id", "claim_statement", "verdict", "generated_at")
    v = c.groupBy("page_id", "claim_statement").agg(F.max_by("verdict", F.struct("generated_at", "outcome_id")).alias("said"), F.count("*").alias("n")).where("n > 1")
    x = c.join(v, ["page_id", "claim_statement"], "left")
    return x.select("outcome_id", F.when(F.col("said").isNull(), F.col("verdict")).when((F.col("said") != "evidence-supported") & (F.col("verdict") == "evidence-supported"), "needs-more-browsing").otherwise(F.col("said")).alias("verdict"))


def e39_outcomes_of_buckets(spark, d):
    """Outcomes rebuilt by uniting the four buckets."""
    c = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])
    parts = [c.where(F.col("verdict") == v).select("outcome_id", F.lit(i).alias("bucket")) for i, v in enumerate(("evidence-supported", "contradicted", "insufficient-evidence", "needs-more-browsing"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def e42_reuse(spark, d):
    c = table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])
    reuse = (F.col("verdict") == "evidence-supported") & (F.col("confidence_band") == "high") & ~F.coalesce("review_recommended", F.lit(False))
    return c.groupBy("page_id").agg(F.count("*").alias("claims"), F.count_if(reuse).alias("reusable"), F.count_if(F.coalesce("review_recommended", F.lit(False))).alias("review"))


QUERIES = [e02_claim_analysis, e03_candidates, e06_idf, e07_search_text, e09_context, e10_primary_heading, e19_score, e20_contradictions, e21_ranked, e24_checked_refs, e26_top_support, e29_guards, e32_verdicts, e33_confidence_band, e35_conflicts, e36_buckets, e38_adjudicate, e39_outcomes_of_buckets, e42_reuse]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    from pagelore.plans.text_queries import _clauses_sql, _sentences_sql, _units_sql

    B = "(SELECT capture_id AS page, ord, block_kind AS kind, block_role AS role, stable_ref AS ref, coalesce(text, '') AS text, attributes FROM snapshot_blocks QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY ingested_at) = 1)"
    C = "(SELECT capture_id AS page, outcome_id AS claim, claim_statement AS statement FROM claim_outcomes WHERE trim(claim_statement) <> '' QUALIFY row_number() OVER (PARTITION BY outcome_id ORDER BY ingested_at) = 1)"
    O = "(SELECT * FROM claim_outcomes QUALIFY row_number() OVER (PARTITION BY outcome_id ORDER BY ingested_at) = 1)"
    val = "json_extract(attributes, '$.\"' || k || '\"')"
    terms = f"""coalesce(array_to_string(list_filter(list_transform(list_sort(json_keys(attributes)), lambda k: CASE json_type({val}) WHEN 'BOOLEAN' THEN CASE WHEN {val}::VARCHAR = 'true' THEN k END
        WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN array_to_string(from_json({val}, '["VARCHAR"]'), ' ') ELSE json_extract_string(attributes, '$."' || k || '"') END), lambda v: v IS NOT NULL), ' '), '')"""
    norm = S.normalize("text")
    kind = f"""concat_ws(' ', CASE kind WHEN 'list' THEN 'list items' WHEN 'link' THEN CASE WHEN regexp_matches(json_extract_string(attributes, '$.href'), '^https?://') THEN 'link external external-link' ELSE 'link' END
        WHEN 'button' THEN 'button' WHEN 'form' THEN 'form field fields input' WHEN 'input' THEN 'input field' END,
        CASE WHEN json_extract_string(attributes, '$.selectionSemantic') = 'available-options' THEN 'option options available availability supported' END,
        CASE WHEN contains({norm}, 'submit') THEN 'submission' END, CASE WHEN contains({norm}, 'execute') THEN 'execution' END)"""
    prep = f"prep AS (SELECT *, text || ' ' || terms AS search FROM (SELECT *, {terms} || ' ' || {kind} AS terms FROM {B} x) y), toks AS (SELECT *, {S.significant('search')} AS tokens FROM prep)"
    cl = f"cl AS (SELECT *, {S.significant('statement')} AS claim_tokens, {S.all_tokens('statement')} AS seq, {S.numeric('statement')} AS numbers FROM {C} z)"
    weights = f"""{cl}, {prep}, hits AS (SELECT c.claim, unnest({S.matched('c.claim_tokens', 't.tokens')}) AS token FROM cl c JOIN toks t USING (page)),
        df AS (SELECT claim, token, count(*) AS df FROM hits GROUP BY 1, 2), n AS (SELECT page, count(*) AS n FROM toks GROUP BY 1),
        w AS (SELECT c.claim, c.token, greatest(0.2, ln((n.n - coalesce(df.df, 0) + 0.5) / (coalesce(df.df, 0) + 0.5)) + 1.0) AS weight
            FROM (SELECT claim, page, unnest(claim_tokens) AS token FROM cl) c JOIN n USING (page) LEFT JOIN df USING (claim, token))"""
    trim = lambda e: f"regexp_replace({e}, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g')"
    segs = f"CASE WHEN kind IN ('text', 'list', 'table', 'metadata') THEN {_clauses_sql(_sentences_sql('text'))} ELSE [{trim('text')}] END"
    cand = f"(SELECT *, unnest(segs) AS passage, unnest(range(len(segs))) AS seg_no FROM (SELECT *, CASE WHEN len(s0) = 0 THEN [{trim('text')}] ELSE s0 END AS segs FROM (SELECT *, {segs} AS s0 FROM prep) p1) p2)"
    head = trim("string_split(text, chr(10))[1]")
    pads = lambda x: f"(' ' || array_to_string({x}, ' ') || ' ')"
    return {
        "e02_claim_analysis": f"""SELECT claim, {S.normalize('statement')} AS normalized, array_to_string({S.significant('statement')}, ' ') AS claim_tokens, array_to_string({S.numeric('statement')}, ' ') AS numbers,
            array_to_string({S.qualifiers('statement')}, ' ') AS qualifiers, array_to_string({S.anchors(S.significant('statement'))}, ' ') AS anchors, array_to_string({_units_sql('statement')}, ' ') AS units FROM {C} c""",
        "e03_candidates": f"WITH {prep} SELECT page, ord, seg_no, passage FROM {cand} c",
        "e06_idf": f"WITH {weights} SELECT claim, token, round(weight, 6) AS weight FROM w",
        "e07_search_text": f"WITH {prep} SELECT page, ord, array_to_string(tokens, ' ') AS tokens FROM toks",
        "e10_primary_heading": f"SELECT page, arg_min(ord, (coalesce(CAST(json_extract_string(attributes, '$.level') AS INT) <> 1, true), ord)) AS ord FROM {B} b WHERE kind = 'heading' GROUP BY page",
        "e19_score": f"""WITH {weights}, ca AS (SELECT *, {S.significant('ps')} AS st, {S.all_tokens('ps')} AS sa, {S.numeric('ps')} AS sn FROM (SELECT *, concat_ws(' ', passage, CASE WHEN kind IN ('table', 'list') AND {head} <> '' AND {head} <> passage THEN {head} END, terms) AS ps FROM {cand} a) b),
            pr AS (SELECT cl.claim, cl.claim_tokens, cl.seq, cl.numbers, ca.ord, ca.seg_no, ca.st, ca.sa, ca.sn FROM cl JOIN ca USING (page) WHERE len(ca.st) > 0),
            lx AS (SELECT pr.claim, pr.ord, pr.seg_no, sum(CASE WHEN len(list_filter(pr.st, lambda o: {S.tokens_match('w.token', 'o')})) > 0 THEN w.weight ELSE 0 END) / sum(w.weight) AS lexical FROM pr JOIN w USING (claim) GROUP BY 1, 2, 3)
            SELECT pr.claim, pr.ord, pr.seg_no, round(coalesce(lx.lexical, 0), 5) AS lexical,
              round(CASE WHEN len(seq) > 0 AND contains({pads('sa')}, {pads('seq')}) THEN 1.0::DOUBLE WHEN len(seq) > 0 AND len(list_filter(seq, lambda q: NOT list_contains(sa, q))) = 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END, 5) AS exact,
              round(CASE WHEN len(numbers) > 0 THEN len(list_intersect(numbers, sn)) / len(numbers) ELSE 0.0 END, 5) AS numeric
            FROM pr LEFT JOIN lx USING (claim, ord, seg_no)""",
        "e33_confidence_band": "SELECT outcome_id, CASE WHEN support_score >= 0.92 THEN 'high' WHEN support_score >= 0.82 THEN 'medium' WHEN support_score IS NOT NULL THEN 'review' END AS band FROM (SELECT DISTINCT outcome_id, support_score FROM claim_outcomes) x",
        "e36_buckets": f"""SELECT page_id, count(*) FILTER (verdict = 'evidence-supported') AS supported, count(*) FILTER (verdict = 'contradicted') AS contradicted,
            count(*) FILTER (verdict = 'insufficient-evidence') AS insufficient, count(*) FILTER (verdict = 'needs-more-browsing') AS more FROM {O} o WHERE verdict <> 'evidence-supported' OR citation.url <> '' GROUP BY page_id""",
        "e38_adjudicate": f"""SELECT outcome_id, CASE WHEN said IS NULL THEN verdict WHEN said <> 'evidence-supported' AND verdict = 'evidence-supported' THEN 'needs-more-browsing' ELSE said END AS verdict FROM (SELECT *,
            CASE WHEN count(*) OVER (PARTITION BY page_id, claim_statement) > 1 THEN first_value(verdict) OVER (PARTITION BY page_id, claim_statement ORDER BY generated_at DESC, outcome_id DESC) END AS said FROM {O} o) x""",
        "e39_outcomes_of_buckets": f"SELECT outcome_id, CASE verdict WHEN 'evidence-supported' THEN 0 WHEN 'contradicted' THEN 1 WHEN 'insufficient-evidence' THEN 2 ELSE 3 END AS bucket FROM {O} o WHERE verdict IN ('evidence-supported', 'contradicted', 'insufficient-evidence', 'needs-more-browsing')",
        "e42_reuse": f"""SELECT page_id, count(*) AS claims, count(*) FILTER (verdict = 'evidence-supported' AND confidence_band = 'high' AND NOT coalesce(review_recommended, false)) AS reusable,
            count(*) FILTER (coalesce(review_recommended, false)) AS review FROM {O} o GROUP BY page_id""",
    }
