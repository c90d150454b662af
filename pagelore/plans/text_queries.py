"""Queries of the text functions over claim statements and block texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.functions import lexicon as L
from pagelore.functions import sqltext as S
from pagelore.functions import text as T
from pagelore.session import table

PHRASES = ["sign in", "access denied", "accept all", "terms of use", "enable javascript"]


def claims(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claim_outcomes", "outcome_id", "page_id", "claim_id", "claim_statement").where("claim_statement is not null").distinct()


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshot_blocks", "block_key", "block_kind", "text").where("text is not null").distinct()


C = "(SELECT DISTINCT outcome_id, page_id, claim_id, claim_statement FROM claim_outcomes WHERE claim_statement IS NOT NULL) c"
B = "(SELECT DISTINCT block_key, block_kind, text FROM snapshot_blocks WHERE text IS NOT NULL) b"


def _claim(name, expr, sql):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return claims(spark, d).select("outcome_id", *[e.alias(n) for n, e in expr(F.col("claim_statement"), F.col("text")).items()])

    return name, run, f"SELECT outcome_id, {', '.join(f'{q} AS {n}' for n, q in sql.items())} FROM {C}"


def _block(name, expr, sql):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return blocks(spark, d).select("block_key", *[e.alias(n) for n, e in expr(F.col("claim_statement"), F.col("text")).items()])

    return name, run, f"SELECT block_key, {', '.join(f'{q} AS {n}' for n, q in sql.items())} FROM {B}"


def _sentences_sql(x: str) -> str:
    # without lookarounds: periods before a letter or digit and after one are kept aside first
    keep = f"regexp_replace(regexp_replace({x}, '([\\p{{L}}\\p{{N}}])\\.([\\p{{L}}\\p{{N}}])', '\\1\x02\\2', 'g'), '([\\p{{L}}\\p{{N}}])\\.([\\p{{L}}\\p{{N}}])', '\\1\x02\\2', 'g')"
    cut = f"regexp_replace({keep}, '[!?;.\\n\\r]', '\x01', 'g')"
    return f"list_filter(list_transform(string_split(replace({cut}, '\x02', '.'), '\x01'), lambda s: regexp_replace(s, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g')), lambda s: s <> '')"


def _clauses_sql(x: str) -> str:
    for m in L.CLAUSE_MARKERS:
        trim = lambda e: f"regexp_replace({e}, '^[\\s\\x{{85}}\\p{{Z}}]+|[\\s\\x{{85}}\\p{{Z}}]+$', '', 'g')"
        at = f"strpos(lower(g), '{m}')"
        x = f"flatten(list_transform({x}, lambda g: CASE WHEN {at} > 0 THEN list_filter([{trim(f'left(g, {at} - 1)')}, {trim(f'substring(g, {at} + {len(m)})')}], lambda p: p <> '') ELSE [g] END))"
    return x


def _units_sql(x: str) -> str:
    case = "CASE " + " ".join(f"WHEN t IN ({S.Q(w.split())}) THEN '{u}'" for u, w in L.UNITS.items()) + " END"
    return f"list_sort(list_distinct(list_filter(list_transform({S.significant(x)}, lambda t: {case}), lambda u: u IS NOT NULL)))"


def _low_sql(x: str) -> str:
    toks = S.split_words(S.normalize(x))
    sig = f"list_filter({toks}, lambda t: length(t) >= 2)"
    most = f"list_max(list_transform(list_distinct({sig}), lambda d: len(list_filter({sig}, lambda e: e = d))))"
    run = f"len(list_filter(range(1, len({toks}) - 4), lambda i: len(list_distinct(list_slice({toks}, i, i + 5))) = 1)) > 0"
    few = f"(len({sig}) >= 24 AND len({S.anchors(toks)}) / greatest(len({sig}), 1) <= 0.22)"
    return f"(length({x}) >= 240 AND len({sig}) >= 18 AND (len(list_distinct({sig})) / greatest(len({sig}), 1) <= 0.45 OR {most} >= 8 OR {run} OR {few}))"


def all_queries():
    sig = lambda s: T.significant_tokens(s)
    return [
        _claim("t01_normalize", lambda s, t: {"normalized": T.normalize(s)}, {"normalized": S.normalize("claim_statement")}),
        _claim("t03_stem", lambda s, t: {"stems": F.array_join(F.transform(T.split_words(T.normalize(s)), T.stem), " ")}, {"stems": f"array_to_string(list_transform({S.split_words(S.normalize('claim_statement'))}, lambda t: {S.stem('t')}), ' ')"}),
        _claim("t04_grams", lambda s, t: {"grams": F.array_join(F.flatten(F.transform(F.filter(T.split_words(T.normalize(s)), T.is_cjk), lambda x: F.concat(T.ngrams(x, 2), T.ngrams(x, 3)))), " ")},
               {"grams": f"coalesce(array_to_string(flatten(list_transform(list_filter({S.split_words(S.normalize('claim_statement'))}, lambda w: {S.is_cjk('w')}), lambda t: list_concat(list_transform(range(1, length(t)), lambda i: substring(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substring(t, i, 3))))), ' '), '')"}),
        _claim("t05_significant_tokens", lambda s, t: {"tokens": F.array_join(sig(s), " ")}, {"tokens": f"array_to_string({S.significant('claim_statement')}, ' ')"}),
        _claim("t06_all_tokens", lambda s, t: {"tokens": F.array_join(T.all_tokens(s), " ")}, {"tokens": f"array_to_string({S.all_tokens('claim_statement')}, ' ')"}),
        _claim("t07_numeric_tokens", lambda s, t: {"tokens": F.array_join(T.numeric_tokens(s), " ")}, {"tokens": f"array_to_string({S.numeric('claim_statement')}, ' ')"}),
        _claim("t08_anchor_tokens", lambda s, t: {"tokens": F.array_join(T.anchor_tokens(sig(s)), " ")}, {"tokens": f"array_to_string({S.anchors(S.significant('claim_statement'))}, ' ')"}),
        _claim("t09_qualifier_tokens", lambda s, t: {"tokens": F.array_join(T.qualifier_tokens(s), " ")}, {"tokens": f"array_to_string({S.qualifiers('claim_statement')}, ' ')"}),
        _claim("t14_version_tokens", lambda s, t: {"n": F.size(F.filter(F.split(F.lower(s), " "), T.is_version))}, {"n": "len(list_filter(string_split(lower(claim_statement), ' '), lambda t: regexp_matches(t, '^(v[0-9.]+|[0-9.]*\\.[0-9.]*)$')))"}),
        _block("t15_low_signal", lambda s, t: {"low": T.low_signal(t, T.split_words(T.normalize(t)))}, {"low": _low_sql("text")}),
        _block("t16_sentences", lambda s, t: {"sentences": F.array_join(T.sentences(t), "|")}, {"sentences": f"array_to_string({_sentences_sql('text')}, '|')"}),
        _block("t17_clauses", lambda s, t: {"segments": F.array_join(T.segments(t), "|")}, {"segments": f"array_to_string({_clauses_sql(_sentences_sql('text'))}, '|')"}),
        _claim("t20_duration_units", lambda s, t: {"units": F.array_join(T.duration_units(s), " ")}, {"units": f"array_to_string({_units_sql('claim_statement')}, ' ')"}),
        _block("t21_snippet", lambda s, t: {"snippet": T.snippet(t)}, {"snippet": f"CASE WHEN length({S.squeeze('text')}) > 220 THEN left({S.squeeze('text')}, 220) || '...' ELSE {S.squeeze('text')} END"}),
        _block("t22_truncate", lambda s, t: {"short": T.truncate(t, 60)}, {"short": "CASE WHEN length(text) > 60 THEN left(text, 59) || '…' ELSE text END"}),
        _block("t23_phrases", lambda s, t: {"hit": T.any_phrase(t, PHRASES)}, {"hit": " OR ".join(f"contains({S.phrase('text')}, ' {p} ')" for p in PHRASES)}),
        _block("t24_search_tokens", lambda s, t: {"tokens": F.array_join(T.search_tokens(t), " ")}, {"tokens": "array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: strlen(w) >= 3))), ' ')"}),
        _block("b13_token_estimate", lambda s, t: {"tokens": T.token_estimate(t)}, {"tokens": "cast(greatest(1, ceil(length(text) / 4)) AS INT)"}),
        _block("b18_squeeze", lambda s, t: {"text": T.squeeze(t)}, {"text": S.squeeze("text")}),
    ]


def t11_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    """T11, T13: the claim's tokens that its supporting snippet matches, and their share."""
    c = table(spark, d, "claim_outcomes", "outcome_id", "claim_statement", "primary_support_snippet.snippet").where("snippet is not null and claim_statement is not null").distinct()
    c = c.select("outcome_id", T.significant_tokens(F.col("claim_statement")).alias("a"), T.significant_tokens(F.col("snippet")).alias("b"))
    return c.select("outcome_id", F.size(T.matched(F.col("a"), F.col("b"))).alias("matched"), F.round(T.overlap_ratio(F.col("a"), F.col("b")), 6).alias("share"))


def t12_exact_sequence(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "claim_outcomes", "outcome_id", "claim_statement", "primary_support_snippet.snippet").where("snippet is not null and claim_statement is not null").distinct()
    return c.select("outcome_id", T.contains_sequence(T.all_tokens(F.col("snippet")), T.all_tokens(F.col("claim_statement"))).alias("exact"))


def t25_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Each vector whose id is divisible by 100 against all others: its nearest one and their cosine.

    The queries are the small side of a nested loop; each task keeps one running best for each query.
    """
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    few = q.limit(100_001).count() <= 100_000
    pair = e.join(F.broadcast(q) if few else q, F.col("vec_id") != F.col("query_id"))
    best = pair.select("query_id", "vec_id", F.round(T.cosine(F.col("q"), F.col("embedding")), 6).alias("cosine")).groupBy("query_id").agg(F.max(F.struct("cosine", (-F.col("vec_id")).alias("v"))).alias("m"))
    return best.select("query_id", (-F.col("m.v")).alias("nearest_id"), F.col("m.cosine").alias("cosine"))


def t28_round2(spark: SparkSession, d: str) -> DataFrame:
    """T28, E33: support score to confidence, rounded half away from zero."""
    c = table(spark, d, "claim_outcomes", "outcome_id", "support_score").where("support_score is not null").distinct()
    return c.select("outcome_id", T.round2(F.lit(0.55) + F.col("support_score") * 0.40).alias("confidence"))


def t29_visible_text(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "captures", "capture_id", "current_html").where("current_html is not null").distinct()
    return c.select("capture_id", F.length(T.strip_html(F.col("current_html"))).alias("chars"))


def t32_redact(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "captures", "capture_id", "final_url").distinct()
    return c.select("capture_id", T.redact_url(F.col("final_url")).alias("origin"))


def queries():
    return {n: f for n, f, _ in all_queries()} | {f.__name__: f for f in (t11_token_overlap, t12_exact_sequence, t25_cosine, t28_round2, t29_visible_text, t32_redact)}


def oracle_sql():
    both = "(SELECT DISTINCT outcome_id, claim_statement, primary_support_snippet.snippet AS snippet FROM claim_outcomes WHERE primary_support_snippet.snippet IS NOT NULL AND claim_statement IS NOT NULL)"
    tok = f"(SELECT outcome_id, {S.significant('claim_statement')} AS a, {S.significant('snippet')} AS b FROM {both} x)"
    pad = lambda x: f"(' ' || array_to_string({S.all_tokens(x)}, ' ') || ' ')"
    return {n: q for n, _, q in all_queries()} | {
        "t11_token_overlap": f"SELECT outcome_id, cast(len(m) AS INT) AS matched, round(CASE WHEN len(a) = 0 THEN 0.0 ELSE len(m) / len(a) END, 6) AS share FROM (SELECT *, {S.matched('a', 'b')} AS m FROM {tok} y) z",
        "t12_exact_sequence": f"SELECT outcome_id, len({S.all_tokens('claim_statement')}) > 0 AND contains({pad('snippet')}, {pad('claim_statement')}) AS exact FROM {both} x",
        "t25_cosine": """SELECT query_id, nearest_id, cosine FROM (SELECT q.vec_id AS query_id, e.vec_id AS nearest_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine,
            row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rn FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) x WHERE rn = 1""",
        "t28_round2": f"SELECT outcome_id, {S.round2('0.55::DOUBLE + support_score * 0.40::DOUBLE')} AS confidence FROM (SELECT DISTINCT outcome_id, support_score FROM claim_outcomes WHERE support_score IS NOT NULL) x",
        "t29_visible_text": r"""SELECT capture_id, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(current_html, '<script\b.*?</script\s*>', ' ', 'gis'), '<style\b.*?</style\s*>', ' ', 'gis'), '<noscript\b.*?</noscript\s*>', ' ', 'gis'), '<template\b.*?</template\s*>', ' ', 'gis'), '<[^>]*>', ' ', 'gs'), '[\s\x{0B}\x{85}\p{Z}]+', ' ', 'g'))) AS chars FROM (SELECT DISTINCT capture_id, current_html FROM captures WHERE current_html IS NOT NULL) x""",
        "t32_redact": r"SELECT capture_id, regexp_extract(final_url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin FROM (SELECT DISTINCT capture_id, final_url FROM captures) x",
    }
