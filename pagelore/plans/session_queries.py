"""Queries of search, sessions, telemetry and metrics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.functions import sqltext as S
from pagelore.functions import text as T
from pagelore.operators import search as Q
from pagelore.operators import sessions as M
from pagelore.session import table


def blocks(spark, d):
    b = table(spark, d, "snapshot_blocks").dropDuplicates(["block_key"])
    return b.select(F.col("capture_id").alias("page"), "ord", F.col("block_kind").alias("kind"), F.col("block_role").alias("role"), F.col("stable_ref").alias("ref"), "text", "attributes", F.col("source_url").alias("url"))


def outcomes(spark, d):
    return table(spark, d, "claim_outcomes").dropDuplicates(["outcome_id"])


def snapshots(spark, d):
    r = table(spark, d, "ref_index")
    o = r.groupBy("page_id", "snapshot_id").agg(F.min("taken_at").alias("taken_at"), F.max("source_url").alias("source_url"))
    return o.withColumn("turn", F.row_number().over(W.partitionBy("page_id").orderBy("taken_at", "snapshot_id")))


def q01_results(spark, d):
    return Q.results(blocks(spark, d)).select("page", "rank", "title", "target", "domain", "ref")


def q03_merge(spark, d):
    r = Q.results(blocks(spark, d)).select("page", "rank", "title", "target")
    return Q.merge(r.where("rank % 2 = 1"), r).select("page", "rank", "title", "target")


def q04_canonical(spark, d):
    c = table(spark, d, "captures", "capture_id", "final_url").distinct()
    return c.select("capture_id", Q.canonical_url(F.concat("final_url", F.when(F.col("final_url").contains("?"), "&utm_source=x&k=1").otherwise("?utm_source=x&k=1"))).alias("url"))


def q06_snippets(spark, d):
    return Q.snippets(blocks(spark, d))


def q08_recommend(spark, d):
    s = Q.selection(Q.results(blocks(spark, d)), F.lit("download release notes guide")).where("recommended")
    return s.select("page", "place", "target", "score", "official")


def q13_profile_runs(spark, d):
    s = table(spark, d, "search_profile_state").dropDuplicates(["state_id"])
    return Q.profile_runs(s, ["search_engine", "profile_dir"], "recorded_at", "consecutive_challenges")


def m01_diff_counts(spark, d):
    """Refs that a snapshot shares with the one before it, by set operations on arrays."""
    r = table(spark, d, "ref_index").groupBy("page_id", "snapshot_id").agg(F.min("taken_at").alias("taken_at"), F.collect_set("stable_ref").alias("refs"))
    w = W.partitionBy("page_id").orderBy("taken_at", "snapshot_id")
    r = r.withColumn("before", F.lag("refs").over(w)).where("before is not null")
    return r.select("page_id", "snapshot_id", F.size(F.array_except("refs", "before")).alias("added"), F.size(F.array_except("before", "refs")).alias("removed"), F.size(F.array_intersect("refs", "before")).alias("retained"))


def m02_compaction(spark, d):
    """The first six salient refs of each snapshot."""
    r = table(spark, d, "ref_index").where(F.col("block_kind").isin(M.SALIENT)).withColumn("o", F.regexp_extract("block_id", "([0-9]+)$", 1).cast("int"))
    r = r.groupBy("snapshot_id", "stable_ref").agg(F.min("o").alias("o"))
    return r.withColumn("place", F.row_number().over(W.partitionBy("snapshot_id").orderBy("o", "stable_ref"))).where("place <= 6").select("snapshot_id", "stable_ref", "place")


def m05_working_sets(spark, d):
    r = table(spark, d, "ref_index").withColumn("o", F.coalesce(F.regexp_extract("block_id", "([0-9]+)$", 1).try_cast("int"), F.lit(0)))
    r = r.join(snapshots(spark, d).select("snapshot_id", "turn"), "snapshot_id")
    return M.working_sets(r, "page_id", "turn", "stable_ref", "block_kind", "o")


def m04_turn_summary(spark, d):
    t = m05_working_sets(spark, d).join(snapshots(spark, d).select("page_id", "turn", "source_url"), ["page_id", "turn"])
    return M.turn_summary(t, "page_id", "turn", "source_url", "kept").drop("urls")


def m06_append_snapshot(spark, d):
    s = snapshots(spark, d)
    return s.select("snapshot_id", F.concat_ws("_", F.lit("snap"), "page_id", "turn").alias("id"))


def m07_transcript(spark, d):
    return M.journal(table(spark, d, "events", "event_id", "user_id", "ts", "event_type"), "user_id", ["ts", "event_id"]).select("user_id", "seq", "event_id", "event_type")


def m09_synthesis(spark, d):
    s = M.synthesize(outcomes(spark, d), "page_id")
    return s.select("page_id", "claim_statement", "status", F.array_join(F.transform("snapshots", lambda x: x.cast("string")), " ").alias("snapshots"), F.array_join("refs", " ").alias("refs"), F.array_join("urls", " ").alias("urls"), "asked")


def m10_site_synthesis(spark, d):
    """A second level over the pages of a host: true maximum of the states."""
    s = M.synthesize(outcomes(spark, d).withColumn("host", F.regexp_extract("source_url", "^[a-z]+://([^/]+)", 1)), "host")
    return s.groupBy("host").agg(F.count("*").alias("claims"), *[F.count_if(F.col("status") == k).alias(k.replace("-", "_")) for k in M.PRIORITY])


def m11_commands(spark, d):
    """Events as commands of an interpreter that only reads: what is run, what is refused."""
    e = table(spark, d, "events", "event_id", "event_type")
    verb = F.when(F.col("event_type") == "view", "read").when(F.col("event_type") == "click", "follow").when(F.col("event_type") == "signup", "submit").when(F.col("event_type") == "purchase", "submit").otherwise("unknown")
    return e.select("event_id", verb.alias("command"), F.when(verb.isin("read", "follow"), "done").when(verb == "submit", "unsupported-action").otherwise("invalid-input").alias("result"))


def m13_prefill(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type", "value")
    return M.last_values(e, ["user_id"], "event_type", ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def l02_ordinal(spark, d):
    r = table(spark, d, "snapshot_blocks", "block_key", "stable_ref").distinct()
    n = F.regexp_extract("stable_ref", ":([0-9]+)$", 1)
    return r.select("block_key", F.when(n != "", n.try_cast("int")).otherwise(1).alias("ordinal"))


def l03_pages(spark, d):
    """A pagination counter that never falls below 1: clicks go on, errors go back."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type").where("event_type in ('click', 'error')")
    step = F.when(F.col("event_type") == "click", 1).otherwise(-1)
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    x = e.withColumn("sum", F.sum(step).over(w))
    # a walk that is held at 1 is the free walk lifted by its lowest point so far
    return x.withColumn("low", F.least(F.lit(0), F.min("sum").over(w))).select("event_id", (F.lit(1) + F.col("sum") - F.col("low")).alias("page"))


def telemetry_summary(spark, d):
    """T-1: events, users, the last time, and counts by type in one pass over grouping sets."""
    e = table(spark, d, "events", "event_id", "user_id", "ts", "event_type")
    return e.groupingSets([["event_type"], []], "event_type").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.max("ts").alias("last_at"))


def telemetry_recent(spark, d):
    """T-2: the last fifty events."""
    return table(spark, d, "events", "event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(50)


def telemetry_fields(spark, d):
    """T31: the first of several JSON paths that holds a value."""
    e = table(spark, d, "events", "event_id", "props")
    return e.select("event_id", F.coalesce(F.get_json_object("props", "$.kind"), F.get_json_object("props", "$.k"), F.get_json_object("props", "$.payload.k")).alias("k"))


def x01_citation_metrics(spark, d):
    """Precision and recall of the given verdicts against the latest one of the same claim; 1 where nothing is counted."""
    c = outcomes(spark, d)
    last = F.first("verdict").over(W.partitionBy("page_id", "claim_statement").orderBy(F.desc("generated_at"), F.desc("outcome_id")))
    x = c.withColumn("truth", last)
    t, s = F.col("truth") == "evidence-supported", F.col("verdict") == "evidence-supported"
    ratio = lambda a, b: F.round(F.when(b == 0, 1.0).otherwise(a / b), 6)
    return x.groupBy(F.regexp_extract("source_url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(ratio(F.count_if(t & s), F.count_if(s)).alias("precision"), ratio(F.count_if(t & s), F.count_if(t)).alias("recall"), ratio(F.count_if(s & (F.col("citation.url") != "")), F.count_if(s)).alias("cited"))


def x02_observation_metrics(spark, d):
    """How much smaller visible text is than html, over captures: mean, least, upper median."""
    c = table(spark, d, "captures", "capture_id", "visible_text", "current_html").where("current_html <> '' and visible_text <> ''").distinct()
    r = c.select((F.length("current_html") / F.length("visible_text")).alias("r"))
    a = r.agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.min("r"), 6).alias("least"), F.round(F.expr("percentile_disc(0.5) within group (order by r)"), 6).alias("median"), F.count("*").alias("n"))
    return a


def x04_band_metrics(spark, d):
    c = outcomes(spark, d)
    return c.groupBy("confidence_band").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "evidence-supported").alias("supported"), F.round(F.avg(F.coalesce("review_recommended", F.lit(False)).cast("int")), 6).alias("review_rate"))


def x05_surfaces(spark, d):
    """Average tokens of html, visible text and blocks of a site's captures."""
    c = table(spark, d, "captures").dropDuplicates(["capture_id"]).select("capture_id", "site", F.ceil(F.length("current_html") / 4).alias("h"), F.ceil(F.length("visible_text") / 4).alias("v"))
    b = table(spark, d, "snapshot_blocks").dropDuplicates(["block_key"]).groupBy("capture_id").agg(F.sum("token_cost").alias("b"))
    return c.join(b, "capture_id", "left").groupBy("site").agg(*[F.round(F.avg(x), 4).alias(n) for x, n in (("h", "html"), ("v", "visible"), ("b", "blocks"))], F.count("*").alias("captures"))


def x08_choice_rate(spark, d):
    """The share of a page's controls that a reader need not look at."""
    b = blocks(spark, d).where(F.col("kind").isin("link", "button", "input")).groupBy("page").agg(F.count("*").alias("n"))
    return b.select("page", F.round((F.col("n") - 1) / F.col("n"), 6).alias("rate"))


def x10_readiness(spark, d):
    """The mean of yes-or-no checks on a capture."""
    c = table(spark, d, "captures").dropDuplicates(["capture_id"])
    checks = [F.col("title").isNotNull(), F.col("current_html").isNotNull(), F.length("visible_text") >= 200, F.col("link_count") > 0, F.col("final_url").startswith("https://"), F.col("ingested_at") <= F.col("captured_at") + F.expr("interval 1 day")]
    return c.select("capture_id", F.round(sum((F.coalesce(x, F.lit(False)).cast("int") for x in checks), F.lit(0)) / len(checks), 6).alias("score"))


QUERIES = [q01_results, q03_merge, q04_canonical, q06_snippets, q08_recommend, q13_profile_runs, m01_diff_counts, m02_compaction, m04_turn_summary, m05_working_sets, m06_append_snapshot, m07_transcript, m09_synthesis, m10_site_synthesis, m11_commands, m13_prefill, l02_ordinal, l03_pages, telemetry_summary, telemetry_recent, telemetry_fields, x01_citation_metrics, x02_observation_metrics, x04_band_metrics, x05_surfaces, x08_choice_rate, x10_readiness]


def queries():
    return {f.__name__: f for f in QUERIES}


def oracle_sql():
    q = lambda ws: ", ".join(f"'{w}'" for w in ws)
    O = "(SELECT * FROM claim_outcomes QUALIFY row_number() OVER (PARTITION BY outcome_id ORDER BY ingested_at) = 1)"
    B = "(SELECT capture_id AS page, ord, block_kind AS kind, block_role AS role, stable_ref AS ref, text, attributes, source_url AS url FROM snapshot_blocks QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY ingested_at) = 1)"
    P = "(SELECT * FROM captures QUALIFY row_number() OVER (PARTITION BY capture_id ORDER BY ingested_at) = 1)"
    href = "json_extract_string(attributes, '$.href')"

    def canon(u):
        u = f"regexp_replace(regexp_replace(regexp_replace({u}, '#.*$', ''), '([?&])(?:{Q.TRACKING})=[^&]*&?', '\\1', 'gi'), '[?&]$', '')"
        o = f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)"
        return f"regexp_replace(lower({o}) || substring({u}, length({o}) + 1), '/$', '')"

    full = f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {href} ELSE regexp_replace(url, '[^/]*$', '') || {href} END"
    title = S.squeeze("regexp_replace(text, '^.*›', '')")
    first = f"SELECT page, ord, ref, {title} AS title, {canon(full)} AS target FROM {B} b WHERE kind = 'link' AND role NOT IN ('primary-nav', 'secondary-nav', 'cta', 'form-control') AND {href} IS NOT NULL AND strlen({title}) >= 6"
    res = f"""res AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY ord, ref) AS rank, regexp_replace(lower(regexp_extract(target, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)), '^www\\.', '') AS domain
        FROM (SELECT * FROM ({first}) x QUALIFY row_number() OVER (PARTITION BY page, target ORDER BY ord, ref) = 1) y)"""
    toks = "['download', 'guide', 'notes', 'release']"
    official = f"(regexp_matches(domain, '{Q.OFFICIAL}') OR len(list_filter({toks}, lambda t: contains(domain, t))) > 0)"
    score = S.round2(f"least(1.0, 0.6::DOUBLE / rank + CASE WHEN {official} THEN 0.25::DOUBLE ELSE 0 END + len(list_filter({toks}, lambda t: contains(lower(title), t))) / 4 * 0.15::DOUBLE)")
    turns = "tn AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY taken_at, snapshot_id) AS turn FROM (SELECT page_id, snapshot_id, min(taken_at) AS taken_at FROM ref_index GROUP BY 1, 2) x)"
    rank = "CASE verdict " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in M.PRIORITY.items()) + " END"
    syn = lambda key, src: f"SELECT {key}, claim_statement, arg_max(verdict, {rank}) AS status, list_sort(list(DISTINCT capture_id)) AS snapshots, list_sort(list_distinct(flatten(list(coalesce(support, []))))) AS refs, list_sort(list(DISTINCT citation.url) FILTER (citation.url IS NOT NULL)) AS urls, count(*) AS asked FROM {src} GROUP BY ALL"
    host = "regexp_extract(source_url, '^[a-z]+://([^/]+)', 1)"
    ratio = lambda a, b: f"round(CASE WHEN {b} = 0 THEN 1.0 ELSE {a} / {b} END, 6)"
    n = lambda c: f"count(*) FILTER ({c})"
    return {
        "q01_results": f"WITH {res} SELECT page, rank, title, target, domain, ref FROM res",
        "q03_merge": f"WITH {res} SELECT page, row_number() OVER (PARTITION BY page ORDER BY rank % 2 DESC, rank) AS rank, title, target FROM res",
        "q04_canonical": f"SELECT capture_id, {canon('u')} AS url FROM (SELECT DISTINCT capture_id, final_url || CASE WHEN contains(final_url, '?') THEN '&utm_source=x&k=1' ELSE '?utm_source=x&k=1' END AS u FROM captures) x",
        "q08_recommend": f"WITH {res} SELECT page, place, target, score, official FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, official DESC, rank) AS place FROM (SELECT *, {score} AS score, {official} AS official FROM res) y) z WHERE place <= 3",
        "q13_profile_runs": """SELECT search_engine, profile_dir, bad, min(recorded_at) AS first_at, max(recorded_at) AS last_at, count(*) AS states, max(consecutive_challenges) AS most FROM (SELECT *, row_number() OVER (PARTITION BY search_engine, profile_dir ORDER BY recorded_at, state_id)
            - row_number() OVER (PARTITION BY search_engine, profile_dir, bad ORDER BY recorded_at, state_id) AS island FROM (SELECT *, coalesce(consecutive_challenges, 0) > 0 AS bad FROM search_profile_state QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY recorded_at) = 1) x) y GROUP BY search_engine, profile_dir, bad, island""",
        "m01_diff_counts": """SELECT page_id, snapshot_id, CAST(len(list_filter(refs, lambda r: NOT list_contains(b, r))) AS INT) AS added, CAST(len(list_filter(b, lambda r: NOT list_contains(refs, r))) AS INT) AS removed, CAST(len(list_intersect(refs, b)) AS INT) AS retained
            FROM (SELECT *, lag(refs) OVER (PARTITION BY page_id ORDER BY taken_at, snapshot_id) AS b FROM (SELECT page_id, snapshot_id, min(taken_at) AS taken_at, list(DISTINCT stable_ref) AS refs FROM ref_index GROUP BY 1, 2) x) y WHERE b IS NOT NULL""",
        "m02_compaction": f"""SELECT * FROM (SELECT snapshot_id, stable_ref, row_number() OVER (PARTITION BY snapshot_id ORDER BY o, stable_ref) AS place FROM (SELECT snapshot_id, stable_ref, min(CAST(regexp_extract(block_id, '([0-9]+)$', 1) AS INT)) AS o FROM ref_index WHERE block_kind IN ({q(M.SALIENT)}) GROUP BY 1, 2) x) y WHERE place <= 6""",
        "m06_append_snapshot": f"WITH {turns} SELECT snapshot_id, 'snap_' || page_id || '_' || turn AS id FROM tn",
        "m07_transcript": "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, event_type FROM events",
        "m09_synthesis": f"SELECT page_id, claim_statement, status, array_to_string(snapshots, ' ') AS snapshots, array_to_string(refs, ' ') AS refs, coalesce(array_to_string(urls, ' '), '') AS urls, asked FROM ({syn('page_id', O + ' o')}) s",
        "m10_site_synthesis": f"SELECT host, count(*) AS claims, {', '.join(n(f'status = {chr(39)}{k}{chr(39)}') + ' AS ' + k.replace('-', '_') for k in M.PRIORITY)} FROM ({syn('host', f'(SELECT *, {host} AS host FROM {O} o) p')}) s GROUP BY host",
        "m11_commands": "SELECT event_id, CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'follow' WHEN 'signup' THEN 'submit' WHEN 'purchase' THEN 'submit' ELSE 'unknown' END AS command, CASE WHEN event_type IN ('view', 'click') THEN 'done' WHEN event_type IN ('signup', 'purchase') THEN 'unsupported-action' ELSE 'invalid-input' END AS result FROM events",
        "m13_prefill": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
        "l02_ordinal": "SELECT block_key, coalesce(TRY_CAST(nullif(regexp_extract(stable_ref, ':([0-9]+)$', 1), '') AS INT), CASE WHEN regexp_extract(stable_ref, ':([0-9]+)$', 1) = '' THEN 1 END) AS ordinal FROM (SELECT DISTINCT block_key, stable_ref FROM snapshot_blocks) x",
        "l03_pages": "SELECT event_id, CAST(1 + s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS BIGINT) AS page FROM (SELECT *, sum(CASE WHEN event_type = 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM events WHERE event_type IN ('click', 'error')) x",
        "telemetry_summary": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(ts) AS last_at FROM events GROUP BY GROUPING SETS ((event_type), ())",
        "telemetry_recent": "SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 50",
        "telemetry_fields": "SELECT event_id, coalesce(json_extract_string(props, '$.kind'), json_extract_string(props, '$.k'), json_extract_string(props, '$.payload.k')) AS k FROM events",
        "x01_citation_metrics": f"""SELECT host, {ratio(n('t AND s'), n('s'))} AS precision, {ratio(n('t AND s'), n('t'))} AS recall, {ratio(n("s AND citation.url <> ''"), n('s'))} AS cited FROM (SELECT {host} AS host, citation, verdict = 'evidence-supported' AS s,
            first_value(verdict) OVER (PARTITION BY page_id, claim_statement ORDER BY generated_at DESC, outcome_id DESC) = 'evidence-supported' AS t FROM {O} o) x GROUP BY host""",
        "x02_observation_metrics": "SELECT round(avg(r), 6) AS mean, round(min(r), 6) AS least, round(quantile_disc(r, 0.5), 6) AS median, count(*) AS n FROM (SELECT length(current_html) / length(visible_text) AS r FROM (SELECT DISTINCT capture_id, visible_text, current_html FROM captures WHERE current_html <> '' AND visible_text <> '') x) y",
        "x04_band_metrics": f"SELECT confidence_band, count(*) AS n, {n(chr(118) + 'erdict = ' + chr(39) + 'evidence-supported' + chr(39))} AS supported, round(avg(CAST(coalesce(review_recommended, false) AS INT)), 6) AS review_rate FROM {O} o GROUP BY 1",
        "x05_surfaces": f"""SELECT site, round(avg(h), 4) AS html, round(avg(v), 4) AS visible, round(avg(b), 4) AS blocks, count(*) AS captures FROM (SELECT capture_id, site, ceil(length(current_html) / 4) AS h, ceil(length(visible_text) / 4) AS v FROM {P} p) c
            LEFT JOIN (SELECT capture_id, sum(token_cost) AS b FROM (SELECT DISTINCT block_key, capture_id, token_cost FROM snapshot_blocks) x GROUP BY 1) b USING (capture_id) GROUP BY site""",
        "x08_choice_rate": f"SELECT page, round((count(*) - 1) / count(*), 6) AS rate FROM {B} b WHERE kind IN ('link', 'button', 'input') GROUP BY page",
        "x10_readiness": f"SELECT capture_id, round((CAST(title IS NOT NULL AS INT) + CAST(current_html IS NOT NULL AS INT) + CAST(coalesce(length(visible_text) >= 200, false) AS INT) + CAST(coalesce(link_count > 0, false) AS INT) + CAST(coalesce(starts_with(final_url, 'https://'), false) AS INT) + CAST(coalesce(ingested_at <= captured_at + INTERVAL 1 DAY, false) AS INT)) / 6, 6) AS score FROM {P} p",
    }
