"""Queries of views, diagnostics and signals of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagelore.functions import sqltext as S
from pagelore.functions import text as T
from pagelore.operators import policy as P
from pagelore.operators import views as V
from pagelore.session import table

ALLOWED = ["velmara.example", "tarnfield.example", "osperly.example"]


def blocks(spark, d):
    b = table(spark, d, "snapshot_blocks").dropDuplicates(["block_key"])
    return b.select(F.col("capture_id").alias("page"), "ord", "block_key", F.col("block_kind").alias("kind"), F.col("block_role").alias("role"), F.col("stable_ref").alias("ref"), "text", "attributes", "dom_path_hint", F.col("source_url").alias("url"), "site")


def v01_compact(spark, d):
    b = V.with_page_flags(blocks(spark, d)).where(V.keep_compact())
    return V.rendered(b, V.compact_line(), "view")


def v04_markdown(spark, d):
    return V.rendered(V.with_page_flags(blocks(spark, d)).where(V.keep_reading()), V.markdown_line(), "view")


def v05_main_markdown(spark, d):
    """The main part only; the full view where that is empty."""
    b = V.with_page_flags(blocks(spark, d))
    main, full = V.rendered(b.where(V.keep_main()), V.markdown_line(), "main"), V.rendered(b.where(V.keep_reading()), V.markdown_line(), "full")
    return full.join(main, "page", "full_outer").select("page", F.coalesce(F.nullif("main", F.lit("")), "full").alias("view"))


def v06_navigation(spark, d):
    return V.with_page_flags(blocks(spark, d)).where(V.keep_navigation()).select("block_key", "ref", "kind")


def v07_layout_zone(spark, d):
    return blocks(spark, d).select("block_key", V.layout_zone().alias("zone"))


def v08_salient(spark, d):
    return blocks(spark, d).where("text is not null").select("block_key", V.salient().alias("salient"))


def v12_diagnostics(spark, d):
    return V.diagnostics(blocks(spark, d))


def v15_envelope(spark, d):
    return V.envelope(v01_compact(spark, d), "view")


def v16_first_blocks(spark, d):
    """The first twelve blocks of each page."""
    return blocks(spark, d).groupBy("page").agg(F.min_by("ref", "ord").alias("first_ref"), F.count_if(F.col("ord") <= 12).alias("n"))


def p_signals(spark, d):
    return P.signals(blocks(spark, d), ALLOWED)


def p_page_signals(spark, d):
    """How many signals of each kind a page has."""
    s = P.signals(blocks(spark, d), ALLOWED)
    return s.groupBy("page").agg(F.count("*").alias("signals"), F.array_join(F.array_sort(F.collect_set("signal")), " ").alias("kinds"), F.count_distinct("ref").alias("refs"))


QUERIES = {"v01_compact": v01_compact, "v04_markdown": v04_markdown, "v05_main_markdown": v05_main_markdown, "v06_navigation": v06_navigation, "v07_layout_zone": v07_layout_zone, "v08_salient": v08_salient, "v12_diagnostics": v12_diagnostics, "v15_envelope": v15_envelope, "v16_first_blocks": v16_first_blocks, "policy_signals": p_signals, "policy_page_signals": p_page_signals}


def queries():
    return dict(QUERIES)


def oracle_sql():
    q = lambda ws: ", ".join(f"'{w}'" for w in ws)
    B = "(SELECT capture_id AS page, ord, block_key, block_kind AS kind, block_role AS role, stable_ref AS ref, coalesce(text, '') AS text, attributes, dom_path_hint, source_url AS url, site FROM snapshot_blocks QUALIFY row_number() OVER (PARTITION BY block_key ORDER BY ingested_at) = 1)"
    a = lambda k: f"json_extract_string(attributes, '$.{k}')"
    parts = "list_filter(list_transform(string_split(lower(dom_path_hint), ' > '), lambda p: regexp_extract(p, '^(main|nav|aside|header|footer)\\b', 1)), lambda p: p <> '')"
    zone = f"coalesce(CASE WHEN {a('zone')} IN ({q(V.LAYOUT_ZONES)}) THEN {a('zone')} END, {parts}[1], CASE WHEN role IN ('primary-nav', 'secondary-nav') THEN 'nav' END)"
    sq = S.squeeze("text")
    sal = f"(len(list_filter(string_split({sq}, ' '), lambda w: w <> '')) <= 10 OR regexp_matches(text, '[0-9$%]') OR contains(lower(text), 'rfc'))"
    trim = "regexp_replace(text, '^[\\s\\x{0B}\\x{85}\\p{Z}]+|[\\s\\x{0B}\\x{85}\\p{Z}]+$', '', 'g')"
    toc = f"(regexp_matches(lower(ref), 'table-of-contents|:toc') OR regexp_matches(lower(coalesce(dom_path_hint, '')), 'table-of-contents|#toc|toc\\.') OR lower({trim}) IN ('contents', 'table of contents') OR coalesce(kind = 'link' AND starts_with({a('href')}, '#'), false))"
    flags = f"f AS (SELECT *, bool_or(kind = 'heading') OVER (PARTITION BY page) AS has_heading, bool_or(coalesce({zone} = 'main', false)) OVER (PARTITION BY page) AS has_main FROM {B} b)"
    compact = f"CASE WHEN kind = 'metadata' THEN NOT has_heading WHEN kind IN ('heading', 'table') THEN true WHEN kind = 'text' THEN {sal} WHEN kind = 'list' THEN role IN ('content', 'supporting') OR {sal} WHEN kind = 'link' THEN role IN ('content', 'cta') AND {sal} WHEN kind = 'button' THEN role = 'cta' AND {sal} ELSE false END"
    read = f"(NOT {toc} AND NOT (has_heading AND kind = 'metadata') AND CASE WHEN kind IN ('heading', 'table') THEN true WHEN kind = 'text' THEN {sal} WHEN kind = 'list' THEN role IN ('content', 'supporting') OR {sal} WHEN kind = 'link' THEN role = 'content' AND {sal} ELSE false END)"
    main = f"({read} AND CASE WHEN has_main THEN coalesce({zone} = 'main', false) ELSE NOT coalesce({zone} IN ('nav', 'aside', 'header', 'footer'), false) END)"
    level = f"greatest(1, least(6, coalesce(CAST({a('level')} AS INT), 1)))"
    href = f"regexp_extract(trim(lower(regexp_replace(trim({a('href')}), '^https?://', '')), '/'), '^([^/]*)', 1)"
    code = "CASE kind WHEN 'heading' THEN 'h' || " + level + " " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in V.KIND_CODES.items()) + " END"
    mark = f"CASE WHEN kind = 'link' AND NOT starts_with({a('href')}, '#') AND {href} <> '' THEN '@' || {href} WHEN kind = 'input' THEN '=' || {a('inputType')} WHEN kind = 'table' THEN CASE WHEN {a('rows')} IS NOT NULL AND {a('columns')} IS NOT NULL THEN {a('rows')} || 'x' || {a('columns')} WHEN {a('rows')} IS NOT NULL THEN 'r' || {a('rows')} WHEN {a('columns')} IS NOT NULL THEN 'c' || {a('columns')} END END"
    digest = f"CASE WHEN kind IN ('heading', 'link', 'button', 'input') THEN {sq} ELSE array_to_string(string_split({sq}, ' ')[1:12], ' ') END"
    cline = f"concat_ws(' ', {code}, {mark}, nullif({digest}, ''))"
    mline = f"CASE WHEN kind = 'heading' THEN repeat('#', {level}) || ' ' || {sq} WHEN kind = 'link' THEN '[' || {sq} || '](' || coalesce({a('href')}, '') || ')' WHEN kind IN ('list', 'table') THEN {trim} ELSE {sq} END"
    view = lambda keep, line, out: f"SELECT page, string_agg({line}, chr(10) ORDER BY ord, {line}) AS {out} FROM f WHERE {keep} GROUP BY page"
    n = lambda k: f"count(*) FILTER (kind = '{k}') AS {k}s"
    text = f"concat_ws(' ', text, {a('name')}, {a('inputType')}, {a('href')}, {a('tagName')}, {a('zone')})"
    norm = lambda p: " ".join("".join(c if c.isalnum() else " " for c in p.lower()).split())
    hit = lambda ps: f"regexp_matches(pt, ' (?:{'|'.join(sorted(map(norm, ps)))}) ')"
    host = lambda u: f"lower(nullif(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), ''))"
    ok = lambda h: "(" + " OR ".join(f"{h} = '{x}' OR ends_with({h}, '.{x}')" for x in ALLOWED) + ")"
    th = f"CASE WHEN regexp_matches({a('href')}, '^(?:mailto:|tel:|#)') THEN NULL WHEN starts_with({a('href')}, '/') THEN {host('url')} ELSE {host(a('href'))} END"
    sig = f"""s0 AS (SELECT *, {S.phrase(text)} AS pt, bool_or(kind IN ({q(P.INTERACTIVE)})) OVER (PARTITION BY page) AS surface, {th} AS th FROM (SELECT * REPLACE (nullif(text, '') AS text) FROM {B}) b),
        sg AS (SELECT page, ref, 'bot-challenge' AS signal FROM s0 WHERE surface AND {hit(P.BOT)}
        UNION ALL SELECT page, ref, 'mfa-challenge' FROM s0 WHERE surface AND kind IN ({q(P.SPOKEN)}) AND {hit(P.MFA)}
        UNION ALL SELECT page, ref, 'sensitive-auth-flow' FROM s0 WHERE surface AND (coalesce(lower({a('inputType')}) = 'password', false) OR (kind = 'link' AND {hit(P.AUTH_LINK)}) OR (kind IN ({q(P.SPOKEN)}) AND {hit(P.AUTH)}))
        UNION ALL SELECT page, ref, 'high-risk-write' FROM s0 WHERE kind IN ({q(P.INTERACTIVE)}) AND {hit(P.WRITE)}
        UNION ALL SELECT page, ref, 'domain-not-allowlisted' FROM s0 WHERE th IS NOT NULL AND NOT {ok('th')}
        UNION ALL SELECT DISTINCT page, NULL, 'domain-not-allowlisted' FROM s0 WHERE {host('url')} IS NOT NULL AND NOT {ok(host('url'))})"""
    shell = "(content_chars < 200 AND headings + texts <= 2)"
    return {
        "v01_compact": f"WITH {flags} {view(compact, cline, 'view')}",
        "v04_markdown": f"WITH {flags} {view(read, mline, 'view')}",
        "v05_main_markdown": f"WITH {flags}, m AS ({view(main, mline, 'main')}), u AS ({view(read, mline, 'full_')}) SELECT coalesce(u.page, m.page) AS page, coalesce(nullif(main, ''), full_) AS view FROM u FULL JOIN m ON u.page = m.page",
        "v06_navigation": f"SELECT block_key, ref, kind FROM {B} b WHERE role IN ('primary-nav', 'secondary-nav', 'cta', 'form-control') OR kind IN ('link', 'button', 'input')",
        "v07_layout_zone": f"SELECT block_key, {zone} AS zone FROM {B} b",
        "v08_salient": f"SELECT block_key, {sal} AS salient FROM {B} b WHERE block_key IN (SELECT block_key FROM snapshot_blocks WHERE text IS NOT NULL)",
        "v12_diagnostics": f"""SELECT *, CASE WHEN {shell} THEN 'poor' WHEN nav_blocks * 2 > blocks OR content_chars < 600 THEN 'fair' ELSE 'good' END AS quality, CASE WHEN {shell} THEN 'shell' WHEN nav_blocks * 2 > blocks THEN 'mostly-navigation' WHEN content_chars < 600 THEN 'thin' END AS reason
            FROM (SELECT page, count(*) AS blocks, {n('heading')}, {n('text')}, {n('list')}, {n('table')}, {n('link')}, {n('button')}, {n('input')}, count(*) FILTER (coalesce({zone} = 'main', false)) AS main_blocks,
            CAST(sum(CASE WHEN role = 'content' THEN length(text) ELSE 0 END) AS BIGINT) AS content_chars, count(*) FILTER (role IN ('primary-nav', 'secondary-nav')) AS nav_blocks FROM {B} b GROUP BY page) x""",
        "v15_envelope": f"WITH {flags}, v AS ({view(compact, cline, 'view')}) SELECT page, CAST(len(string_split(view, chr(10))) AS INT) AS lines, CAST(length(view) AS INT) AS chars, CAST(greatest(1, ceil(length(view) / 4)) AS INT) AS tokens FROM v",
        "v16_first_blocks": f"SELECT page, arg_min(ref, ord) AS first_ref, count(*) FILTER (ord <= 12) AS n FROM {B} b GROUP BY page",
        "policy_signals": f"WITH {sig} SELECT * FROM sg",
        "policy_page_signals": f"WITH {sig} SELECT page, count(*) AS signals, array_to_string(list_sort(list(DISTINCT signal)), ' ') AS kinds, count(DISTINCT ref) AS refs FROM sg GROUP BY page",
    }
