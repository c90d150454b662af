"""Guards over the support of a claim: numbers, scope, release status and qualifiers must be those of the claim.

A claim's support is at most a few passages, kept as one array; every guard is a native expression over it and says 'ok', 'fails'
(the claim is not supported by it) or 'contradicts'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.functions import lexicon as L
from pagelore.functions import text as T

OK, FAILS, CONTRADICTS = "ok", "fails", "contradicts"


def profile(tokens: Column, words: dict[str, str]) -> Column:
    """The first profile one of whose words is among the tokens, or null."""
    out = F.lit(None).cast("string")
    for name, ws in reversed(words.items()):
        out = F.when(F.arrays_overlap(tokens, T.words(*ws.split())), name).otherwise(out)
    return out


def qualifier_of(text: Column) -> Column:
    """default, maximum or minimum, whichever a text speaks of first in this order; null if of none."""

    def of(n: Column) -> Column:
        has = lambda *ps: F.array_contains(F.transform(F.array(*[F.lit(f" {p} ") for p in ps]), n.contains), True)
        tokens = T.all_tokens(n)
        one = lambda p, *ws: has(*p) | F.arrays_overlap(tokens, T.words(*ws))
        return F.when(one(["default"], "default"), "default").when(one(["at most", "up to"], "maximum", "max"), "maximum").when(one(["at least"], "minimum", "min"), "minimum")

    return T.let(F.concat(F.lit(" "), T.normalize(text), F.lit(" ")), of)


def numbers_of(text: Column) -> Column:
    """The numbers of a text, each with the unit or month after it (null without one), once each."""

    def of(ws: Column) -> Column:
        unit = lambda i: F.coalesce(T.unit_of(F.get(ws, i + 1)), F.when(T.month_of(F.get(ws, i + 1)).isNotNull(), "month"))
        return F.array_distinct(F.filter(F.transform(ws, lambda w, i: F.struct(w.alias("value"), unit(i).alias("unit"))), lambda e: e["value"].rlike("^[0-9]+$")))

    return T.let(T.split_words(T.normalize(text)), of)


def against(claim: Column, support: Column, pairs: list[tuple[str, str]], explicit: list[str]) -> Column:
    """A profile of the claim against that of its support."""
    clash = F.lit(False)
    for a, b in pairs:
        clash = clash | ((claim == a) & (support == b))
    return F.when(clash, CONTRADICTS).when(claim.isin(explicit) & support.isNull(), FAILS).otherwise(OK)


def numeric(statement: Column, tokens: Column, claim_numbers: Column, kind: Column, anchors: Column, parts: Column, text: Column) -> Column:
    """The claim's numbers against those of the passages that share its qualifier, anchors and units. `parts` are structs (kind,
    said, text, qualifier, numbers, in_block). Claims about versions and releases are passed over."""
    version = F.exists(tokens, lambda t: t.isin(L.RELEASE_WORDS) | T.is_version(t)) | F.exists(F.split(statement, r"\s+"), lambda t: F.regexp_replace(t, "^[,.;:]+|[,.;:]+$", "").rlike(r"^v?[0-9.]*\.[0-9.]*$"))
    unit = F.exists(claim_numbers, lambda e: e["unit"].isNotNull())
    alike = F.filter(parts, lambda p: p["qualifier"] == kind)
    prose = F.filter(alike, lambda p: p["kind"] == "text")
    primary = F.when(F.size(prose) > 0, prose).when(F.size(alike) > 0, alike).otherwise(parts)
    near = lambda ps: F.filter(ps, lambda p: ((F.size(anchors) == 0) | (F.size(T.matched(anchors, T.significant_tokens(p["said"]))) > 0)) & (~unit | F.exists(p["numbers"], lambda e: e["unit"].isNotNull())))

    def judged(ps: Column) -> Column:
        return T.let(F.when(F.size(ps) > 0, F.array_distinct(F.flatten(F.transform(ps, lambda p: p["numbers"])))).otherwise(numbers_of(text)), lambda have: verdict(ps, have))

    def verdict(ps: Column, have: Column) -> Column:
        same = lambda a, b: (a["value"] == b["value"]) & F.coalesce(a["unit"] == b["unit"], F.lit(True))
        match = F.forall(claim_numbers, lambda a: F.exists(have, lambda b: same(a, b)))
        n = F.size(claim_numbers)
        precise = F.exists(ps, lambda p: p["kind"].isin("text", "heading", "table", "list", "metadata") & (p["in_block"] <= n + 3))
        hard = precise & (F.size(have) <= n + 4) & (~unit | F.exists(have, lambda e: e["unit"].isNotNull()))
        return F.when(F.size(have) == 0, FAILS).when(match, OK).when(hard, CONTRADICTS).otherwise(FAILS)

    def chosen(first: Column) -> Column:
        other = F.when((F.size(first) == 0) & (F.coalesce(kind, F.lit("")) != "default") & (F.size(primary) != F.size(parts)), near(parts)).otherwise(first)
        return T.let(other, lambda ps: T.let(F.when(F.size(ps) > 0, ps).otherwise(primary), judged))

    return F.when(version | (F.size(claim_numbers) == 0), OK).otherwise(T.let(near(primary), chosen))


def guarded(claims: DataFrame, top: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, claim and the outcome of each guard (scope, status, qualifier, numeric) for claims with support.

    `claims` are prepared claims, `top` their best passages, `blocks` prepared blocks. The text of the support is the page's
    first heading, then each passage and the heading above it, once each. Claims without support have no row.
    """
    head = blocks.where("kind = 'heading'").groupBy("page").agg(F.min_by("search", F.struct(F.coalesce(F.col("level") != 1, F.lit(True)), "ord")).alias("first_heading"))
    above = blocks.select("page", "ord", F.col("heading.search").alias("above"))
    t = top.select("page", "claim", "ord", "place", "kind", "passage_search", "text").join(above, ["page", "ord"])
    said = F.filter(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "passage_search", "above"))), lambda x: F.array(x["passage_search"], x["above"]))), lambda s: s.isNotNull())
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "kind", "passage_search", "text"))), lambda x: F.struct(x["kind"].alias("kind"), x["passage_search"].alias("passage"), x["text"].alias("text")))
    s = t.groupBy("page", "claim").agg(said.alias("said"), parts.alias("parts")).join(head, "page", "left")
    s = s.withColumn("support_text", F.array_join(F.array_distinct(F.filter(F.concat(F.array("first_heading"), F.col("said")), lambda x: x.isNotNull())), " "))
    x = claims.select("page", "claim", "statement", "sequence", "claim_tokens", "anchors", "qualifiers").join(s.drop("said", "first_heading"), ["page", "claim"])
    x = x.withColumns({"kind": qualifier_of(F.col("statement")), "claim_numbers": numbers_of(F.col("statement")), "all": T.all_tokens(F.col("support_text"))})
    own = lambda p: F.when(F.col("kind").isNotNull() & qualifier_of(p["passage"]).isNull(), p["text"]).otherwise(p["passage"])
    full = lambda p: T.let(own(p), lambda t: F.struct(p["kind"].alias("kind"), t.alias("said"), qualifier_of(t).alias("qualifier"), numbers_of(t).alias("numbers"), F.size(numbers_of(p["text"])).alias("in_block")))
    x = x.withColumn("parts", F.transform("parts", full))
    covered = (F.size("qualifiers") == 0) | F.exists("parts", lambda p: F.size(T.matched(F.col("qualifiers"), T.all_tokens(p["said"]))) == F.size("qualifiers"))
    qualifier = F.when(F.when(F.col("kind").isNull(), covered).otherwise(F.exists("parts", lambda p: p["qualifier"] == F.col("kind"))), OK).otherwise(FAILS)
    return x.select(
        "page", "claim",
        against(profile(F.col("sequence"), L.SCOPES), profile(F.col("all"), L.SCOPES), L.SCOPE_CLASHES, ["universal", "exclusive"]).alias("scope"),
        against(profile(F.col("sequence"), L.STATUSES), profile(F.col("all"), L.STATUSES), L.STATUS_CLASHES, ["preview", "available"]).alias("status"),
        qualifier.alias("qualifier"),
        numeric(F.col("statement"), F.col("claim_tokens"), F.col("claim_numbers"), F.col("kind"), F.col("anchors"), F.col("parts"), F.col("support_text")).alias("numeric"),
        (profile(F.col("sequence"), L.SCOPES).isin("universal", "exclusive") | profile(F.col("sequence"), L.STATUSES).isin("preview", "available")).alias("explicit"),
    )
