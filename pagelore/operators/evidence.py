"""Claims paired with the passages of their page, scored, ranked and judged."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagelore.functions import lexicon as L
from pagelore.functions import text as T
from pagelore.operators import guards as G
from pagelore.session import cut

NARRATIVE = ("text", "list", "table", "metadata")


def mapped(of: dict, key: str, els) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in of.items() for x in kv])[F.col(key)], F.lit(els))


def attribute_terms(attributes: Column) -> Column:
    """Of a JSON object, in key order: strings and numbers as they are, the keys of true values, the items of lists."""
    pairs = F.array_sort(F.map_entries(F.from_json(attributes, "map<string,string>")))
    term = lambda e: F.when((e["value"] == "true"), e["key"]).when((e["value"] == "false") | e["value"].isNull(), F.lit(None)).when(e["value"].startswith("["), F.array_join(F.from_json(e["value"], "array<string>"), " ")).otherwise(e["value"])
    return F.coalesce(F.array_join(F.filter(F.transform(pairs, term), lambda t: t.isNotNull()), " "), F.lit(""))


def kind_terms(kind: Column, text: Column, href: Column, options: Column) -> Column:
    """Words that a block's kind stands for."""
    n = T.normalize(text)
    of = F.when(kind == "list", "list items").when(kind == "link", F.when(href.rlike("^https?://"), "link external external-link").otherwise("link")).when(kind == "button", "button").when(kind == "form", "form field fields input").when(kind == "input", "input field").otherwise("")
    return F.concat_ws(
        " ", F.nullif(of, F.lit("")), F.when(options == "available-options", "option options available availability supported"), F.when(n.contains("submit"), "submission"), F.when(n.contains("execute"), "execution")
    )


def joined(*parts: Column) -> Column:
    """Non-empty parts with blanks between."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), " ")


def prepare_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks (page, ord, kind, role, ref, text, attributes) with their search text, tokens and context.

    The context of a narrative block is the nearest heading before it and its neighbours in the same region. Null texts count as
    empty.
    """
    text = F.coalesce("text", F.lit(""))
    href, options = F.get_json_object("attributes", "$.href"), F.get_json_object("attributes", "$.selectionSemantic")
    b = blocks.select("page", "ord", "kind", "role", "ref", "text", "attributes").withColumns({"text": text, "terms": joined(attribute_terms(F.col("attributes")), kind_terms(F.col("kind"), text, href, options)), "options": options, "level": F.get_json_object("attributes", "$.level").cast("int")})
    b = b.withColumns({"search": joined(F.col("text"), F.col("terms")), "region": F.substring_index("ref", ":", 1)})
    n = F.length(T.trim_all(F.col("text")))
    near = F.when(F.col("kind").isin("text", "list", "table"), n >= 16).when(F.col("kind") == "metadata", n >= 24).when(F.col("kind") == "link", F.col("role").isin("content", "supporting") & (n >= 20)).otherwise(F.lit(False))
    b = b.withColumn("tokens", T.significant_tokens(F.col("search"))).withColumn("near", near)
    w = W.partitionBy("page").orderBy("ord")
    me = F.struct("tokens", "region", "near", "search")
    wide = F.col("kind").isin("heading", "text", "list", "table", "metadata") & F.col("role").isin("content", "supporting", "metadata", "table-cell")
    b = b.withColumns({
        "heading": F.last(F.when(F.col("kind") == "heading", F.struct("tokens", "search", "text", "ord")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)),
        "prev": F.lag(me).over(w), "next": F.lead(me).over(w),
    })
    ok = lambda c: wide & (F.col(f"{c}.region") == F.col("region")) & F.col(f"{c}.near")
    none = F.array().cast("array<string>")
    side = lambda c: F.when(ok(c), F.col(f"{c}.tokens")).otherwise(none)
    around = F.array_distinct(F.concat(F.when(wide & F.col("heading").isNotNull(), F.col("heading.tokens")).otherwise(none), F.coalesce(side("prev"), none), F.coalesce(side("next"), none)))
    return b.withColumn("around", around).drop("prev", "next", "near")


def candidates(prepared: DataFrame) -> DataFrame:
    """The passages of every block: segments of narrative kinds, the whole text of others; never none."""
    whole = F.array(T.trim_all(F.col("text")))
    seg = T.let(F.when(F.col("kind").isin(*NARRATIVE), T.segments(F.col("text"))).otherwise(whole), lambda s: F.when(F.size(s) == 0, whole).otherwise(s))
    c = prepared.select("*", F.posexplode(seg).alias("seg_no", "passage"))
    header = T.trim_all(F.substring_index("text", "\n", 1))
    header = F.when(F.col("kind").isin("table", "list") & (header != "") & (header != F.col("passage")), header)
    c = c.withColumn("passage_search", joined(F.col("passage"), header, F.col("terms")))
    # what scoring needs of a passage, once a passage and not once a claim
    c = c.withColumn("seg_norm", T.normalize(F.col("passage_search"))).withColumn("seg_words", T.split_words(F.col("seg_norm")))
    c = c.withColumn("seg_all", F.flatten(F.transform("seg_words", T.expand))).withColumn("seg_tokens", T.significant_of(F.col("seg_all")))
    says = qualifier_profile(None, F.col("seg_norm"))
    c = c.withColumns({
        "seg_numbers": T.numeric_of(F.col("seg_words")), "seg_timed": F.exists("seg_tokens", lambda t: T.unit_of(t).isNotNull()), "seg_release": F.exists("seg_words", released),
        "seg_default": says[0], "seg_maximum": says[1], "seg_minimum": says[2], "wide_tokens": F.array_distinct(F.concat("seg_tokens", "around")),
    })
    return c.withColumns({"seg_heads": T.heads(F.col("seg_tokens")), "wide_heads": T.heads(F.col("wide_tokens"))}).drop("seg_norm", "seg_words")


def released(token: Column) -> Column:
    return token.isin(L.RELEASE_WORDS) | T.is_version(token)


def prepare_claims(claims: DataFrame) -> DataFrame:
    """Claims (page, claim, statement) with their token sets. Blank and null statements are left out."""
    c = claims.select("page", "claim", "statement").where(F.length(T.trim_all(F.col("statement"))) > 0).withColumns({"normalized": T.normalize(F.col("statement")), "claim_tokens": T.significant_tokens(F.col("statement"))})
    return c.withColumns({
        "sequence": T.all_tokens(F.col("statement")), "words": T.split_words(F.col("normalized")), "numbers": T.numeric_tokens(F.col("statement")),
        "qualifiers": T.qualifier_tokens(F.col("statement")), "anchors": T.anchor_tokens(F.col("claim_tokens")), "units": T.duration_units(F.col("statement")),
    })


def scripts(blocks: DataFrame) -> DataFrame:
    """page, latin, cjk, crosses: the ASCII and CJK letters of a page's content, and whether it is matched across languages."""
    b = blocks.where(F.col("role").isin("content", "supporting", "metadata") & F.col("text").isNotNull())
    x = b.groupBy("page").agg(F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))).alias("latin"), F.sum(F.regexp_count("text", F.lit(f"[{L.CJK}]"))).alias("cjk"))
    return x.withColumn("crosses", (F.col("latin") >= 48) & (F.col("latin") >= F.greatest(F.col("cjk") * 3, F.lit(12))))


def matching_claims(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Prepared claims with the tokens and anchors they are matched by on their page, and `crosses`: a CJK claim with glosses
    stands on a page mostly in Latin script and is matched by these. `own_anchors` are those of the statement as it is."""
    on = scripts(blocks).where("crosses").select("page", F.lit(True).alias("latin_page"))
    c = prepare_claims(claims).join(on, "page", "left").withColumn("glosses", T.glosses(F.col("statement")))
    c = c.withColumns({"crosses": F.coalesce("latin_page", F.lit(False)) & T.is_cjk(F.col("statement")) & (F.size("glosses") > 0), "own_anchors": F.col("anchors")})
    pick = lambda across, own: F.when(F.col("crosses"), across).otherwise(F.col(own))
    c = c.withColumns({"claim_tokens": pick(F.col("glosses"), "claim_tokens"), "anchors": pick(T.anchor_tokens(F.col("glosses")), "anchors")})
    return c.drop("latin_page", "glosses")


def claim_weights(claims: DataFrame, prepared: DataFrame) -> DataFrame:
    """page, claim and the weight of each of its tokens by how many blocks of the page match it: rare tokens weigh more."""
    n = prepared.groupBy("page").agg(F.count("*").alias("n"))
    pairs = claims.select("page", "claim", "claim_tokens").join(prepared.select("page", "tokens", T.heads(F.col("tokens")).alias("heads")), "page")
    hit = pairs.select("page", "claim", F.explode(T.matched(F.col("claim_tokens"), F.col("tokens"), F.col("heads"))).alias("token")).groupBy("page", "claim", "token").agg(F.count("*").alias("df"))
    df = hit.groupBy("page", "claim").agg(F.map_from_entries(F.collect_list(F.struct("token", "df"))).alias("df"))
    c = claims.select("page", "claim", "claim_tokens").join(n, "page").join(df, ["page", "claim"], "left")
    found = lambda t: F.coalesce(F.col("df")[t], F.lit(0))
    weight = lambda t: F.greatest(F.lit(0.2), F.log((F.col("n") - found(t) + 0.5) / (found(t) + 0.5)) + 1.0)
    return c.select("page", "claim", F.transform("claim_tokens", weight).alias("weights"))


def weighted_overlap(tokens: Column, weights: Column, others: Column, other_heads: Column) -> Column:
    """The share of the weights of the tokens that some other token matches."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    got = F.aggregate(F.zip_with(tokens, weights, lambda t, w: F.when(T.matches_any(t, others, other_heads), w).otherwise(0.0)), F.lit(0.0), lambda s, w: s + w)
    return F.when(F.size(tokens) == 0, 0.0).otherwise(got / total)


def exact_bonus(sequence: Column, tokens: Column) -> Column:
    return F.when(T.contains_sequence(tokens, sequence), 1.0).when((F.size(sequence) > 0) & (F.size(F.array_except(sequence, tokens)) == 0), 0.70).otherwise(0.0)


def qualifier_profile(tokens: Column | None, n: Column | None) -> list[Column]:
    """Whether the tokens of a claim, or a normalized passage, speak of a default, a maximum, a minimum."""
    if tokens is not None:
        return [F.array_contains(tokens, "default"), F.arrays_overlap(tokens, T.words("maximum", "max")), F.arrays_overlap(tokens, T.words("minimum", "min"))]
    return [n.contains(" default "), n.rlike(" (?:maximum|max|up to|at most) "), n.rlike(" (?:minimum|min|at least) ")]


def score(pairs: DataFrame) -> DataFrame:
    """The lexical score of every claim and passage and what it is made of; passages without tokens are left out."""
    p = pairs.where(F.size("seg_tokens") > 0)
    has_numbers = F.size("numbers") > 0
    p = p.withColumns({
        "lexical": weighted_overlap(F.col("claim_tokens"), F.col("weights"), F.col("seg_tokens"), F.col("seg_heads")),
        "context": weighted_overlap(F.col("claim_tokens"), F.col("weights"), F.col("wide_tokens"), F.col("wide_heads")),
        "exact": exact_bonus(F.col("sequence"), F.col("seg_all")),
        "numeric": F.when(has_numbers, F.size(F.array_intersect("numbers", "seg_numbers")) / F.size("numbers")).otherwise(0.0),
    })
    excess = F.size("seg_numbers") - (F.size("numbers") + 2)
    noise = F.when(has_numbers & (excess > 0), -mapped(L.NUMERIC_NOISE, "kind", 0.0) * F.least(F.lit(1.0), excess / 6)).otherwise(0.0)
    region = F.lit(0.0)
    for k, v in L.REGION_ADJUSTMENT.items():
        region = F.when(F.lower("ref").startswith(k), v).otherwise(region)
    role = F.when((F.col("role") == "form-control") & (F.col("options") == "available-options"), -0.05).otherwise(mapped(L.ROLE_ADJUSTMENT, "role", 0.0))
    mine, theirs = qualifier_profile(F.col("qualifiers"), None), [F.col(f"seg_{q}") for q in ("default", "maximum", "minimum")]
    align = (mine[0] & theirs[0]) | (mine[1] & theirs[1]) | (mine[2] & theirs[2])
    clash = (mine[0] & (theirs[1] | theirs[2])) | (mine[1] & (theirs[0] | theirs[2])) | (mine[2] & (theirs[0] | theirs[1]))
    some = F.size("qualifiers") > 0
    limit = F.when(some & has_numbers & align, mapped({"text": 0.12, "heading": 0.03, "table": -0.08, "list": -0.05}, "kind", 0.0)).otherwise(0.0)
    version = F.when(~has_numbers & ~F.exists("claim_tokens", released) & F.col("seg_release"), -0.08).otherwise(0.0)
    says = lambda *ws: F.arrays_overlap("claim_tokens", T.words(*ws))
    field, auth = says(*"field input form email password verification code credential".split()), says(*"sign login submit email password verification code credential".split())
    platform, offered = says(*"platform operating system os macos windows linux".split()), says("available", "availability", "support", "supported")
    listed = (F.col("options") == "available-options") & offered & platform
    meant = F.filter("claim_tokens", lambda t: ~t.isin("button field form input contain contains includ".split()) & ~t.rlike("^[0-9]+$"))
    control = F.when((F.col("kind") == "input") & listed, 0.24).when((F.col("kind") == "list") & listed, 0.18).when((F.col("kind") == "button") & says("button", "sign") & auth, 0.22)
    control = control.when((F.col("kind") == "button") & says("button", "sign") & (F.size(T.matched(meant, F.col("around"))) > 0), 0.18).when((F.col("kind") == "input") & field, 0.20).when((F.col("kind") == "form") & field, 0.16).otherwise(0.0)
    w = L.SCORE_WEIGHTS
    raw = (
        F.col("lexical") * w["lexical"] + F.col("context") * w["context"] + F.col("exact") * w["exact"] + F.col("numeric") * w["numeric"]
        + F.when(has_numbers & (F.size("seg_numbers") > 0), 0.06).otherwise(0.0)
        + F.when((F.size("units") > 0) & F.col("seg_timed"), 0.08).otherwise(0.0)
        + noise + mapped(L.KIND_BONUS, "kind", 0.0) + F.coalesce(control, F.lit(0.0)) + role + region
        + F.when(some & align, 0.14).when(some & clash, -0.18).otherwise(0.0) + limit + version + F.greatest(F.col("context") - F.col("lexical"), F.lit(0.0)) * w["gain"]
    )
    return p.withColumn("raw", raw)


# --- polarity -----------------------------------------------------------------------------------------------------


def _pieces(tokens: list[str], phrase: list[str]) -> list[tuple[int, int]]:
    n = len(phrase)
    return [(i, i + n) for i in range(len(tokens) - n + 1) if tokens[i : i + n] == phrase]


def contradicts(claim: str, passage: str, tok, sig, norm, anchors, match) -> bool:
    """The passage says the opposite of the claim by one of the polarity pairs: it holds the claim with the pair's other side, or
    a segment with the other side and the same words after it. `tok` and the rest are the text functions."""
    whole = tok(norm(passage))
    segs = None
    for pos, neg in L.POLARITY:
        p, n = tok(pos), tok(neg)

        def side(ts):
            bad = _pieces(ts, n)
            good = [x for x in _pieces(ts, p) if not any(b[0] <= x[0] and b[1] >= x[1] for b in bad)]
            return (1 if good else 0) | (2 if bad else 0)

        mine = tok(claim)
        at = side(mine)
        if at not in (1, 2):
            continue
        same, other = (pos, neg) if at == 1 else (neg, pos)
        turned = claim.replace(same, other, 1)
        if turned != claim and _pieces(whole, tok(turned)):
            return True
        after = lambda ts, ph: {t for _, e in _pieces(ts, tok(ph)) for t in ts[e : e + 4] if t not in L.CONTEXT_STOP_WORDS and len(t.encode()) >= 3}
        mine_after = sorted(after(mine, same))
        anchor = anchors([t for t in sig(claim) if t not in set(p) | set(n)])
        if not mine_after and not anchor:
            continue
        if segs is None:
            out, cur = [], ""
            for ch in passage:
                if ch in ".!?;:\n\r":
                    out.append(cur)
                    cur = ""
                else:
                    cur += ch
            segs = [x for x in map(norm, [*out, cur]) if x]
        for sgm in segs:
            ts = tok(sgm)
            if side(ts) != 3 - at:
                continue
            theirs = after(ts, other) if mine_after else set(sig(sgm))
            mine_set = mine_after or anchor
            if theirs and sum(any(match(a, b) for b in theirs) for a in mine_set) / len(mine_set) >= (0.5 if mine_after else 0.6):
                return True
    return False


def contradictions(pairs: DataFrame) -> DataFrame:
    """`pairs` with `contradictory`. Only claims that hold a polarity word are sent to Python."""
    words = sorted({w for pair in L.POLARITY for w in pair[0].split() + pair[1].split()} - {"not", "non"})
    polar = F.exists("words", lambda t: t.isin(words))
    keys = ["page", "claim", "ord", "seg_no"]
    sent = pairs.where(polar).select(*keys, "normalized", "passage_search")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pagelore.functions import plaintext as X

        for b in batches:
            flags = [contradicts(c, p, X.all_tokens, X.significant, X.normalize, X.anchors, X.tokens_match) for c, p in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(flags, pa.bool_())], names=[*keys, "contradictory"])

    t = {f.name: f.dataType.simpleString() for f in sent.schema.fields}
    flagged = sent.mapInArrow(run, f"page {t['page']}, claim {t['claim']}, ord int, seg_no int, contradictory boolean").where("contradictory")
    return pairs.join(flagged, keys, "left").withColumn("contradictory", F.coalesce("contradictory", F.lit(False)))


def scored(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every claim against every passage of its page with score, parts and rank (best first; ties by block, then passage)."""
    b = cut(prepare_blocks(blocks))
    return ranked(cut(matching_claims(claims, b)), b)


def ranked(c: DataFrame, b: DataFrame) -> DataFrame:
    """`scored` of claims with their matching tokens and of prepared blocks, both cut."""
    # only pages that a claim is asked on have their passages cut
    on = candidates(b.join(c.select("page").distinct(), "page", "left_semi"))
    p = score(c.join(claim_weights(c, b), ["page", "claim"]).join(on, "page"))
    keep = ["page", "claim", "ord", "seg_no", "kind", "ref", "text", "passage_search", "normalized", "words", "numbers", "seg_tokens", "lexical", "context", "exact", "numeric", "raw"]
    p = contradictions(cut(p.select(*keep)))
    s = F.when(F.col("contradictory") & (F.col("context") >= 0.35), F.col("raw") * 0.6).otherwise(F.col("raw"))
    p = p.withColumn("score", F.least(F.lit(1.0), s)).where("score > 0")
    return p.withColumn("rank", F.row_number().over(W.partitionBy("page", "claim").orderBy(F.desc("score"), "ord", "seg_no")))


def top_support(ranked: DataFrame, most: int = 3, least: float = 0.22) -> DataFrame:
    """The support of a claim: its best passages that do not contradict, of different blocks first, then further ones."""
    ok = ranked.where(~F.col("contradictory") & (F.col("score") >= least))
    nth = F.row_number().over(W.partitionBy("page", "claim", "ord").orderBy("rank"))
    w = W.partitionBy("page", "claim").orderBy(F.col("nth") > 1, "rank")
    return ok.withColumn("nth", nth).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def checked_refs(ranked: DataFrame, most: int = 3) -> DataFrame:
    first = ranked.groupBy("page", "claim", "ref").agg(F.min("rank").alias("rank"))
    return first.withColumn("n", F.row_number().over(W.partitionBy("page", "claim").orderBy("rank"))).where(F.col("n") <= most)


def verdicts(claims: DataFrame, blocks: DataFrame) -> DataFrame:
    """page, claim, verdict, support (refs in order), support_score, band, reason: the decision ladder over the ranked passages,
    with the anchor, numeric, scope, status, qualifier and polarity guards. Claims matched across languages have lower bars and are not held back as weak. Claims of pages without blocks have insufficient evidence."""
    b = cut(prepare_blocks(blocks))
    c = cut(matching_claims(claims, b))
    base = c.select("page", "claim", "statement", "words", "anchors", "own_anchors", "crosses", "numbers")
    r = cut(ranked(c, b))
    best = r.groupBy("page", "claim").agg(
        F.max(F.when(~F.col("contradictory"), F.col("score"))).alias("best"), F.max(F.when(F.col("contradictory") & (F.col("score") >= 0.05), F.col("score"))).alias("against"), F.max("contradictory").alias("any_against")
    )
    top = cut(top_support(r))
    sup = top.groupBy("page", "claim").agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("place", "ref"))), lambda x: x["ref"])).alias("support"), F.count("*").alias("n_support"), F.max("exact").alias("exact"),
        F.max(F.when(F.size("numbers") > 0, F.col("numeric"))).alias("numeric"), F.array_distinct(F.flatten(F.collect_list("seg_tokens"))).alias("tokens"),
        F.count_distinct(F.when(F.col("kind").isin(*NARRATIVE) & (F.length("text") >= 12) | (F.col("kind") == "heading") & (F.length("text") >= 8), F.col("ord"))).alias("narrative"),
    )
    other = r.where(F.col("contradictory") & (F.col("score") >= 0.05)).withColumn("nth", F.row_number().over(W.partitionBy("page", "claim").orderBy("rank"))).where("nth <= 3")
    other = other.groupBy("page", "claim").agg(F.array_distinct(F.flatten(F.collect_list("seg_tokens"))).alias("other_tokens"))
    x = base.join(best, ["page", "claim"], "left").join(sup, ["page", "claim"], "left").join(other, ["page", "claim"], "left").join(G.guarded(c, top, b).withColumnRenamed("numeric", "numeric_guard"), ["page", "claim"], "left")
    guards = [F.coalesce(g, F.lit(G.OK)) for g in ("numeric_guard", "scope", "status", "qualifier")]
    held = ~F.forall(F.array(*guards), lambda g: g == G.OK)
    need = lambda n: F.when(n == 0, 0.0).when(n <= 2, 1.0).when(n == 3, 2 / 3).otherwise(0.6)
    lacks = lambda tokens, anchors: T.let(F.size(anchors), lambda n: (n > 0) & (F.size(T.matched(F.col(anchors), F.coalesce(tokens, F.array().cast("array<string>")))) / F.greatest(n, F.lit(1)) + 0.001 < need(n)))
    # as in the reference, what speaks against a claim is held to the anchors of its own language
    thin, thin_against = lacks("tokens", "anchors"), lacks("other_tokens", "own_anchors")
    strong = F.coalesce("numeric", F.lit(0.0)) >= 0.99
    lone, wide = (F.col("n_support") < 2) & strong, (F.col("n_support") >= 2) & (F.col("narrative") >= 2)
    bar = F.when(F.col("crosses"), F.when(~thin & (lone | wide), 0.38).otherwise(0.40)).when(thin, 0.52).when(lone, 0.40).when(wide, 0.46).otherwise(0.52)
    b, a = F.coalesce("best", F.lit(0.0)), F.coalesce("against", F.lit(0.0))
    conf = T.round2(F.lit(0.55) + b * 0.40)
    weak = ~F.col("crosses") & (conf < 0.82) & (F.coalesce("exact", F.lit(0.0)) < 0.70) & ~strong & (F.col("n_support") < 2)
    as_ = lambda v, r: F.struct((F.lit(v) if isinstance(v, str) else v).alias("v"), (F.lit(r) if r is None or isinstance(r, str) else r).cast("string").alias("r"))
    none = lambda reason: as_(F.when(F.col("any_against"), "contradicted").otherwise("insufficient-evidence"), F.when(F.col("any_against"), "contradictory-evidence").otherwise(reason))
    more = as_("needs-more-browsing", "needs-more-browsing")
    # what speaks against the claim only counts if it speaks of the same things
    turned = F.when(thin_against, more).otherwise(as_("contradicted", "negation-mismatch"))
    out = (
        F.when(T.low_signal(F.col("statement"), F.col("words")), as_("insufficient-evidence", "insufficient-support-score"))
        .when((F.col("best").isNull() & (a > 0)) | (a >= b + 0.02), turned)
        .when(F.col("best").isNull(), none("no-supporting-block"))
        .when(F.col("support").isNull(), none("insufficient-support-score"))
        .when(guards[0] == G.CONTRADICTS, as_("contradicted", "numeric-mismatch"))
        .when(guards[1] == G.CONTRADICTS, as_("contradicted", "scope-mismatch"))
        .when(guards[2] == G.CONTRADICTS, as_("contradicted", "status-mismatch"))
        .when(thin & (a > 0), turned)
        .when((b >= bar) & ~thin & ~held & weak, more)
        .when((b >= bar) & ~thin & ~held, as_("evidence-supported", None))
        .when((b >= 0.30) & (thin | held | (F.size("numbers") > 0) | F.coalesce("explicit", F.lit(False))), more)
        .otherwise(as_("insufficient-evidence", "insufficient-support-score"))
    )
    x = x.withColumn("o", out)
    score_ = F.when(F.col("o.v") == "evidence-supported", conf)
    return x.select("page", "claim", F.col("o.v").alias("verdict"), F.coalesce("support", F.array().cast("array<string>")).alias("support"), score_.alias("support_score"), F.when(score_ >= 0.92, "high").when(score_ >= 0.82, "medium").when(score_.isNotNull(), "review").alias("band"), F.col("o.r").alias("reason"))


def conflicts(supported: DataFrame) -> DataFrame:
    """Pairs of supported claims of one page (page, claim, statement) whose statements contradict each other.

    Only claims that share a polarity pair and a token that is no word of it are compared.
    """
    polar = sorted({w for p in L.POLARITY for w in (p[0] + " " + p[1]).split()} - {"not", "non"})
    held = lambda p, n: F.arrays_overlap("words", T.words(*sorted({*p.split(), *n.split()} - {"not", "non"})))
    pair = F.array_compact(F.array(*[F.when(held(p, n), i) for i, (p, n) in enumerate(L.POLARITY)]))
    c = prepare_claims(supported).select("page", "claim", "normalized", "statement", "words", F.explode(pair).alias("pair"), "claim_tokens")
    c = c.withColumn("token", F.explode(F.filter("claim_tokens", lambda t: ~t.isin(polar)))).drop("claim_tokens")
    a, b = c.alias("a"), c.select("page", "pair", "token", F.col("claim").alias("other"), F.col("statement").alias("passage_search")).alias("b")
    pairs = a.join(b, ["page", "pair", "token"]).where("claim < other").select("page", "claim", "other", "normalized", "passage_search").distinct()
    pairs = pairs.withColumns({"ord": F.lit(0), "seg_no": F.lit(0), "words": F.split("normalized", " ")})
    hit = contradictions(pairs.withColumn("claim", F.struct("claim", "other"))).where("contradictory")
    return hit.select("page", "claim.claim", "claim.other")
