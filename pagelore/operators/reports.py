"""Snapshot documents and evidence reports as received, made into block, claim, snippet and citation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.operators import nested as N
from pagelore.session import cut

# --- fixed values: the names that the contracts accept for the claim buckets --------------------------------------
BUCKETS = [
    ["evidenceSupportedClaims", "supportedClaims"],
    ["contradictedClaims"],
    ["insufficientEvidenceClaims", "unsupportedClaims"],
    ["needsMoreBrowsingClaims"],
]
# --- end of fixed values ------------------------------------------------------------------------------------------
PARTS = ("snapshot", "evidence")
CLAIMS = ["claimOutcomes", *(k for names in BUCKETS for k in names)]
LISTS = frozenset(["blocks", "supportSnippets", *CLAIMS])


def envelopes(base: DataFrame, schema: N.Node, path: str = "$") -> list[str]:
    """The places of a merged schema that hold a snapshot or a report, the outermost first."""
    here = [path] if any(k in schema.fields for k in PARTS) else []
    below = []
    for k, c in schema.fields.items():
        if k.isidentifier() and k not in PARTS and not c.many:
            at = f"{path}.{k}"
            # where types disagree, the objects among them
            inner = N.inferred(base.select(N.get(F.col("v"), at).alias("x")).where("x is not null"), "x") if c.open else c
            below += envelopes(base, inner, at)
    return sorted(here + below, key=lambda p: (p.count("."), p))


def records(df: DataFrame, record: str, payload: str) -> DataFrame:
    """record, snapshot and evidence (variants) of every complete payload, out of its envelope and encodings."""
    base = N.complete(df, record, payload)
    at = envelopes(base, N.inferred(base, "v"))
    if not at:
        return base.select(F.col("__r").alias("record"), *[F.col("v").alias(part) for part in PARTS]).limit(0)
    held = F.coalesce(*[N.let(N.get(F.col("v"), p), lambda x: F.when(N.get(x, "$.snapshot").isNotNull() | N.get(x, "$.evidence").isNotNull(), x)) for p in at])
    doc = base.select(F.col("__r").alias("record"), held.alias("doc")).where("doc is not null")
    # parsed once, read by every child table
    return cut(doc.select("record", *[N.decoded(N.get(F.col("doc"), f"$.{part}")).alias(part) for part in PARTS]))


def claim_offsets(evidence: Column) -> Column:
    """Of each list of claims how many claims of the report come before it, null if the list is not used: the outcomes, or, if
    there are none, of each bucket the first name that has any."""
    size = {k: F.coalesce(F.size(N.as_list(N.get(evidence, f"$.{k}"))), F.lit(0)) for k in CLAIMS}

    def of(n: Column) -> Column:
        n = {k: n[k] for k in CLAIMS}
        out, before = {"claimOutcomes": F.when(n["claimOutcomes"] > 0, 0)}, F.lit(0)
        for names in BUCKETS:
            free = n["claimOutcomes"] == 0
            taken = F.lit(0)
            for k in names:
                out[k] = F.when(free & (n[k] > 0), before)
                taken, free = F.when(free & (n[k] > 0), n[k]).otherwise(taken), free & (n[k] == 0)
            before = before + taken
        return F.struct(*[v.cast("int").alias(k) for k, v in out.items()])

    return N.let(F.struct(*[v.alias(k) for k, v in size.items()]), of)


def tables(df: DataFrame, record: str, payload: str) -> dict[str, DataFrame]:
    """The child tables: block, claim, snippet and citation, each with the record, its parent's position, its own and its key.

    They are levels of the merged schema of the snapshots and the reports; the names the contracts accept for the same list
    select among these. Positions count from 1 as received. Broken payloads, nulls and empty lists give no rows; a lone object
    counts as a list of one; a record delivered twice counts once. The element stays in `value` for columns of choice.
    """
    rec = records(df, record, payload)
    none = rec.select("record", F.lit(0).alias("parent"), F.lit(0).alias("no"), F.col("snapshot").alias("value")).limit(0)
    snap = N.levels(rec.select("record", "snapshot"), ["record"], "snapshot", LISTS, only=True)
    block = snap["$.blocks"].select("record", F.lit(0).alias("parent"), F.col("no_1").alias("no"), "value") if "$.blocks" in snap else none
    ev = N.levels(rec.select("record", claim_offsets(F.col("evidence")).alias("off"), "evidence"), ["record", "off"], "evidence", LISTS, only=True)
    claim = snippet = none
    for k in CLAIMS:
        at = f"$.{k}"
        off, used = F.col(f"off.{k}"), F.col(f"off.{k}").isNotNull()
        if at in ev:
            claim = claim.union(ev[at].where(used).select("record", F.lit(0), off + F.col("no_1"), "value"))
        if (below := f"{at}[*].supportSnippets") in ev:
            snippet = snippet.union(ev[below].where(used).select("record", off + F.col("no_1"), "no_2", "value"))
    names = block.select(F.col("record").alias("r"), N.text(F.col("value"), "$.id").alias("block_id"), N.text(F.col("value"), "$.ref").alias("block_ref"), "no").groupBy("r", "block_id").agg(F.min_by("block_ref", "no").alias("block_ref"))
    snippet = snippet.withColumns({"own": N.text(F.col("value"), "$.stableRef"), "block_id": N.text(F.col("value"), "$.blockId")})
    # only snippets without a ref of their own look their block up
    known = snippet.where("own is not null").select("record", "parent", "no", F.col("own").alias("key"), "value")
    looked = snippet.where("own is null").alias("s").join(names.alias("n"), F.expr("s.record <=> n.r and s.block_id = n.block_id"), "left").select("record", "parent", "no", F.col("block_ref").alias("key"), "value")
    url = N.text(F.col("value"), "$.citation.url")
    return {
        "block": block.select("record", "parent", "no", N.text(F.col("value"), "$.ref").alias("key"), "value"),
        "claim": claim.select("record", "parent", "no", N.text(F.col("value"), "$.claimId").alias("key"), "value"),
        "snippet": known.union(looked),
        "citation": claim.where(url != "").select("record", F.col("no").alias("parent"), F.lit(1).alias("no"), url.alias("key"), N.get(F.col("value"), "$.citation").alias("value")),
    }


def children(df: DataFrame, record: str, payload: str) -> DataFrame:
    """record, child, parent_no, child_no and child_key of all four tables."""
    out = None
    for name, t in tables(df, record, payload).items():
        part = t.select(F.col("record").alias(record), F.lit(name).alias("child"), F.col("parent").cast("int").alias("parent_no"), F.col("no").cast("int").alias("child_no"), F.col("key").alias("child_key"))
        out = part if out is None else out.union(part)
    return out
