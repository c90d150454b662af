"""Sessions over snapshots: bounded working sets, turns, journals, replay, synthesis of claims."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALIENT = ["heading", "table", "list", "metadata"]
#: Claim states, weakest first.
PRIORITY = {"insufficient-evidence": 0, "needs-more-browsing": 1, "evidence-supported": 2, "contradicted": 3}


def keep(current: list[str], salient: list[str], present: set[str], limit: int) -> tuple[list[str], list[str]]:
    """The working set after a turn: salient refs, then current ones still present, first `limit`; and the current ones dropped."""
    kept = list(dict.fromkeys([*salient, *(r for r in current if r in present)]))[: max(1, limit)]
    return kept, [r for r in current if r not in set(kept)]


def working_sets(refs: DataFrame, session: str, turn: str, ref: str, kind: str, ord_: str, limit: int = 6) -> DataFrame:
    """session, turn, kept and dropped refs of each turn, each depending on the turn before it.

    Salient refs beyond `limit` can never be kept, so each turn is cut to its first `limit` of them and the refs that are salient
    in some turn of the session before the fold: a current ref was salient once. A session's turns are one group.
    """
    r = refs.select(F.col(session).alias("s"), F.col(turn).alias("t"), F.col(ref).alias("r"), F.col(kind).isin(SALIENT).alias("x"), F.col(ord_).alias("o"))
    once = r.groupBy("s", "t", "r").agg(F.min(F.when(F.col("x"), F.col("o"))).alias("o"))
    nth = F.row_number().over(W.partitionBy("s", "t").orderBy(F.col("o").asc_nulls_last(), "r"))
    top = once.withColumn("nth", F.when(F.col("o").isNotNull(), nth))
    ever = top.where(F.col("nth") <= limit).select("s", "r").distinct()
    cut = top.join(ever, ["s", "r"], "left_semi")
    kind_s, kind_t = r.schema["s"].dataType.simpleString(), r.schema["t"].dataType.simpleString()
    turns = r.select("s", "t").distinct().withColumns({"r": F.lit(None).cast("string"), "o": F.lit(None).cast(r.schema["o"].dataType), "nth": F.lit(None).cast("int")})

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        current: list[str] = []
        rows = []
        for t, part in pdf.sort_values(["t", "nth"]).groupby("t", sort=True):
            present = set(part["r"].dropna())
            salient = part.loc[part["nth"].notna() & (part["nth"] <= limit), "r"].tolist()
            current, gone = keep(current, salient, present, limit)
            rows.append((pdf["s"].iloc[0], t, current, gone))
        return pd.DataFrame(rows, columns=["s", "t", "kept", "dropped"])

    out = cut.select("s", "t", "r", "o", "nth").unionByName(turns).groupBy("s").applyInPandas(fold, f"s {kind_s}, t {kind_t}, kept array<string>, dropped array<string>")
    return out.select(F.col("s").alias(session), F.col("t").alias(turn), "kept", "dropped")


def turn_summary(turns: DataFrame, session: str, turn: str, urls: str, kept: str) -> DataFrame:
    return turns.groupBy(session).agg(
        F.count("*").alias("turns"), F.max(F.size(kept)).alias("most"), F.max_by(F.size(kept), turn).alias("final"), F.array_sort(F.collect_set(urls)).alias("urls")
    )


def journal(events: DataFrame, session: str, order: list[str]) -> DataFrame:
    """Events of a session numbered from 1."""
    return events.withColumn("seq", F.row_number().over(W.partitionBy(session).orderBy(*order)))


def synthesize(outcomes: DataFrame, session: str) -> DataFrame:
    """One row for each claim of a session: its strongest state, its snapshots, support refs and cited addresses as sorted sets."""
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("verdict")]
    return outcomes.groupBy(session, "claim_statement").agg(
        F.max_by("verdict", rank).alias("status"), F.array_sort(F.collect_set("capture_id")).alias("snapshots"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("support", F.array().cast("array<string>")))))).alias("refs"), F.array_sort(F.collect_set("citation.url")).alias("urls"), F.count("*").alias("asked"),
    )


def last_values(trace: DataFrame, key: list[str], ref: str, order: list[str]) -> DataFrame:
    """Of each ref the last row, in the order of those rows."""
    w = W.partitionBy(*key, ref).orderBy(*[F.desc(o) for o in order])
    return trace.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")
