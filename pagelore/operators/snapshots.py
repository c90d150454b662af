"""What changed between consecutive full snapshots: gaps and islands over key and row hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def row_hash(columns: list[str]) -> Column:
    """A hash in which null is a value of its own (xxhash64 alone passes over nulls)."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def snapshot_order(df: DataFrame) -> DataFrame:
    """One row for each snapshot of an entity: its number from 1 in time order, the id after it, the entity's last number."""
    w = W.partitionBy("e").orderBy("taken", "s")
    return (
        df.groupBy("e", "s").agg(F.min("taken").alias("taken"))
        .withColumns({"seq": F.row_number().over(w), "next_s": F.lead("s").over(w), "has_next": F.lead(F.lit(True)).over(w)})
        .drop("taken")
    )


def validity_intervals(df: DataFrame, entity: str, snapshot: str, taken: str, ref: str, ingested: str, compare: list[str]) -> DataFrame:
    """Maximal runs of consecutive snapshots in which a ref of an entity has the same compared values.

    Columns: e, r, h (row hash), first_seq, last_seq, first_s, after_s (the snapshot after the run), has_after. Of several
    rows for one ref in one snapshot the last ingested holds; rows delivered twice change nothing; on equal ingestion times
    the greatest hash holds. Null is a value of its own in the entity, the ref and the compared columns. Snapshots are
    ordered by their time, then id; a null time comes first.
    """
    rows = df.select(F.col(entity).alias("e"), F.col(snapshot).alias("s"), F.col(taken).alias("taken"), F.col(ref).alias("r"), F.col(ingested).alias("i"), row_hash(compare).alias("h"))
    order = snapshot_order(rows)
    held = rows.groupBy("e", "s", "r").agg(F.max(F.struct("i", "h")).alias("m")).select("e", "s", "r", "m.h")
    o = order.select(F.col("e").alias("oe"), F.col("s").alias("os"), "seq", "next_s", "has_next")
    numbered = held.join(o, F.col("e").eqNullSafe(F.col("oe")) & F.col("s").eqNullSafe(F.col("os"))).drop("oe", "os")
    # one exchange on (e, r): the island windows and the grouping below all find their rows together
    numbered = numbered.repartition("e", "r")
    island = F.col("seq") - F.row_number().over(W.partitionBy("e", "r", "h").orderBy("seq"))
    return (
        numbered.withColumn("island", island).groupBy("e", "r", "h", "island")
        .agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min_by("s", "seq").alias("first_s"), F.max_by("next_s", "seq").alias("after_s"), F.max_by("has_next", "seq").alias("has_after"))
        .drop("island")
    )


def change_events(intervals: DataFrame) -> DataFrame:
    """e, s (the later snapshot), r and kind: an interval that starts right after another is `changed`, one that starts
    alone is `added` (unless in the first snapshot), one that ends with no other right after it is `removed`."""
    w = W.partitionBy("e", "r").orderBy("first_seq")
    x = intervals.withColumns({"before": F.lag("last_seq").over(w), "then": F.lead("first_seq").over(w)})
    follows = F.col("before") == F.col("first_seq") - 1
    start = F.when(follows, F.struct(F.col("first_s").alias("s"), F.lit("changed").alias("kind"))).when(
        (F.col("first_seq") > 1) & ~F.coalesce(follows, F.lit(False)), F.struct(F.col("first_s").alias("s"), F.lit("added").alias("kind"))
    )
    gone = F.coalesce("has_after", F.lit(False)) & (F.col("then").isNull() | (F.col("then") > F.col("last_seq") + 1))
    end = F.when(gone, F.struct(F.col("after_s").alias("s"), F.lit("removed").alias("kind")))
    return x.select("e", "r", F.explode(F.array_compact(F.array(start, end))).alias("x")).select("e", "x.s", "r", "x.kind")


def snapshot_changes(df: DataFrame, entity: str, snapshot: str, taken: str, ref: str, ingested: str, compare: list[str]) -> DataFrame:
    """`entity`, `snapshot` (the later one), `ref` and change_kind (added, removed, changed) of every difference between two
    consecutive snapshots of an entity. The first snapshot gives no rows; an empty table gives none."""
    ev = change_events(validity_intervals(df, entity, snapshot, taken, ref, ingested, compare))
    return ev.select(F.col("e").alias(entity), F.col("s").alias(snapshot), F.col("r").alias(ref), F.col("kind").alias("change_kind"))


def change_counts(df: DataFrame, entity: str, snapshot: str, taken: str, ref: str, ingested: str, compare: list[str]) -> DataFrame:
    """For each snapshot but the first of an entity: how many refs were added, removed, changed and retained unchanged."""
    iv = validity_intervals(df, entity, snapshot, taken, ref, ingested, compare)
    rows = df.select(F.col(entity).alias("e"), F.col(snapshot).alias("s"), F.col(taken).alias("taken"))
    order = snapshot_order(rows).where("seq > 1").select("e", "s", "seq")
    ev = change_events(iv).groupBy("e", "s").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed")])
    # a ref is retained in every snapshot of its interval but the first one
    kept = iv.where("last_seq > first_seq").select("e", F.explode(F.sequence(F.col("first_seq") + 1, F.col("last_seq"))).alias("seq")).groupBy("e", "seq").agg(F.count("*").alias("retained"))
    a, b, c = order.alias("a"), ev.alias("b"), kept.alias("c")
    out = a.join(b, F.expr("a.e <=> b.e and a.s <=> b.s"), "left").join(c, F.expr("a.e <=> c.e and a.seq = c.seq"), "left")
    return out.select(F.col("a.e").alias(entity), F.col("a.s").alias(snapshot), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("added", "removed", "changed", "retained")])
