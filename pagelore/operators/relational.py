"""Joins that need care at scale: as-of, interval, and joins on skewed keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, values: list[str]) -> DataFrame:
    """For each left row the values of the last right row of its key at or before its time.

    Both sides are united and each left row looks back over its key's rows, one sort and no pairs. Of right rows of one time the
    greatest values hold. Left rows without an earlier right row get nulls.
    """
    names = [c for c in left.columns]
    l = left.select(*names, F.col(left_at).alias("__at"), F.lit(1).alias("__side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"__{v}") for v in values])
    r = right.select(*[F.col(c) if c in on else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in names], F.col(right_at).alias("__at"), F.lit(0).alias("__side"), *[F.col(v).alias(f"__{v}") for v in values])
    w = W.partitionBy(*on).orderBy("__at", "__side", *[f"__{v}" for v in values]).rowsBetween(W.unboundedPreceding, 0)
    row = F.struct(*[F.col(f"__{v}").alias(v) for v in values])
    seen = l.unionByName(r).withColumn("__last", F.last(F.when(F.col("__side") == 0, row), ignorenulls=True).over(w))
    return seen.where("__side = 1").select(*names, *[F.col(f"__last.{v}").alias(v) for v in values])


def within(left: DataFrame, right: DataFrame, left_at: str, right_from: str, right_to: str, width: str, on: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """Left rows with the right rows of the same `on` whose interval [from, to] holds their time: an equi-join on these columns and on
    buckets of `width` seconds.

    A right row is repeated for each bucket it touches, so choose a width near the usual length of an interval.
    """
    sec = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (int(width) * 1_000_000))
    l = left.withColumn("__b", sec(left_at))
    r = right.withColumn("__b", F.explode(F.sequence(sec(right_from), sec(right_to))))
    inside = (F.col(left_at) >= F.col(right_from)) & (F.col(left_at) <= F.col(right_to))
    return l.join(r, [*(on or []), "__b"]).where(inside if condition is None else inside & condition).drop("__b")


def salted(left: DataFrame, right: DataFrame, on: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """A join whose left side has few keys with most rows: left rows are spread over `salts` parts of their key, right rows
    are repeated for each part. Use it where the engine's own handling of skew cannot split the join."""
    l = left.withColumn("__salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    r = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [on, "__salt"], how).drop("__salt")
