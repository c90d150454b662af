"""Text that looks the same brought to one form, and records whose texts differ only in how they are spelled."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelore.llm import codepoints as C
from pagelore.session import cut


def _unify(texts: pa.Array) -> pa.Array:
    out = []
    for b in C.pieces(iter([pa.RecordBatch.from_arrays([texts], names=["t"])])):
        t = b.column(0)
        out.append(C.encode(*C.reading(*C.decode(t)), t.is_null().to_numpy(zero_copy_only=False)))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def unify(text: Column | str) -> Column:
    """The one consistent form of a text column.

    Full-width, joined and composed forms become plain ones, look-alike letters and hyphens become ASCII, invisible
    characters go, white space becomes single blanks without outer ones. Letter case, accents, raised digits and circled
    or fraction forms stay. Null stays null, an empty text and one of invisible characters alone become the empty text.
    """
    return F.arrow_udf(_unify, "string")(text)


def reading_keys(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """`keep` with two hashes of the reading of `text` (r1, r2) and one of its characters (w). Rows with null text are left out."""
    src = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keep)], F.col(text).alias("t")).where("t is not null")
    fields = src.schema.fields[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            cp, offs = C.decode(b.column(b.num_columns - 1))
            rcp, roffs = C.reading(cp, offs)
            hashes = [C.row_hash(rcp, roffs, 0), C.row_hash(rcp, roffs, 7), C.row_hash(cp, offs, 3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, hashes)], names=[*b.schema.names[:-1], "r1", "r2", "w"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in fields), "r1 long", "r2 long", "w long"])
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keep)], "r1", "r2", "w")


def same_reading_pairs(df: DataFrame, key: str, text: str, within: list[str]) -> DataFrame:
    """Pairs of records of one `within` whose texts differ in characters but read the same: `within`, key_a < key_b.

    Groups of one reading are first reduced to the least and greatest character hash, a partial aggregation, and only
    members of groups with two spellings are joined, so a text that a third of all rows share costs one row per task. A
    record delivered several times counts once. Null keys, null `within` and null texts give no pair.
    """
    a = cut(reading_keys(df, text, key, *within).where(F.col(key).isNotNull()))
    on = [*within, "r1", "r2"]
    mixed = a.groupBy(*on).agg(F.min("w").alias("lo"), F.max("w").alias("hi")).where("lo <> hi").select(*on)
    m = cut(a.join(mixed, on, "left_semi").distinct())
    left = m.withColumnRenamed(key, "key_a").withColumnRenamed("w", "wa")
    right = m.withColumnRenamed(key, "key_b").withColumnRenamed("w", "wb")
    return left.join(right, on).where("key_a < key_b and wa <> wb").select(*within, "key_a", "key_b").distinct()
