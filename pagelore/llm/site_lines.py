"""Lines repeated over the pages of one site: mergeable heavy-hitter summaries, an exact second pass, removal.

A line is named by its letters: the reading of its text, case-folded, without digits, punctuation and white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelore.llm import codepoints as C
from pagelore.session import cut

MIN_PAGES = 5
#: Counters that one task keeps for one site before its summary is reduced.
CAPACITY = 1 << 17
#: Confirmed lines (16 bytes each) up to which they are broadcast; beyond, the join shuffles.
BROADCAST_LINES = 500_000


def line_keys(df: DataFrame, site: str, page: str, key: str, text: str) -> DataFrame:
    """site, page, key, line_no (from 1) and two hashes h1, h2 of the letters of each line that has letters; null texts have no lines."""
    src = df.select(F.col(site).alias("site"), F.col(page).alias("page"), F.col(key).alias("key"), F.col(text).alias("t")).where("t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.pieces(batches):
            cp, offs = C.decode(b.column(3))
            at, row, no = C.lines(cp, offs)
            lcp, loffs = C.letters_lut()(*C.compose(*C.reading_lut()(cp, at)))
            has = np.diff(loffs) > 0
            idx = pa.array(row[has])
            cols = [b.column(i).take(idx) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(no[has].astype(np.int32)), pa.array(C.row_hash(lcp, loffs)[has]), pa.array(C.row_hash(lcp, loffs, 7)[has])], names=["site", "page", "key", "line_no", "h1", "h2"])

    t = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return src.mapInArrow(run, f"site {t['site']}, page {t['page']}, key {t['key']}, line_no int, h1 long, h2 long")


def reduce_summary(counts: pd.Series, capacity: int) -> tuple[pd.Series, int]:
    """The mergeable heavy-hitter reduction: of more than `capacity` counters, the (capacity+1)-th greatest value is taken
    off every counter and the empty ones are dropped. Returns the counters and what was taken off, the error bound."""
    if len(counts) <= capacity:
        return counts, 0
    off = int(np.partition(counts.to_numpy(), len(counts) - capacity - 1)[len(counts) - capacity - 1])
    counts = counts - off
    return counts[counts > 0], off


def summaries(lines: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One bounded summary per task and site: rows (site, h1, count), and per site one row with null h1 that holds the error bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict = {}
        lost: dict = {}
        for b in batches:
            seen = b.to_pandas().drop_duplicates()
            for site, part in seen.groupby("site", dropna=False)["h1"]:
                c = part.value_counts()
                have[site] = have[site].add(c, fill_value=0).astype("int64") if site in have else c
                if len(have[site]) > 2 * capacity:
                    have[site], off = reduce_summary(have[site], capacity)
                    lost[site] = lost.get(site, 0) + off
        for site, c in have.items():
            c, off = reduce_summary(c, capacity)
            off += lost.get(site, 0)
            h, n = pa.array(c.index.to_numpy(dtype="int64")), pa.array(c.to_numpy(dtype="int64"))
            if off:
                h, n = pa.concat_arrays([h, pa.nulls(1, pa.int64())]), pa.concat_arrays([n, pa.array([off])])
            yield pa.RecordBatch.from_arrays([pa.array([None if pd.isna(site) else site] * len(h), pa.string()), h, n], names=["site", "h1", "n"])

    return lines.select(F.col("site").cast("string").alias("site"), "page", "h1").mapInArrow(run, "site string, h1 long, n long")


def candidates(lines: DataFrame, min_pages: int, capacity: int) -> tuple[DataFrame, DataFrame]:
    """Lines whose merged count plus error bound reaches `min_pages`, and sites whose error bound alone reaches it: there
    every line stays a candidate. No line on `min_pages` pages is missed, as a count is never below the true one less the bound."""
    merged = summaries(lines, capacity).groupBy("site", "h1").agg(F.sum("n").alias("n"))
    merged = cut(merged)
    error = merged.where("h1 is null").select("site", F.col("n").alias("err"))
    counted = merged.where("h1 is not null").join(F.broadcast(error) if error.limit(10_001).count() <= 10_000 else error, "site", "left")
    return counted.where(F.col("n") + F.coalesce("err", F.lit(0)) >= min_pages).select("site", "h1"), error.where(F.col("err") >= min_pages).select("site")


def repeated_lines(lines: DataFrame, min_pages: int = MIN_PAGES, capacity: int = CAPACITY) -> DataFrame:
    """(site, h1, h2) of the lines that stand on at least `min_pages` different pages of their site, counted exactly."""
    lines = lines.where("site is not null and page is not null")
    cand, loose = candidates(lines, min_pages, capacity)
    some = lines.join(cand, ["site", "h1"], "left_semi")
    if not loose.isEmpty():
        some = some.unionByName(lines.join(loose, "site", "left_semi"))
    pages = some.select("site", "h1", "h2", "page").distinct()
    return pages.groupBy("site", "h1", "h2").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)


def occurrences(lines: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(key, line_no) of every occurrence of a confirmed line, once each."""
    confirmed = cut(confirmed).select("site", "h1", "h2")
    small = confirmed.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES
    return lines.join(F.broadcast(confirmed) if small else confirmed, ["site", "h1", "h2"], "left_semi").select("key", "line_no").distinct()


def find_repeated(df: DataFrame, site: str, page: str, key: str, text: str, min_pages: int = MIN_PAGES, capacity: int = CAPACITY) -> DataFrame:
    """(key, line_no) of every line that stands on at least `min_pages` pages of its site.

    Lines without letters never count. A row delivered twice counts once, as pages are counted, not rows. Rows with null
    site, page or text have no repeated lines. An empty table gives an empty result.
    """
    lines = cut(line_keys(df, site, page, key, text))
    return occurrences(lines, repeated_lines(lines, min_pages, capacity))


def without_repeated(df: DataFrame, site: str, page: str, key: str, text: str, out: str = "clean_text", **how) -> DataFrame:
    """`df` with `out`: the text without the lines that its site repeats. Texts that lose all lines become empty; null stays null."""
    hits = find_repeated(df, site, page, key, text, **how).groupBy(F.col("key").alias("__key")).agg(F.collect_set("line_no").alias("__cut"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda _, i: ~F.array_contains(F.col("__cut"), i + 1))
    return df.join(hits, F.col(key).eqNullSafe(F.col("__key")), "left").withColumn(out, F.when(F.col("__cut").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).drop("__key", "__cut")
