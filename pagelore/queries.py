"""Registered queries of the core and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.operators import nested, reports, snapshots
from pagelore.plans import block_queries, evidence_queries, more_queries, page_queries, relational_queries, session_queries, text_queries
from pagelore.session import table

AREAS = [text_queries, block_queries, evidence_queries, page_queries, session_queries, relational_queries, more_queries]

REF_INDEX = dict(entity="page_id", snapshot="snapshot_id", taken="taken_at", ref="stable_ref", ingested="ingested_at", compare=["block_kind", "block_role", "text"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.snapshot_changes(table(spark, d, "ref_index"), **REF_INDEX)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.change_counts(table(spark, d, "ref_index"), **REF_INDEX)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return reports.children(table(spark, d, "report_records"), "record_id", "payload")


def p4_levels(spark: SparkSession, d: str) -> DataFrame:
    """Rows and records of every array level of the merged schema."""
    out = None
    for path, t in nested.flat_tables(table(spark, d, "report_records"), "record_id", "payload").items():
        part = t.agg(F.lit(path).alias("path"), F.count("*").alias("elements"), F.count_distinct("record_id").alias("records"))
        out = part if out is None else out.union(part)
    return out if out is not None else spark.createDataFrame([], "path string, elements long, records long")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """For every claim asked on a captured page: the verdict, its support and its confidence."""
    return evidence_queries.e32_verdicts(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {"p3_found": p3_found, "p3_counts": p3_counts, "p4_found": p4_found, "p4_levels": p4_levels}
    for area in AREAS:
        out |= area.queries()
    return out


def oracle_sql() -> dict[str, str]:
    held = """
        WITH held AS (
          SELECT page_id, snapshot_id, stable_ref, block_kind, block_role, text FROM (
            SELECT *, row_number() OVER (PARTITION BY page_id, snapshot_id, stable_ref ORDER BY ingested_at DESC) AS rn FROM ref_index) x WHERE rn = 1),
        seqs AS (
          SELECT page_id, snapshot_id, row_number() OVER (PARTITION BY page_id ORDER BY taken_at, snapshot_id) AS seq
          FROM (SELECT page_id, snapshot_id, min(taken_at) AS taken_at FROM ref_index GROUP BY 1, 2) y),
        cur AS (SELECT h.*, s.seq FROM held h JOIN seqs s USING (page_id, snapshot_id))"""
    pairs = """
          SELECT s.page_id, s.snapshot_id, coalesce(a.stable_ref, b.stable_ref) AS stable_ref,
            CASE WHEN b.stable_ref IS NULL THEN 'added' WHEN a.stable_ref IS NULL THEN 'removed'
              WHEN a.block_kind IS DISTINCT FROM b.block_kind OR a.block_role IS DISTINCT FROM b.block_role OR a.text IS DISTINCT FROM b.text THEN 'changed'
              ELSE 'retained' END AS change_kind
          FROM seqs s
          JOIN (SELECT page_id, seq, stable_ref FROM cur UNION SELECT page_id, seq + 1, stable_ref FROM cur) k ON k.page_id = s.page_id AND k.seq = s.seq
          LEFT JOIN cur a ON a.page_id = s.page_id AND a.seq = s.seq AND a.stable_ref = k.stable_ref
          LEFT JOIN cur b ON b.page_id = s.page_id AND b.seq = s.seq - 1 AND b.stable_ref = k.stable_ref
          WHERE s.seq > 1"""
    out = {
        "p3_found": f"{held} SELECT * FROM ({pairs}) z WHERE change_kind <> 'retained'",
        "p3_counts": f"""{held} SELECT page_id, snapshot_id, count(*) FILTER (change_kind = 'added') AS added, count(*) FILTER (change_kind = 'removed') AS removed,
            count(*) FILTER (change_kind = 'changed') AS changed, count(*) FILTER (change_kind = 'retained') AS retained FROM ({pairs}) z GROUP BY 1, 2""",
    }
    for area in AREAS:
        out |= area.oracle_sql()
    return out
