"""The pN_ queries of this package over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelore.llm import mainbody, mixing, packing, residue, site_lines, toxicity, unify
from pagelore.llm.tokens import token_count
from pagelore.session import table


def texts_of_pages(spark: SparkSession, d: str) -> DataFrame:
    """field, key, page_id and text of claim statements, primary support snippets and block texts."""
    claims = table(spark, d, "claim_outcomes")
    blocks = table(spark, d, "snapshot_blocks")
    return (
        claims.select(F.lit("statement").alias("field"), F.col("outcome_id").alias("key"), "page_id", F.col("claim_statement").alias("text"))
        .union(claims.select(F.lit("snippet"), "outcome_id", "page_id", "primary_support_snippet.snippet"))
        .union(blocks.select(F.lit("block_text"), "block_key", "page_id", "text"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return unify.same_reading_pairs(texts_of_pages(spark, d), "key", "text", ["field", "page_id"]).select("field", "key_a", "key_b")


def p1_unified(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its one consistent form."""
    return texts_of_pages(spark, d).select("field", "key", "page_id", unify.unify("text").alias("text"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.find_repeated(table(spark, d, "snapshot_blocks"), "site", "page_id", "block_key", "text").select(F.col("key").alias("block_key"), "line_no")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Block texts without the lines of their site."""
    blocks = table(spark, d, "snapshot_blocks", "block_key", "site", "page_id", "text").dropDuplicates(["block_key"])
    return site_lines.without_repeated(blocks, "site", "page_id", "block_key", "text").select("block_key", "clean_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "captures", "capture_id", "page_id", "source_url", "visible_text").toDF("key", "page", "url", "text")
    blocks = table(spark, d, "snapshot_blocks", "block_key", "page_id", "source_url", "text").toDF("key", "page", "url", "text")
    states = table(spark, d, "search_profile_state", "state_id", "last_challenge_at")
    bad = states.where(residue.not_a_time(F.col("last_challenge_at"))).select(F.lit("last_challenge_at"), "state_id").distinct()
    return residue.find_residue(pages, blocks).union(bad)


def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "snapshot_blocks", "block_key", "capture_id", "site", "page_id", "block_kind", "block_zone", "source_url", "text").toDF("key", "capture", "site", "page", "kind", "zone", "url", "text")


def page_html(spark: SparkSession, d: str) -> DataFrame:
    """One html of each capture; captures delivered twice are the same."""
    return table(spark, d, "captures", "capture_id", "site", "page_id", "current_html").toDF("capture", "site", "page", "html")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mainbody.boilerplate(page_blocks(spark, d), page_html(spark, d)).select(F.col("key").alias("block_key"))


def p6_main(spark: SparkSession, d: str) -> DataFrame:
    """The blocks of the main body of each capture, in page order."""
    blocks = table(spark, d, "snapshot_blocks", "block_key", "capture_id", "ord", "text").dropDuplicates(["block_key"])
    return blocks.where("trim(text) <> ''").join(p6_found(spark, d), "block_key", "left_anti").select("capture_id", "ord", "block_key", "text")


def p6_html(spark: SparkSession, d: str) -> DataFrame:
    """The main text of each capture from its html."""
    return mainbody.main_text(table(spark, d, "captures"), "capture_id", "page_id", "site", "source_url", "current_html")


def p7_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every text in a window of each token budget."""
    docs = table(spark, d, "documents", "doc_id", "text").select("doc_id", token_count("text").alias("tokens"))
    return packing.fill_windows(docs, "doc_id", "tokens", table(spark, d, "pack_budgets"), "budget_name", "capacity_tokens")


def p7_room(spark: SparkSession, d: str) -> DataFrame:
    """How full the windows of each budget are."""
    w = p7_windows(spark, d).where("window is not null").groupBy("budget", "capacity", "window").agg(F.sum("tokens").alias("tokens"))
    n = w.groupBy("budget", "capacity").agg(F.count("*").alias("windows"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return n.withColumn("fill", F.col("tokens") / (F.col("windows") * F.col("capacity")))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents", "doc_id", "source", "text").select("doc_id", "source", token_count("text").alias("tokens"))
    return mixing.mix(docs, "doc_id", "source", "tokens", table(spark, d, "mix_targets"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen texts and how often each is used."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Of every document the probability of its worst passage, by category, and whether it is flagged."""
    docs = table(spark, d, "documents")
    chain = toxicity.fitted(toxicity.labelled(docs, "doc_id", "text", table(spark, d, "review_labels"), "doc_id", "label", "reviewer"))
    return toxicity.score(docs, "doc_id", "text", chain, "source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where("flagged").select("doc_id")


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(p9_scores(spark, d), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {}
