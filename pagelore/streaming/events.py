"""Event streams: windows with late data, duplicates, and a stateful fold, as Structured Streaming."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelore.session import shared_dir, ship


def stream(spark: SparkSession, path: str) -> DataFrame:
    """A directory or file of parquet as a stream."""
    ship(spark)
    schema = spark.read.parquet(path).schema
    # as a pattern, a single file will do too
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(f"{path[:-1]}[{path[-1]}]")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(spark: SparkSession, df: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives until its present input is used up, from a table in the shared folder."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    sink: Callable[[DataFrame, int], None] = lambda b, i: b.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{at}/out")
    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(sink).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{at}/out")


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    w = F.window("ts", width, step)
    return events.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


def visits(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of a user: events with gaps under `gap`."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def once(events: DataFrame, late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running_failures(events: DataFrame) -> DataFrame:
    """Of each user the greatest run of consecutive errors so far, kept as state across batches; one row for each batch of a user."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        run, most = state.get if state.exists else (0, 0)
        for kind in pd.concat(list(batches)).sort_values(["ts", "event_id"])["event_type"]:
            run = run + 1 if kind == "error" else 0
            most = max(most, run)
        state.update((run, most))
        yield pd.DataFrame({"user_id": [key[0]], "run": [run], "most": [most]})

    return events.groupBy("user_id").applyInPandasWithState(fold, "user_id long, run int, most int", "run int, most int", "update", GroupStateTimeout.NoTimeout)
