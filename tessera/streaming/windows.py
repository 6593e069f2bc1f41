"""Structured Streaming over files, for queries and for the history's upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import history
from tessera.sources.tables import Versions, scratch


def daily(events: DataFrame) -> DataFrame:
    """Counts and sums of each day and type, late rows up to a day."""
    g = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def run_once(plan: Callable[[DataFrame], DataFrame], rows: DataFrame, spark: SparkSession) -> DataFrame:
    """Write rows as files, stream them through plan until none is left, and read the last complete result."""
    root = scratch(spark, "stream")
    rows.write.parquet(f"{root}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{root}/in")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{number}")

    q = plan(source).writeStream.outputMode("complete").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    last = max(int(p["batchId"]) for p in q.recentProgress) if q.recentProgress else 0
    for number in range(last, -1, -1):
        try:
            return spark.read.parquet(f"{root}/out/{number}")
        except Exception as e:  # a trigger without data writes nothing
            if "PATH_NOT_FOUND" not in str(e) or number == 0:
                raise
    raise ValueError("no batch was written")


def sync_batches(observations: DataFrame, all_observations: Callable[[], DataFrame], target: Versions, state: Versions, checkpoint: str):
    """A stream of new observations that keeps a history up to date: each batch syncs once and is safe to repeat."""

    def put(batch: DataFrame, number: int) -> None:
        history.sync(all_observations(), target, state)

    return observations.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
