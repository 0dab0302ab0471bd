"""Resumable jobs as streams (T1-T4), and labelled extensions on event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_available(source: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, output: str, checkpoint: str) -> StreamingQuery:
    """Process what is new, each key once, and stop; a restart goes on where it ended.

    Which keys have come is streaming state, so a batch costs what its own rows cost, and
    no batch reads what earlier ones have written. A batch writes a folder of its number;
    one that is repeated after a failure overwrites its own folder and leaves the others
    alone. ``read_output`` gives all batches as one table.
    """

    def write(batch: DataFrame, number: int) -> None:
        step(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    once = source.dropDuplicates([key])
    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_output(spark: SparkSession, output: str) -> DataFrame:
    """What ``run_available`` has written so far."""
    return spark.read.parquet(output).drop("batch")


def upsert_new(rows: DataFrame, present: DataFrame, identity: list[str]) -> DataFrame:
    """Rows whose identity is absent, nulls equal to nulls; inserting them twice is inserting them once."""
    name = F.to_json(F.struct(*identity))
    have = present.select(name.alias("_i")).distinct()
    return rows.dropDuplicates(identity).withColumn("_i", name).join(have, "_i", "left_anti").drop("_i")


def outcome_counts(rows: DataFrame, ok: Column) -> DataFrame:
    """T4: rows done and failed."""
    return rows.agg(F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed"))


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """The stream with a watermark on ``ts``, which has to be an instant; a time without a zone is one of the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Extension: count and sum per window and type; ``late`` is the watermark of a stream."""
    rows = _watermarked(events, late) if late else events
    grouped = rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Extension: sessions of each user."""
    rows = _watermarked(events, late) if late else events
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Extension: each event id once, within the watermark."""
    return _watermarked(events, late).dropDuplicatesWithinWatermark(["event_id"])
