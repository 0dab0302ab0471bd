"""Mixing sources to target weights by capped water-filling.

A source with weight w gets the share level * w of the words, clamped at
``max_epochs`` times its own size; what clamped sources leave goes to the
others in proportion to their weights, until none is above its clamp. Sorted by
clamp / weight the clamped sources are a prefix, so two running sums give the
level without a loop. Each document is then taken a whole number of times, and
a seeded order of the documents decides which are taken once more; the document
at which the target is reached is taken in part. Everything is DataFrame code.

Null texts have size 0; the null source is a source of its own, last in order.
Repeated rows count each for itself and are ordered by doc_id and size. A source
without words has target 0. Other columns are passed over; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import cut, word_count

#: Sources up to which the table of targets is broadcast; it is counted first.
BROADCAST_SOURCES = 20_000
#: Buckets of the seeded order: three hex digits.
BUCKETS = 4096


def cycle_weights(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Give sources, by code point and null last, the weights in turn."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    values = F.array(*[F.lit(float(w)) for w in weights])
    return sources.withColumn("weight", F.get(values, (rank - 1) % len(weights)))


def water_fill(sources: DataFrame, max_epochs: float = 3.0) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight).

    The window runs over one row per source, not over documents.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    order = Window.orderBy(cap / F.col("weight"), F.col("source").asc_nulls_first())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(every)
    rows = sources.withColumn("_at", F.row_number().over(order)).withColumn("_level", (total - before) / free)
    rows = rows.withColumn("_free", cap > F.col("_level") * F.col("weight"))
    level = F.min_by("_level", F.when(F.col("_free"), F.col("_at"))).over(every)
    return rows.select(
        "source",
        "source_size",
        "weight",
        F.when(F.col("_free"), F.least(cap, level * F.col("weight"))).otherwise(cap).alias("target"),
    )


def mix(docs: DataFrame, weigh, size: Column, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken).

    ``weigh`` maps the table (source, source_size) to one with ``weight``. The
    seeded order is that of md5(seed:doc_id). Its first hex digits are buckets:
    sums by bucket find the bucket in which a source's target is reached, and
    only that bucket's documents, 1 in ``BUCKETS``, are ordered one by one.
    """
    rows = cut(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            size.alias("size"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("_key"),
        ).withColumn("_bucket", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int"))
    )
    by_bucket = cut(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_size")))
    sources = by_bucket.groupBy("source").agg(F.sum("_size").alias("source_size"))
    targets = water_fill(weigh(sources), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("_whole", whole.cast("long")).withColumn(
        "_rest", F.greatest(F.lit(0), F.round("target").cast("long") - F.col("_whole") * F.col("source_size"))
    )
    targets = cut(targets)
    running = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    reached = (
        _null_safe(by_bucket.withColumn("_before", F.coalesce(F.sum("_size").over(running), F.lit(0))), targets, "source")
        .where((F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_size")))
        .groupBy("source")
        .agg(F.min(F.struct("_bucket", "_before")).alias("_edge"))
    )
    plan = _null_safe(targets, reached, "source", "left")
    plan = cut(plan.withColumn("_at", F.coalesce("_edge._bucket", F.lit(BUCKETS))).withColumn("_before", F.col("_edge._before")).drop("_edge"))
    if plan.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    joined = _null_safe(rows, plan, "source")
    outside = joined.where(F.col("_bucket") != F.col("_at")).withColumn(
        "_extra", F.when(F.col("_bucket") < F.col("_at"), F.col("size")).otherwise(F.lit(0))
    )
    line = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("_rest") - F.col("_before") - F.coalesce(F.sum("size").over(line), F.lit(0))
    inside = joined.where(F.col("_bucket") == F.col("_at")).withColumn(
        "_extra", F.greatest(F.lit(0), F.least(F.col("size"), left))
    )
    return outside.unionByName(inside).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_whole") * F.col("size") + F.col("_extra")).cast("long").alias("taken"),
    )


def _null_safe(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    other = right.withColumnRenamed(key, "_right")
    return left.join(other, F.col(key).eqNullSafe(F.col("_right")), how).drop("_right")


def op2_mix(docs: DataFrame) -> DataFrame:
    """All documents mixed with weights 5, 2, 1 in turn and three epochs at most."""
    taken = mix(docs, lambda s: cycle_weights(s, (5, 2, 1)), word_count(F.col("text")))
    return taken.select("doc_id", "size", "source_size", "target", "taken")
