"""Aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_texts(rows: DataFrame, keys: list[str], text: str, position: str, separator: str = " ") -> DataFrame:
    """A1: texts of a group joined in order; nulls are passed over."""
    ordered = F.sort_array(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(position, text))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x[text]), separator).alias(text))


def ids_by_key(rows: DataFrame, key: str, identifier: str, distinct: bool = True) -> DataFrame:
    """A2: sorted ids of each key; repeated entries count once (Q10), or as often as they stand there."""
    gather = F.collect_set if distinct else F.collect_list
    return rows.groupBy(key).agg(F.sort_array(gather(identifier)).alias("ids"))


def duplicates(rows: DataFrame, key: str, identifier: str) -> DataFrame:
    """A3, A4: keys with more than one distinct id: count, least and greatest."""
    return (
        rows.groupBy(key)
        .agg(F.count_distinct(identifier).alias("n"), F.min(identifier).alias("oldest"), F.max(identifier).alias("newest"))
        .where("n > 1")
    )


def exact_pairs(rows: DataFrame, key: str, identifier: str) -> DataFrame:
    """Keys with exactly two distinct ids, as (old, new)."""
    found = duplicates(rows, key, identifier).where("n = 2")
    return found.select(key, F.col("oldest").alias("old"), F.col("newest").alias("new"))


def mode(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """A5: the most frequent value of each key; of a tie the first seen."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"), F.min(position).alias("_first"))
    return counts.groupBy(key).agg(F.max_by(F.struct(value, "n"), F.struct("n", -F.col("_first"))).alias("_m")).select(key, f"_m.{value}", "_m.n")


def pattern_counts(rows: DataFrame, left: Column, right: Column) -> DataFrame:
    """Rows of each pair of patterns, most first."""
    return rows.groupBy(left.alias("older"), right.alias("newer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "older", "newer")


def average_size(rows: DataFrame, array: str) -> DataFrame:
    """A10: the average length of a list."""
    return rows.agg(F.avg(F.size(array)).alias("average"))


def languages(values: DataFrame, key: str = "resource_id") -> DataFrame:
    """Lower-case languages of each resource, blank for untagged."""
    return values.groupBy(key).agg(F.sort_array(F.collect_set(F.lower(F.coalesce("lang", F.lit(""))))).alias("langs"))


def running_totals(rows: DataFrame, position: str, columns: list[str], keys: list[str]) -> DataFrame:
    """Running sums of token counts within each key."""
    line = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"{c}_so_far": F.sum(c).over(line) for c in columns})


def cached_share(rows: DataFrame, cached: str, total: str) -> DataFrame:
    """Sums, and the cached ones in percent of all."""
    return rows.agg(F.sum(cached).alias("cached"), F.sum(total).alias("total")).withColumn(
        "percent", 100 * F.col("cached") / F.greatest(F.lit(1), F.col("total"))
    )


def last_by_key(rows: DataFrame, key: str, position: str) -> DataFrame:
    """The last row of each key."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), position).alias("_r")).select(key, "_r.*")


def ranking(rows: DataFrame, key: str) -> DataFrame:
    """Rows per key, most first; ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key)


def status_breakdown(rows: DataFrame, key: str, status: str) -> DataFrame:
    """A map of counts by status for each key."""
    counts = rows.groupBy(key, status).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(status, "n")))).alias("statuses"), F.sum("n").alias("total"))


def distinct_in_order(lists: Column) -> Column:
    """Distinct non-blank entries of nested lists, first seen first."""
    return F.array_distinct(F.filter(F.flatten(lists), lambda x: F.coalesce(x != "", F.lit(False))))


def per_class(resources: DataFrame, labels: DataFrame, class_id: str = "class_id") -> DataFrame:
    """Resources of each class with the class label."""
    return resources.groupBy(class_id).agg(F.count("*").alias("n")).join(labels, class_id, "left")


def first_filled(values: DataFrame, keys: list[str]) -> DataFrame:
    """The first non-blank value of a property."""
    return values.where("value <> ''").groupBy(*keys).agg(F.min_by("value", "pos").alias("value"))


def cube_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Extension: counts over all grouping sets of the keys."""
    return rows.cube(*keys).agg(F.count("*").alias("n"), F.grouping_id().alias("gid"))
