"""Comparison of a collection's items with the description they were parsed from (U8).

Passages of a description and items are compared by their words (letters and digits,
lower case). Those with the same words, each as often as the other side has it, are
kept; they are the anchors. What is left on both sides of a collection is compared by
runs of ``gram`` words: a word is covered if it stands in a run that the other side's
rest has, too.

Where less than ``percent`` of its words are covered a passage is lost and an item is
invented, else it is altered. Copies beyond the other side's count are ``fewer`` (in
the items) or ``repeated`` (by the items), with no word covered. Shorter texts than
``gram`` words have no run. Null and blank texts, and those without letters and
digits, are passed over; a description without items has only lost passages, items
without a description are all invented; a null collection is a collection.

Counts are added up before anything is sent, keys hold the collection and the words,
so a large collection is dealt over all tasks. The kept texts are sent once for each
side; runs are made of what differs alone and are sent once. Different texts of one
collection that have a run in common meet in one task, sorted and spilled, not held.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.operators.parse import parse_items
from catalith.session import scratch

GRAM, PERCENT = 3, 50


def words_of(c: Column) -> Column:
    """The words of a text, lower case, joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), " ")


def _side(rows: DataFrame, collection: str, text: str, pos: str, described: bool) -> DataFrame:
    none, place = F.lit(None).cast("bigint"), F.col(pos).cast("bigint")
    has_words = F.col(text).rlike(r"[\p{L}\p{N}]")  # not a test of the words themselves, which would find them twice
    return rows.where(has_words).select(
        F.col(collection).alias("collection"),
        words_of(F.col(text)).alias("words"),
        F.lit(int(described)).alias("d"),
        F.lit(int(not described)).alias("i"),
        (place if described else none).alias("pos_d"),
        (none if described else place).alias("pos_i"),
    )


def counted(descriptions: DataFrame, items: DataFrame, collection: str, text: str, item: str = "item_description", pos: str = "item_pos") -> DataFrame:
    """Each different text of a collection: (collection, words, n_d, n_i, pos_d, pos_i), how often and where first on both sides."""
    passages = parse_items(descriptions.select(F.col(collection).alias("c"), F.col(text).alias("t")), "t")
    both = _side(passages, "c", "item_description", "item_pos", True).unionByName(_side(items, collection, item, pos, False))
    return both.groupBy("collection", "words").agg(F.sum("d").alias("n_d"), F.sum("i").alias("n_i"), F.min("pos_d").alias("pos_d"), F.min("pos_i").alias("pos_i"))


def _written(rows: DataFrame) -> DataFrame:
    """The table, computed once, as compressed columns in the shared folder; it holds texts."""
    folder = f"{scratch(rows.sparkSession)}/compared-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _runs(units: DataFrame, gram: int) -> DataFrame:
    """Runs of words of the texts that one side alone has: (unit, described, run, at)."""
    words = F.split("words", " ")
    starts = F.sequence(F.lit(0), F.size("_w") - gram)
    rows = units.where("n_d = 0 or n_i = 0").select("collection", "unit", (F.col("n_d") > 0).alias("described"), words.alias("_w")).where(F.size("_w") >= gram)
    each = F.transform(starts, lambda k: F.xxhash64("collection", F.slice("_w", k + 1, gram)))
    return rows.select("unit", "described", F.posexplode(each).alias("at", "run"))


def _covered(starts: Column, gram: int) -> Column:
    """How many words the runs from ``starts`` (sorted) cover."""
    none = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda a, p: F.struct((p + gram).alias("end"), (a["sum"] + p + gram - F.greatest(a["end"], p)).alias("sum"))
    return F.aggregate(starts, none, step)["sum"]


def _of_counts(units: DataFrame, gram: int, percent: int) -> DataFrame:
    """``differences`` from the rows of ``counted`` whose counts differ, which are read twice."""
    units = units.withColumn("unit", F.xxhash64("collection", "words"))
    runs = _runs(units, gram)
    same = Window.partitionBy("run")
    shared = runs.withColumn("_d", F.bool_or("described").over(same)).withColumn("_i", F.bool_or(~F.col("described")).over(same)).where("_d and _i")
    hits = shared.groupBy("unit").agg(F.array_sort(F.collect_list(F.col("at").cast("bigint"))).alias("starts"))
    n_words = F.size(F.split("words", " ")).cast("bigint")
    rows = units.join(hits, "unit", "left").withColumn("n_words", n_words)
    covered = F.coalesce(_covered(F.col("starts"), gram), F.lit(0).cast("bigint"))
    described, both = F.col("n_d") > F.col("n_i"), (F.col("n_d") > 0) & (F.col("n_i") > 0)
    rows = rows.withColumn("covered", covered)
    status = (
        F.when(both, F.when(described, "fewer").otherwise("repeated"))
        .when(100 * F.col("covered") >= percent * F.col("n_words"), "altered")
        .when(described, "lost")
        .otherwise("invented")
    )
    return rows.select(
        "collection",
        F.when(described, "description").otherwise("items").alias("side"),
        F.when(described, F.col("pos_d")).otherwise(F.col("pos_i")).alias("pos"),
        F.abs(F.col("n_d") - F.col("n_i")).alias("times"),
        "n_words",
        "covered",
        status.alias("status"),
        "words",
    )


def differences(descriptions: DataFrame, items: DataFrame, collection: str, text: str, item: str = "item_description", pos: str = "item_pos", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """U8: what description and items don't share: (collection, side, pos, times, n_words, covered, status, words)."""
    counts = counted(descriptions, items, collection, text, item, pos)
    return _of_counts(_written(counts.where("n_d <> n_i")), gram, percent)


def coverage(descriptions: DataFrame, items: DataFrame, collection: str, text: str, item: str = "item_description", pos: str = "item_pos", gram: int = GRAM, percent: int = PERCENT) -> DataFrame:
    """U8: a row for each collection with words on either side.

    n_passages, n_items and n_kept count texts, n_lost, n_altered, n_invented and
    n_repeated copies of them; n_words and n_covered are the words of the description
    and those of them that the items have, share is their ratio (null without words).
    """
    counts = counted(descriptions, items, collection, text, item, pos).withColumn("n_words", F.size(F.split("words", " ")))
    counts = _written(counts.withColumn("words", F.when(F.col("n_d") != F.col("n_i"), F.col("words"))))  # kept texts are only counted
    n_words, kept, zero = F.col("n_words"), F.least("n_d", "n_i"), F.lit(0).cast("bigint")
    whole = counts.select(
        "collection",
        F.col("n_d").alias("n_passages"),
        F.col("n_i").alias("n_items"),
        kept.alias("n_kept"),
        *[zero.alias(f"n_{s}") for s in ("lost", "altered", "invented", "repeated")],
        (F.col("n_d") * n_words).alias("n_words"),
        (kept * n_words).alias("n_covered"),
    )
    told = F.col("side") == "description"
    many = lambda test: F.when(test, F.col("times")).otherwise(zero)
    rest = _of_counts(counts.where("n_d <> n_i"), gram, percent).select(
        "collection",
        *[zero.alias(c) for c in ("n_passages", "n_items", "n_kept")],
        many(F.col("status").isin("lost", "fewer")).alias("n_lost"),
        many(told & (F.col("status") == "altered")).alias("n_altered"),
        many(F.col("status") == "invented").alias("n_invented"),
        many(F.col("status") == "repeated").alias("n_repeated"),
        zero.alias("n_words"),
        F.when(told, F.col("times") * F.col("covered")).otherwise(zero).alias("n_covered"),
    )
    sums = [c for c in whole.columns if c != "collection"]
    out = whole.unionByName(rest).groupBy("collection").agg(*[F.sum(c).alias(c) for c in sums])
    return out.withColumn("share", F.try_divide("n_covered", "n_words"))
