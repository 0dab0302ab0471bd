"""Window-like operators (W1-W10), minting and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.idents import record_id, record_number
from catalith.functions.text import normalise_tag
from catalith.session import fixed


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str, spread: int | None = None) -> DataFrame:
    """Number the rows of each key from 1 on, in a total order.

    A window puts all rows of a key into one task. With ``spread`` the rows are
    dealt by ranges of (keys, order) to so many tasks instead, numbered within
    each, and moved up by the counts of the ranges before: for keys that hold a
    large share of all rows. The deal is checkpointed, as it is used twice.
    """
    if spread is None:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint"))
    place = F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order))
    moved = _with_before(rows, keys, order, spread, F.count("*"), F.sum).withColumn(name, (place + F.coalesce("_before", F.lit(0))).cast("bigint"))
    return moved.select(*rows.columns, name)


def highest_so_far(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, spread: int | None = None) -> DataFrame:
    """The greatest ``value`` of a key up to each row, that one included; ``spread`` as for ``numbered``."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if spread is None:
        return rows.withColumn(name, F.max(value).over(upto.partitionBy(*keys)))
    moved = _with_before(rows, keys, order, spread, F.max(value), F.max)
    return moved.withColumn(name, F.greatest(F.max(value).over(upto.partitionBy("_part", *keys)), "_before")).select(*rows.columns, name)


def _with_before(rows: DataFrame, keys: list[str], order: list[str], spread: int, part: Column, together) -> DataFrame:
    """The rows dealt by ranges (``_part``), with ``_before``: what ``part`` gives for a key's earlier ranges, put together."""
    dealt = fixed(rows.repartitionByRange(spread, *keys, *order).withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*keys, "_part").agg(part.alias("_own")).withColumn("_before", together("_own").over(earlier))
    sums = sums.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), "_before")
    on = F.col("_part") == F.col("_of")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return dealt.join(sums, on)


def mint(rows: DataFrame, collection: str, order: list[str], used: DataFrame | None = None, spread: int | None = None) -> DataFrame:
    """Add ``item_id``: the smallest unused numbers of each collection, in order.

    ``used`` holds ids (column item_id) that are taken. The n-th new row gets the
    n-th free number: the one after as many taken numbers as lie below it. Rows and
    the steps at which that count rises are put in one order, and each row takes the highest
    step so far. ``spread`` is for collections with a large share of all rows or of all
    taken numbers (see ``numbered``): then no window holds a collection.
    """
    rows = numbered(rows, [collection], order, "_n", spread)
    if used is None:
        return rows.withColumn("item_id", record_id(F.col(collection), F.col("_n"))).drop("_n")
    taken = (
        used.select(F.regexp_extract("item_id", r"^(.*)-R[0-9]+$", 1).alias("_c"), record_number(F.col("item_id")).alias("_t"))
        .where("_t >= 1")
        .distinct()
    )
    # Before the k-th taken number t, t - k numbers are free: place n moves up by the count of taken with t - k < n.
    steps = numbered(taken, ["_c"], ["_t"], "_k", spread).groupBy("_c", (F.col("_t") - F.col("_k")).alias("_free")).agg(F.max("_k").alias("_k"))
    held = F.struct(*[c for c in rows.columns if c != "_n"])
    both = rows.select(F.col(collection).alias("_c"), "_n", F.lit(True).alias("_is_row"), F.lit(None).cast("bigint").alias("_k"), held.alias("_held"))
    both = both.unionByName(steps.select("_c", (F.col("_free") + 1).cast("bigint").alias("_n"), F.lit(False).alias("_is_row"), "_k"), allowMissingColumns=True)
    moved = highest_so_far(both, ["_c"], ["_n", "_is_row"], "_k", "_shift", spread).where("_is_row")
    return moved.select("_held.*", record_id(F.col("_c"), F.col("_n") + F.coalesce("_shift", F.lit(0))).alias("item_id"))


def greatest_suffix(collection: str, *sources: DataFrame) -> DataFrame:
    """The greatest record number of each collection over several tables of ids (collection, item_id)."""
    every = sources[0].select(collection, "item_id")
    for other in sources[1:]:
        every = every.unionByName(other.select(collection, "item_id"))
    return every.groupBy(collection).agg(F.max(record_number(F.col("item_id"))).alias("last"))


def mint_after(rows: DataFrame, last: DataFrame, collection: str, order: list[str], spread: int | None = None) -> DataFrame:
    """Numbers after the greatest one in use."""
    placed = numbered(rows, [collection], order, "_n", spread).join(last, collection, "left")
    return placed.withColumn("item_id", record_id(F.col(collection), F.coalesce("last", F.lit(0)) + F.col("_n"))).drop("_n", "last")


def older_than_newest(rows: DataFrame, key: str, identifier: str) -> DataFrame:
    """Of each key all rows but the one with the greatest id."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(identifier)))
    return rows.withColumn("_n", n).where("_n > 1").drop("_n")


def classify_first_wins(rows: DataFrame, key: str, position: str, bad: Column, automatic: Column) -> DataFrame:
    """``outcome`` of each row: bad, auto, duplicate or insert; the first good row of a key is inserted."""
    good = ~bad & ~automatic
    line = Window.partitionBy(key).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    seen = F.coalesce(F.max(good).over(line), F.lit(False))
    return rows.withColumn("outcome", F.when(bad, "bad").when(automatic, "auto").when(seen, "duplicate").otherwise("insert"))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each key the row that comes last."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def top_per_key(rows: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The first ``n`` rows of each key."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= n)


def family_tags(rows: DataFrame, family: str, position: str, tags: Column, translations: DataFrame, marker: str | None = None, n: int = 10) -> DataFrame:
    """The first tags of each family with their translations.

    Tags are distinct within a row, not within a family (Q14).
    """
    clean = F.array_distinct(F.transform(tags, normalise_tag))
    parts = rows.select(F.col(family).alias("family"), F.col(position).alias("_p"), F.posexplode(clean).alias("_i", "he"))
    parts = parts.where((F.length("he") > 2) & (F.length("he") < 50))
    if marker:
        parts = parts.where(~F.col("he").contains(marker))
    first = top_per_key(parts, "family", ["_p", "_i"], n)
    named = first.join(translations, "he", "left").select(
        "family", "place", F.struct("he", F.coalesce("en", "he").alias("en"), F.coalesce("de", "he").alias("de")).alias("tag")
    )
    return named.groupBy("family").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "tag"))), lambda x: x["tag"]).alias("tags"))


def sample_per_class(rows: DataFrame, cell: str, order: str) -> DataFrame:
    """The first row of each first-listed class."""
    first = F.trim(F.get(F.split(F.coalesce(F.col(cell), F.lit("")), r"\|"), F.lit(0)))
    return top_per_key(rows.withColumn("class", first), "class", [order], 1).drop("place")


def siblings(rows: DataFrame, parent: str, identifier: str) -> DataFrame:
    """Position, number of siblings, and the ones before and after, by byte order; no cap (Q16)."""
    line = Window.partitionBy(parent).orderBy(identifier)
    return rows.withColumns(
        {
            "position": F.row_number().over(line),
            "total": F.count("*").over(Window.partitionBy(parent)),
            "previous": F.lag(identifier).over(line),
            "next": F.lead(identifier).over(line),
        }
    )


def page(rows: DataFrame, order: list[str], number: int = 1, size: int = 25) -> DataFrame:
    """One page of the sorted rows."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)
