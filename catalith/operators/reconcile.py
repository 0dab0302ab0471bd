"""Reconciling tables.

Small sides are left to the optimiser: Spark broadcasts what its statistics or,
at run time, adaptive execution show to be small, and splits skewed partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.idents import collection_of, folder_of
from catalith.functions.text import language_key, strip, url_id
from catalith.operators.sequences import numbered
from catalith.session import fixed


def only_listed(rows: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in the list."""
    return rows.join(ids.select(on), on, "left_semi")


def not_done(rows: DataFrame, done: DataFrame, on: str) -> DataFrame:
    """Rows whose key is not in the list yet."""
    return rows.join(done.select(on), on, "left_anti")


def with_previous(rows: DataFrame, previous: DataFrame, on: str, suffix: str = "_processed") -> DataFrame:
    """Left join; columns of ``previous`` get the suffix."""
    other = previous.select(F.col(on), *[F.col(c).alias(f"{c}{suffix}") for c in previous.columns if c != on])
    return rows.join(other, on, "left")


def outer(items: DataFrame, general: DataFrame, on: str) -> DataFrame:
    """Full outer join; either side's rows stay."""
    return items.join(general, on, "full")


def resolve(rows: DataFrame, identifiers: DataFrame, on: str) -> tuple[DataFrame, DataFrame]:
    """(matched with resource_id, unmatched).

    ``identifiers`` has ``on``, resource_id and pos; of a repeated identifier the
    last counts. Id 0 is no match.
    """
    last = identifiers.groupBy(on).agg(F.max_by("resource_id", "pos").alias("resource_id")).where("resource_id <> 0")
    return rows.join(last, on), rows.join(last, on, "left_anti")


def find_by_value(values: DataFrame, wanted: DataFrame, term: str) -> DataFrame:
    """The least resource with a given property value, null where there is none."""
    hits = values.where(F.col("term") == term).groupBy("value").agg(F.min("resource_id").alias("resource_id"))
    return wanted.join(hits, "value", "left")


def children(parents: DataFrame, records: DataFrame, parent: str, identifier: str) -> DataFrame:
    """Records below each parent, by the derived parent id: an equi-join in place of a prefix search."""
    other = records.withColumn("_parent", folder_of(F.col(identifier)))
    return parents.join(other, parents[parent] == other["_parent"]).drop("_parent")


def starting_with(rows: DataFrame, value: str, prefixes: DataFrame, prefix: str, first: int | None = None) -> DataFrame:
    """Pairs of a row and each different prefix that its value starts with, for prefixes of any lengths.

    An equi-join in place of a comparison of all pairs: each value gives its beginnings
    of those lengths that prefixes have, so a row is sent once for each such length and
    every joined pair is a result. The lengths, at most as many as the longest
    prefix has characters, are the only thing gathered. With ``first``, of each prefix that many
    rows with the least values stay (equal ones in any order): in the order of values those that
    share a prefix stand together, so all rows are numbered once and each prefix takes the
    numbers from its first row on. Then no task holds all rows of a prefix. Nulls match nothing; an
    empty prefix matches every value that isn't null.
    """
    wanted = prefixes.where(F.col(prefix).isNotNull()).select(F.col(prefix)).distinct()
    lengths = [r[0] for r in wanted.select(F.length(prefix)).distinct().collect()]
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length(value))
    rows = rows.where(F.col(value).isNotNull())
    length, start = F.explode(fitting).alias("_n"), F.expr(f"left(`{value}`, _n)").alias("_p")
    if first is None:
        keyed = rows.select("*", length).select("*", start)
        return wanted.join(keyed, wanted[prefix] == keyed["_p"]).drop("_n", "_p")
    placed = numbered(rows, [], [value], "_place", int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    starts = placed.select(value, "_place", length).select("_place", start)
    spans = starts.groupBy("_p").agg(F.min("_place").alias("_from"), F.count("*").alias("_count"))
    spans = wanted.join(spans, wanted[prefix] == spans["_p"])
    taken = spans.select(prefix, F.explode(F.sequence("_from", F.col("_from") + F.least("_count", F.lit(first)) - 1)).alias("_place"))
    return taken.join(placed, "_place").select(prefix, *rows.columns)


def with_parents(records: DataFrame, known: DataFrame, identifier: str) -> DataFrame:
    """Folder and collection ids of each record, null where the catalogue has no such id (column ``id``)."""
    rows = records.withColumn("_f", folder_of(F.col(identifier))).withColumn("_c", collection_of(F.col(identifier)))
    ids = known.select("id").distinct()
    rows = rows.join(ids.withColumnRenamed("id", "folder"), F.col("_f") == F.col("folder"), "left")
    return rows.join(ids.withColumnRenamed("id", "collection"), F.col("_c") == F.col("collection"), "left").drop("_f", "_c")


def lacking(resources: DataFrame, values: DataFrame, term: str) -> DataFrame:
    """Resources without a value of the property."""
    has = values.where((F.col("term") == term) & F.col("value").isNotNull()).select(F.col("resource_id").alias("id"))
    return resources.join(has, "id", "left_anti")


def fill_gaps(candidates: DataFrame, present: DataFrame) -> DataFrame:
    """Candidates (resource_id, lang, value, pos) for languages that a resource lacks.

    An insert makes its language present, so of several candidates for one
    (resource, language) only the first filled one goes in.
    """
    have = present.select("resource_id", language_key(F.col("lang")).alias("lang")).distinct()
    filled = candidates.withColumn("value", strip(F.col("value"))).where("value <> ''")
    missing = filled.join(have, ["resource_id", "lang"], "left_anti")
    first = F.row_number().over(Window.partitionBy("resource_id", "lang").orderBy("pos"))
    return missing.withColumn("_n", first).where("_n = 1").drop("_n")


def redirect(values: DataFrame, moved: DataFrame, base: str) -> DataFrame:
    """Links to old ids, by number or by address, rewritten to new ids; one hop.

    ``moved`` has old and new. A rewritten number drops the snapshot in uri and
    label; a rewritten address is built anew. ``changed`` marks rewritten rows.
    """
    prefix = f"{base}/items/"
    known = moved.groupBy("old").agg(F.max("new").alias("new"))
    target = F.coalesce("value_resource_id", url_id(F.col("uri"), prefix))
    rows = values.withColumn("_target", target).join(known, F.col("_target") == F.col("old"), "left")
    hit, by_number = F.col("new").isNotNull(), F.col("value_resource_id").isNotNull()
    return rows.withColumns(
        {
            "changed": hit,
            "uri": F.when(hit & ~by_number, F.concat(F.lit(prefix), F.col("new").cast("string"))).when(~hit, F.col("uri")),
            "label": F.when(~(hit & by_number), F.col("label")),
            "value_resource_id": F.when(hit & by_number, F.col("new")).otherwise(F.col("value_resource_id")),
        }
    ).drop("_target", "old", "new")


def resolve_chains(moved: DataFrame, order: str | None = None) -> DataFrame:
    """(old, last, hops, status) of redirects (old, new) by pointer jumping.

    ``last`` is where the chain from old ends and ``hops`` how many redirects lead there.
    status is resolved, or cycle, with last and hops null, where the chain never ends.
    Of an id with several targets the last by the column ``order`` holds, else the greatest;
    a redirect of an id to itself is none.

    Each round joins open pointers with the table of pointers and doubles their
    length, so rounds grow with the logarithm of the longest chain. Ended pointers
    leave the join. A round in which none ends leaves only cycles: if a chain of any
    length were open, so would be its shorter ends.
    """
    real = moved.where("old is not null and new is not null and old <> new")
    links = real.groupBy("old").agg((F.max_by("new", order) if order else F.max("new")).alias("last"))
    ends = links.select(F.col("old").alias("_to"))
    start = links.join(ends, F.col("last") == F.col("_to"), "left")
    state = fixed(start.select("old", "last", F.lit(1).cast("bigint").alias("hops"), F.col("_to").isNull().alias("done")))
    open_ = state.where("not done").count()
    while open_:
        step = state.select(F.col("old").alias("_at"), F.col("last").alias("_last"), F.col("hops").alias("_hops"), F.col("done").alias("_done"))
        jumped = state.where("not done").join(step, F.col("last") == F.col("_at")).select("old", F.col("_last").alias("last"), (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"))
        state = fixed(state.where("done").unionByName(jumped))
        left = state.where("not done").count()
        if left == open_:
            break
        open_ = left
    return state.select(
        "old", F.when(F.col("done"), F.col("last")).alias("last"), F.when(F.col("done"), F.col("hops")).alias("hops"), F.when(F.col("done"), "resolved").otherwise("cycle").alias("status")
    )


def first_parent(links: DataFrame, identifiers: DataFrame, parent: Column) -> DataFrame:
    """For each resource the parent id that its first decodable child shows.

    ``links`` has resource_id, pos, child; ``identifiers`` has child, identifier;
    ``parent`` decodes ``identifier`` or is null.
    """
    decoded = links.join(identifiers, "child").withColumn("_p", parent).where("_p is not null")
    return decoded.groupBy("resource_id").agg(F.min_by("_p", "pos").alias("parent"))


def open_and_closed(records: DataFrame, folders: DataFrame, identifier: str) -> DataFrame:
    """Records with ``is_open``: whether their folder is in the list of open folders."""
    listed = folders.select(F.col("folder").alias("_folder")).distinct()
    rows = records.withColumn("_f", F.coalesce(folder_of(F.col(identifier)), F.col(identifier)))
    return rows.join(listed, F.col("_f") == F.col("_folder"), "left").withColumn("is_open", F.col("_folder").isNotNull()).drop("_f", "_folder")


def with_themes(collections: DataFrame, themes: DataFrame, identifier: str) -> DataFrame:
    """Theme tags by the G-F-n part of the id; collections without stay."""
    key = F.regexp_extract(identifier, r"(G-F-[0-9]+)", 1)
    return collections.withColumn("_g", key).join(themes.withColumnRenamed("family", "_g"), "_g", "left").drop("_g")


def still_missing(wanted: DataFrame, have: DataFrame, on: str) -> DataFrame:
    """Wanted ids that are absent, each once."""
    return wanted.select(on).distinct().join(have.select(on), on, "left_anti")


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union by name, absent columns null."""
    return first.unionByName(second, allowMissingColumns=True)


def in_both(first: DataFrame, second: DataFrame) -> DataFrame:
    """O11 (extension): distinct rows that both have."""
    return first.intersect(second)


def first_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """One row per key, at its first position."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(position))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def counters(rows: DataFrame, **conditions: Column) -> DataFrame:
    """How many rows meet each condition, in one pass."""
    return rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
