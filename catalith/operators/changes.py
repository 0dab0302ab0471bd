"""Changes to a catalogue.

A change set is a table of rows (op, resource_id, term, pos, type, lang, value,
value_resource_id, uri, label, is_public, seq); op is insert, update, delete or drop
(the whole resource). It is lazy: building one is the dry run (M13). ``apply``
merges it by column and never touches values that no row names (M12).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import sql_literal, strip
from catalith.operators.reconcile import redirect, resolve_chains
from catalith.operators.sequences import numbered
from catalith.operators.values import IDENTITY, union_values

VALUE = ("resource_id", "term", "pos", *IDENTITY, "label", "is_public")


def change(rows: DataFrame, op: str) -> DataFrame:
    """Rows as changes; absent columns are null. ``seq`` is the place of a change in the order in which they were written."""
    kinds = {"resource_id": "bigint", "pos": "int", "value_resource_id": "bigint", "is_public": "boolean", "seq": "bigint"}
    return rows.select(
        F.lit(op).alias("op"),
        *[(F.col(c) if c in rows.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in (*VALUE, "seq")],
    )


def in_order(*sets: DataFrame) -> DataFrame:
    """Change sets one after another: whatever a later set says comes after all of the earlier ones."""
    placed = [s.withColumn("seq", F.struct(F.lit(k).alias("set"), F.col("seq").alias("seq"))) for k, s in enumerate(sets)]
    every = placed[0]
    for s in placed[1:]:
        every = every.unionByName(s)
    return every


def apply(values: DataFrame, changes: DataFrame) -> DataFrame:
    """The table after the changes: drops, deletes and updates by (resource, term, pos), then inserts.

    Of several updates of one place the last by ``seq`` holds; where that is equal or
    absent, the one with the greatest value and language. An insert whose value (of
    an address with its label) the resource has already under the term is passed over, and so is one
    that repeats another, so applying a set of inserts twice is applying it once (T3).
    Inserted values follow the existing ones, by ``seq``, then by ``pos``.
    Values pass through two joins, with what is dropped and with updates and deletes by
    place. Only inserts are ordered by windows, and with them, without their other columns,
    the values of a resource that gets inserts. What changes name is dealt to
    all shuffle partitions: rows of a catalogue shrink so much while they are sent that partitions put
    together by the size sent would be large in memory.
    """
    group, place = ["resource_id", "term"], ["resource_id", "term", "pos"]
    fresh = [c for c in VALUE if c not in place]
    if "seq" not in changes.columns:
        changes = changes.withColumn("seq", F.lit(None).cast("bigint"))
    dropped = _dealt(changes.where("op = 'drop'").select("resource_id"), "resource_id").distinct()
    # A delete comes before the updates of its place, then the last update.
    first = Window.partitionBy(*place).orderBy("op", *[F.desc(c) for c in ("seq", "value", "lang", *fresh)])
    named = _dealt(changes.where("op in ('update', 'delete') and pos is not null").select(*place, *fresh, "op", "seq"), *place)
    named = named.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*place, F.col("op").alias("_op"), *[F.col(c).alias(f"_{c}") for c in fresh])
    kept = values.select(*VALUE).join(dropped, "resource_id", "left_anti").join(named, place, "left").where("_op is null or _op = 'update'")
    kept = kept.select(*place, *[F.when(F.col("_op").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fresh])
    new = changes.where("op = 'insert'").join(dropped, "resource_id", "left_anti")
    touched = _dealt(new.select("resource_id"), "resource_id").distinct()
    label = F.when(F.col("type") == "uri", F.col("label")).alias("_label")
    # What an own value needs here: its identity and place.
    none = [F.lit(None).cast(changes.schema[c].dataType).alias(c) for c in ("label", "is_public", "seq")]
    own = kept.join(touched, "resource_id", "left_semi").select(*place, *IDENTITY, label, *none, F.lit(False).alias("_new"))
    rows = _dealt(own.unionByName(new.select(*place, *IDENTITY, label, "label", "is_public", "seq", F.lit(True).alias("_new"))), *group)
    turn = F.row_number().over(Window.partitionBy(*group, *IDENTITY, "_label").orderBy("_new", "seq", "pos"))
    end = F.max(F.when(~F.col("_new"), F.col("pos"))).over(Window.partitionBy(*group))
    rows = rows.withColumn("_turn", turn).withColumn("_end", end).where("_new and _turn = 1")
    same = F.to_json(F.struct(*IDENTITY, F.col("_label").alias("label")))
    line = F.row_number().over(Window.partitionBy(*group).orderBy("seq", "pos", same))
    rows = rows.withColumn("pos", (F.coalesce(F.col("_end") + 1, F.lit(0)) + line - 1).cast("int"))
    return kept.unionByName(rows.select(*VALUE))


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by key in as many partitions as the session shuffles to, not put together to fewer."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def insert_resources(values: DataFrame) -> DataFrame:
    """M1: all values of new resources."""
    return change(values, "insert")


def enrich(mapping: DataFrame, identifiers: DataFrame, last: int, label: Column, sources: DataFrame | None = None, spread: int | None = None) -> DataFrame:
    """M2: what to do with each document: enrich, create under its legacy id, or create under a new number.

    ``mapping`` has doc_id, legacy_id (an id or NEW) and a unique pos;
    ``identifiers`` has identifier and resource_id. Documents of one absent
    legacy id are created once (Q18). With ``sources`` (resource_id, uri, label),
    a mapping with uri has the outcome already where its resource has the
    address under the same label, also by an earlier row. ``number`` follows
    ``last`` in input order; ``spread`` deals the new rows to so many tasks.
    """
    known = identifiers.groupBy("identifier").agg(F.min("resource_id").alias("resource_id"))
    rows = mapping.join(known, mapping["legacy_id"] == known["identifier"], "left").drop("identifier")
    new, found = F.col("legacy_id") == "NEW", F.col("resource_id").isNotNull()
    firsts = rows.where(~found & ~new).groupBy("legacy_id").agg(F.min("pos").alias("_first"))
    rows = rows.join(firsts, "legacy_id", "left").withColumn("label", label)
    had = F.lit(False)
    if sources is not None:
        have = sources.select(F.col("resource_id").alias("_of"), F.col("uri").alias("_uri"), F.col("label").alias("_label")).distinct()
        same = (F.col("resource_id") == F.col("_of")) & (F.col("uri") == F.col("_uri")) & F.col("label").eqNullSafe(F.col("_label"))
        rows = rows.join(have, same, "left").withColumn("_had", F.col("_of").isNotNull()).drop("_of", "_uri", "_label")
        turn = F.row_number().over(Window.partitionBy("resource_id", "uri", "label").orderBy("pos"))
        others = rows.where(~found).withColumn("_turn", F.lit(1))
        rows = rows.where(found).withColumn("_turn", turn).unionByName(others)
        had = F.col("_had") | (F.col("_turn") > 1)
    action = F.when(new, "mint").when(found & had, "already").when(found, "enrich").when(F.col("pos") == F.col("_first"), "create").otherwise("enrich_created")
    rows = rows.withColumn("action", action).select(*mapping.columns, "resource_id", "action", "label")
    minted = numbered(rows.where("action = 'mint'"), [], ["pos"], "number", spread).withColumn("number", F.col("number") + F.lit(last))
    return minted.unionByName(rows.where("action <> 'mint'").withColumn("number", F.lit(None).cast("bigint")))


def merge_pairs(values: DataFrame, pairs: DataFrame, skip: tuple[str, ...] = (), follow: bool = False) -> DataFrame:
    """Changes that move what the older resource has alone to the newer and drop the older.

    ``pairs`` has old and new; a pair of one id with itself is passed over (Q10).
    With ``follow`` chains of pairs end at their last resource, which gets the values of all;
    pairs that lead into a cycle are passed over.
    """
    pairs = pairs.where("old <> new").distinct()
    if follow:
        pairs = followed(pairs)
    older = values.join(pairs.select(F.col("old").alias("resource_id"), F.col("new").alias("pair")), "resource_id")
    newer = values.join(pairs.select(F.col("new").alias("resource_id"), F.col("new").alias("pair")).distinct(), "resource_id")
    merged = union_values(newer, older, skip).where("added").withColumn("resource_id", F.col("pair"))
    return change(merged, "insert").unionByName(change(pairs.select(F.col("old").alias("resource_id")), "drop"))


def redirects(*maps: DataFrame) -> DataFrame:
    """(old, new) of several merges as one table."""
    out = maps[0].select("old", "new")
    for other in maps[1:]:
        out = out.unionByName(other.select("old", "new"))
    return out.distinct()


def followed(moved: DataFrame, order: str | None = None) -> DataFrame:
    """(old, new) with new at the end of the chain of redirects; without those that lead into a cycle."""
    return resolve_chains(moved, order).where("status = 'resolved'").select("old", F.col("last").alias("new"))


def rewrite_links(values: DataFrame, moved: DataFrame, base: str, follow: bool = False) -> DataFrame:
    """M5: updates of links to merged resources, with ``follow`` to the end of chains. All values of a changed property are carried."""
    rows = redirect(values, followed(moved) if follow else moved, base)
    touched = rows.where("changed").select("resource_id", "term").distinct()
    return change(rows.join(touched, ["resource_id", "term"], "left_semi"), "update")


def reclass(resources: DataFrame, condition: Column, class_id: int, template_id: int | None = None) -> DataFrame:
    """M6: resources with class, and template, replaced where the condition holds."""
    out = {"class_id": F.when(condition, F.lit(class_id)).otherwise(F.col("class_id"))}
    if template_id is not None:
        out["template_id"] = F.when(condition, F.lit(template_id)).otherwise(F.col("template_id"))
    return resources.withColumns(out)


def add_set(resources: DataFrame, condition: Column, set_id: int) -> DataFrame:
    """M7: the set added at the end where the condition holds and it is absent."""
    sets = F.coalesce("item_sets", F.array().cast("array<int>"))
    more = F.when(condition & ~F.array_contains(sets, set_id), F.concat(sets, F.array(F.lit(set_id)))).otherwise(sets)
    return resources.withColumn("item_sets", more)


def delete(resources: DataFrame, targets: DataFrame, on: str = "id") -> DataFrame:
    """M8: resources without the targets."""
    return resources.join(targets.select(on), on, "left_anti")


def restore_identifiers(parents: DataFrame, values: DataFrame, term: str = "dcterms:identifier") -> DataFrame:
    """M9: inserts of identifiers (resource_id, parent) for resources that have none."""
    have = values.where((F.col("term") == term) & F.col("value").isNotNull()).select("resource_id")
    rows = parents.join(have, "resource_id", "left_anti")
    return change(rows.select("resource_id", F.lit(term).alias("term"), F.lit(0).alias("pos"), F.lit("literal").alias("type"), F.col("parent").alias("value"), F.lit(True).alias("is_public")), "insert")


def relabel_titles(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """(op, resource_id, value_id, lang, value) for rows (resource_id, bilingual, latin, hebrew, pos).

    ``titles`` has value_id, resource_id, lang and value. The Latin half is
    inserted as en where there is no en title. The Hebrew half relabels the
    first untagged title that equals the bilingual text, or is inserted where
    there is none; not where there is a he title. Titles are read once.
    """
    tag = F.coalesce("lang", F.lit(""))
    state = titles.groupBy("resource_id").agg(F.bool_or(tag == "en").alias("_en"), F.bool_or(tag == "he").alias("_he"))
    plain = titles.where(tag == "").groupBy("resource_id", strip(F.col("value")).alias("_t")).agg(F.min("value_id").alias("value_id"))
    held = rows.withColumn("_t", strip(F.col("bilingual"))).where("_t <> ''")
    held = held.join(state, "resource_id", "left").join(plain, ["resource_id", "_t"], "left")
    held = held.withColumns({"_en": F.coalesce("_en", F.lit(False)), "_he": F.coalesce("_he", F.lit(False))})
    english = held.where("latin is not null and not _en").select(
        F.lit("insert").alias("op"), "resource_id", F.lit(None).cast("bigint").alias("value_id"), F.lit("en").alias("lang"), F.col("latin").alias("value")
    )
    hebrew = held.where("hebrew is not null and not _he").select(
        F.when(F.col("value_id").isNotNull(), "update").otherwise("insert").alias("op"), "resource_id", F.col("value_id").cast("bigint"), F.lit("he").alias("lang"), F.col("hebrew").alias("value")
    )
    return english.unionByName(hebrew)


def edit(rows: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """Rows after human edits: per key the last of add, modify or delete by ``pos`` holds."""
    others = [c for c in rows.columns if c != key]
    last = edits.groupBy(key).agg(F.max_by(F.struct("op", *others), "pos").alias("_e"))
    kept = rows.join(last, key, "left_anti")
    return kept.unionByName(last.where("_e.op <> 'delete'").select(key, *[F.col(f"_e.{c}") for c in others]).select(*rows.columns))


def sql_script(changes: DataFrame, property_ids: Column) -> DataFrame:
    """K7: one SQL line a change, updates before inserts, within one transaction; (n, line)."""
    value, lang = sql_literal(F.col("value")), F.col("lang")
    line = F.when(
        F.col("op") == "update", F.format_string("UPDATE value SET lang='%s', value='%s' WHERE id=%d;", lang, value, F.col("value_id"))
    ).otherwise(
        F.format_string(
            "INSERT INTO value (resource_id, property_id, type, lang, value, is_public) VALUES (%d, %d, 'literal', '%s', '%s', 1);",
            F.col("resource_id"), property_ids, lang, value,
        )
    )
    body = changes.select(F.when(F.col("op") == "update", 1).otherwise(2).alias("n"), line.alias("line"))
    spark = changes.sparkSession
    ends = spark.range(2).select(F.when(F.col("id") == 0, 0).otherwise(3).alias("n"), F.when(F.col("id") == 0, "START TRANSACTION;").otherwise("COMMIT;").alias("line"))
    return body.unionByName(ends).orderBy("n", "line")
