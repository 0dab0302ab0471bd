"""Resources as bags of typed values (D2-D6): rows of a long table.

Columns: resource_id, term, pos, type, lang, value, value_resource_id, uri,
label, is_public. Values are equal if type, lang, value, value_resource_id and
uri are, nulls included (D4).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.functions.text import or_blank, strip

SCHEMA = (
    "resource_id bigint, term string, pos int, type string, lang string, value string, "
    "value_resource_id bigint, uri string, label string, is_public boolean"
)
IDENTITY = ("type", "lang", "value", "value_resource_id", "uri")

# Where the columns of the item table go (P5): column, term, language.
ITEM_COLUMNS = (
    ("item_id", "dcterms:identifier", None),
    ("parent", "dcterms:isPartOf", None),
    ("title", "dcterms:title", None),
    ("item_description", "ric-o:generalDescription", "he"),
    ("german_translation", "ric-o:generalDescription", "de"),
    ("english_translation", "ric-o:generalDescription", None),
    ("language", "ric-o:hasOrHadLanguage", None),
    ("document_type", "ric-o:hasDocumentaryFormType", None),
    ("production_technique_type", "ric-o:hasProductionTechniqueType", None),
    ("record_state", "ric-o:hasRecordState", None),
    ("main_subject", "ric-o:hasOrHadMainSubject", None),
    ("creation_date", "ric-o:hasCreationDate", None),
    ("publication_date", "ric-o:hasPublicationDate", None),
    ("creation_place", "arkivo:creationPlace", None),
    ("number_of_pages", "bibo:numPages", None),
)
# Numbers of these properties.
PROPERTY_IDS = {
    "dcterms:identifier": 10,
    "dcterms:isPartOf": 33,
    "dcterms:title": 1,
    "ric-o:title": 3541,
    "ric-o:generalDescription": 3502,
    "ric-o:hasAuthor": 3139,
    "ric-o:hasOrHadLanguage": 3201,
    "ric-o:hasDocumentaryFormType": 3163,
    "ric-o:hasProductionTechniqueType": 3240,
    "ric-o:hasRecordState": 3245,
    "ric-o:hasOrHadMainSubject": 3205,
    "ric-o:hasCreationDate": 3150,
    "ric-o:hasPublicationDate": 3241,
    "arkivo:creationPlace": 1663,
    "bibo:numPages": 106,
}


def literal(value: Column, lang: Column | str | None = None) -> Column:
    """A literal value."""
    tag = F.lit(lang) if lang is None or isinstance(lang, str) else lang
    return _value("literal", lang=tag, value=value)


def uri(address: Column, label: Column) -> Column:
    """A URI value with its label."""
    return _value("uri", uri=address, label=label)


def link(resource: Column) -> Column:
    """A value that points at a resource."""
    return _value("resource", value_resource_id=resource)


def _value(kind: str, **given: Column) -> Column:
    kinds = {"lang": "string", "value": "string", "value_resource_id": "bigint", "uri": "string", "label": "string"}
    return F.struct(
        F.lit(kind).alias("type"), *[given.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()]
    )


def wide_to_values(
    items: DataFrame,
    key: str,
    columns=ITEM_COLUMNS,
    english: str | None = None,
    property_ids: Mapping[str, int] = PROPERTY_IDS,
) -> DataFrame:
    """One row for each filled cell, in column order, with term, language and property number.

    ``english`` tags the English description (Q8: blank in one loader, en in the other).
    """
    present = [(i, c, t, english if c == "english_translation" else g) for i, (c, t, g) in enumerate(columns) if c in items.columns]
    cells = F.array(
        *[
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(t).alias("term"),
                F.lit(property_ids.get(t)).cast("int").alias("property_id"),
                F.lit(g).cast("string").alias("lang"),
                strip(F.col(c).cast("string")).alias("value"),
            )
            for i, c, t, g in present
        ]
    )
    filled = F.filter(cells, lambda x: F.coalesce(x["value"] != "", F.lit(False)))
    return items.select(F.col(key), F.explode(filled).alias("_c")).select(key, "_c.*")


def fixed_header(items: DataFrame, mapping: Mapping[str, str], constants: Mapping[str, Column] | None = None) -> DataFrame:
    """Columns renamed into a fixed order, blanks for nulls and absent columns, constants first."""
    out = [c.alias(n) for n, c in (constants or {}).items()]
    out += [(or_blank(F.col(c).cast("string")) if c in items.columns else F.lit("")).alias(h) for c, h in mapping.items()]
    return items.select(*out)


def payload(values: DataFrame, resources: DataFrame) -> DataFrame:
    """Nested form, a row per resource: header fields and term -> values in order."""
    one = F.struct("pos", *IDENTITY, "label", "is_public")
    terms = values.groupBy("resource_id", "term").agg(F.sort_array(F.collect_list(one)).alias("v"))
    bags = terms.groupBy("resource_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("term", "v")))).alias("values"))
    return resources.join(bags, resources["id"] == bags["resource_id"], "left").drop("resource_id")


def by_property(values: DataFrame) -> DataFrame:
    """The values of each resource and term as one ordered list."""
    return values.groupBy("resource_id", "term").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def signature(prefix: str = "") -> Column:
    """Value identity as one column; nulls differ from blanks."""
    return F.to_json(F.struct(*[F.col(prefix + c).alias(c) for c in IDENTITY]))


def count_properties(values: DataFrame) -> DataFrame:
    """The number of properties with a filled value or address."""
    filled = (F.coalesce(F.col("value"), F.lit("")) != "") | (F.coalesce(F.col("uri"), F.lit("")) != "")
    return values.groupBy("resource_id").agg(F.count_distinct(F.when(filled, F.col("term"))).alias("n_properties"))


def summarise(resources: DataFrame, values: DataFrame, title_term: str = "dcterms:title") -> DataFrame:
    """Header fields, media count, property count and the first 60 characters of the title."""
    title = values.where(F.col("term") == title_term).groupBy("resource_id").agg(F.substring(F.min_by("value", "pos"), 1, 60).alias("title"))
    counts = count_properties(values)
    return (
        resources.join(counts.withColumnRenamed("resource_id", "id"), "id", "left")
        .join(title.withColumnRenamed("resource_id", "id"), "id", "left")
        .select(
            "id", "created", F.size(F.coalesce("media", F.array())).alias("media"), "item_sets", "template_id", "class_id",
            F.coalesce("n_properties", F.lit(0)).alias("n_properties"), F.coalesce("title", F.lit("")).alias("title"),
        )
    )


def union_values(newer: DataFrame, older: DataFrame, skip: tuple[str, ...] = ()) -> DataFrame:
    """The newer resource's values, then those of the older whose identity it lacks.

    Both have ``pair`` besides the value columns. Values of ``skip`` terms and
    of administrative keys are not taken over. Positions follow on. ``added``
    marks what came from the older resource.
    """
    keys = ["pair", "term"]
    older = older.where(F.col("term").rlike("^(?!o:|@).*:"))
    if skip:
        older = older.where(~F.col("term").isin(*skip))
    held = newer.select(*keys, signature().alias("_s")).distinct()
    extra = older.withColumn("_s", signature()).join(held, [*keys, "_s"], "left_anti").drop("_s")
    last = newer.groupBy(*keys).agg((F.max("pos") + 1).alias("_next"))
    order = Window.partitionBy(*keys).orderBy("pos")
    extra = extra.join(last, keys, "left").withColumn("pos", (F.coalesce("_next", F.lit(0)) + F.row_number().over(order) - 1).cast("int")).drop("_next")
    return newer.withColumn("added", F.lit(False)).unionByName(extra.withColumn("added", F.lit(True)))


def union_sets(newer: Column, older: Column) -> Column:
    """The newer list, then what only the older has, order and repeats kept."""
    return F.concat(newer, F.filter(older, lambda x: ~F.array_contains(newer, x)))
