"""Controlled vocabularies and routing of items to classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.json import split_cell
from catalith.functions.text import slug, strip

# Choices for classified fields.
CLASSES = (
    "Certificate", "Communication Document", "Creative Fiction", "Creative Nonfiction", "EgoDocument", "Ephemera", "Image",
    "Legal Document", "Report", "Medical Document", "Financial_Document", "Organization Papertrail",
)
FORMATS = ("Handwritten|כתב-יד", "Typewritten|הדפסה", "Print|דפוס", "Visual Element|אלמנט ויזואלי", "Unknown|לא ידוע")
LANGUAGES = ("Hebrew|עברית", "English|אנגלית", "German|גרמנית", "Other|אחר", "Unspecified|לא צוין", "Irrelevant|לא רלוונטי")
TECHNIQUES = ("print", "handwriting", "drawing", "typewriting", "photography", "born-digital", "other")
RECORD_STATES = ("draft", "original", "copy", "other")


def bilingual(entries: list[str]) -> list[tuple[str, str]]:
    """Q6: distinct entries cut at their first bar."""
    return list(dict.fromkeys(tuple((e.split("|", 1) + [""])[:2]) for e in entries))


def extend(vocabulary: DataFrame, entries: DataFrame) -> DataFrame:
    """Add stripped, non-blank entries (column ``entry``) that are not there yet."""
    new = entries.select(strip(F.col("entry")).alias("entry")).where("entry <> ''").distinct()
    return vocabulary.select("entry").unionByName(new.join(vocabulary, "entry", "left_anti"))


def lookup(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Dictionary lookup; the default, or the key itself, where absent."""
    if not mapping:
        return c if default is None else default
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(table, c), c if default is None else default)


def route_classes(items: DataFrame, key: str, cell: str, classes: DataFrame, blank: str = "misc", fallback: str = "MISC") -> DataFrame:
    """(key, raw, primary, extras): the first valid part of a class cell, then the other valid ones.

    ``classes`` has ``class``. ``blank`` is skip or misc (Q7). Names must match
    exactly (Q19). Extras keep their order and repeats. Cells repeat much, so
    distinct cells are taken apart and joined with the classes, and what they
    give is joined back.
    """
    if blank not in ("skip", "misc"):
        raise ValueError("blank is skip or misc")
    rows = items.select(F.col(key), F.coalesce(strip(F.col(cell)), F.lit("")).alias("raw"))
    if blank == "skip":
        rows = rows.where("raw <> ''")
    parts = rows.select("raw").distinct().select("raw", F.posexplode(split_cell(F.col("raw"))).alias("_pos", "class"))
    valid = (
        parts.join(classes.select("class").distinct(), "class")
        .groupBy("raw")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("_pos", "class"))), lambda x: x["class"]).alias("_valid"))
    )
    rows = rows.join(valid, "raw", "left").withColumn("_valid", F.coalesce("_valid", F.array().cast("array<string>")))
    return rows.select(
        key,
        "raw",
        F.coalesce(F.get("_valid", F.lit(0)), F.lit(fallback)).alias("primary"),
        F.slice("_valid", 2, F.greatest(F.size("_valid"), F.lit(1))).alias("extras"),
        (F.size("_valid") == 0).alias("unmapped"),
    )


def manifest(routed: DataFrame, classes: DataFrame) -> DataFrame:
    """One row per class in class order: rows and file name."""
    counts = routed.groupBy(F.col("primary").alias("class")).agg(F.count("*").alias("rows"))
    return counts.join(classes, "class", "left").withColumn("file", F.concat(slug(F.col("class")), F.lit(".csv"))).orderBy("class")


def composite_extras(routed: DataFrame, key: str) -> DataFrame:
    """K4: one row per further class of an item."""
    return routed.select(key, F.col("primary").alias("primary_class"), F.explode("extras").alias("extra_class"))


def unmapped(routed: DataFrame, key: str) -> DataFrame:
    """K4: items without any valid class."""
    return routed.where("unmapped").select(key, F.col("raw").alias("raw_item_class"))


def ensure(existing: DataFrame, wanted: DataFrame, on: str = "label") -> DataFrame:
    """Entries of ``wanted`` that ``existing`` lacks, each once: applying twice adds nothing."""
    return wanted.dropDuplicates([on]).join(existing.select(on), on, "left_anti")


def template_properties(terms: DataFrame, required: list[str]) -> DataFrame:
    """The property rows of a template; ``required`` names the ones that must be filled."""
    return terms.withColumn("is_required", F.col("term").isin(*required) if required else F.lit(False))
