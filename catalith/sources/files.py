"""File sources (S1-S7, S14, S15) and sinks.

Spark has no row order, so readers that need one attach ``pos``: it grows with
the place in a file and, over files, with their order in the scan.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalith.functions.text import slug
from catalith.operators.reconcile import still_missing

POS = "pos"
_BOM = "﻿"


def _with_pos(df: DataFrame) -> DataFrame:
    return df.withColumn(POS, F.monotonically_increasing_id())


def strip_headers(df: DataFrame) -> DataFrame:
    """Column names without white space, or a byte order mark, around them."""
    return df.toDF(*[c.lstrip(_BOM).strip() for c in df.columns])


def read_excel(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The first sheet; an absent file gives an empty table.

    Needs the optional package openpyxl; the sheet is read by the driver, as a
    workbook cannot be split. Prefer delimited or Parquet files.
    """
    if not os.path.exists(path):
        return spark.createDataFrame([], schema)
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise NotImplementedError("reading xlsx needs openpyxl; use a delimited or Parquet file") from e
    import pandas as pd

    return strip_headers(spark.createDataFrame(pd.read_excel(path), schema))


def read_table(spark: SparkSession, path: str, sep: str = "\t", schema: str | None = None) -> DataFrame:
    """S3: delimited text with a header, doubled quotes; a bare carriage return stays inside its cell."""
    reader = spark.read.options(sep=sep, header=True, lineSep="\n", escape='"', quote='"', multiLine=False)
    df = strip_headers((reader.schema(schema) if schema else reader).csv(path))
    last = df.columns[-1]
    return _with_pos(df.withColumn(last, F.regexp_replace(last, "\r$", ""))) if dict(df.dtypes)[last] == "string" else _with_pos(df)


def read_positional(spark: SparkSession, path: str, names: dict[int, str], least: int, skip: int = 1, sep: str = "\t") -> DataFrame:
    """Unquoted lines by position; lines with fewer than ``least`` cells go, and so do the first ``skip`` lines.

    Lines are counted within each file. Only a file's first block is numbered, so
    a large file is not gathered into one task.
    """
    from pyspark.sql import Window

    block, file = F.col("_metadata.file_block_start"), F.col("_metadata.file_path")
    lines = _with_pos(spark.read.text(path).select("value", file.alias("_file"), block.alias("_block")))
    place = F.row_number().over(Window.partitionBy("_file").orderBy(POS))
    first = lines.where("_block = 0").withColumn("_n", place).where(F.col("_n") > skip).drop("_n")
    cells = first.unionByName(lines.where("_block > 0")).withColumn("_c", F.split("value", sep)).where(F.size("_c") >= least)
    return cells.select(POS, *[F.get("_c", F.lit(i)).alias(n) for i, n in names.items()])


def read_lines(spark: SparkSession, path: str, names: list[str], sep: str = "\t") -> DataFrame:
    """Lines without a header, cut into at most as many parts as names; others are left out."""
    cells = _with_pos(spark.read.text(path)).withColumn("_c", F.split("value", sep, len(names))).where(F.size("_c") == len(names))
    return cells.select(POS, *[F.get("_c", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """Distinct non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as rows (key, value) of an object or (pos, value) of an array; ``schema`` starts with map or array."""
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("_j"))
    if schema.lstrip().lower().startswith("map"):
        return parsed.select(F.explode("_j").alias("key", "value"))
    return parsed.select(F.posexplode("_j").alias(POS, "value"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, label, content) of images below a folder; suffixes are case-sensitive, the label is the folder's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,JPG,jpeg}").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -2).alias("label"), "content")


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What earlier runs wrote, or an empty table."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


# --- sinks -------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, bom: bool = True, single: bool = False) -> None:
    """K1, K5: CSV with doubled quotes; the first header starts with a byte order mark. ``single`` is for small tables."""
    named = df.withColumnRenamed(df.columns[0], _BOM + df.columns[0]) if bom else df
    (named.coalesce(1) if single else named).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_by_class(df: DataFrame, path: str, class_column: str) -> None:
    """K2: one folder per class, named by its slug."""
    df.withColumn("slug", slug(F.col(class_column))).write.mode("overwrite").partitionBy("slug").options(header=True, escape='"').csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """K3: one JSON record per class."""
    manifest.coalesce(1).write.mode("overwrite").json(path)


def as_sorted_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """K6: the table as one JSON object with sorted keys: a vocabulary-sized result."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key), F.col(value))))
    return df.agg(F.to_json(F.map_from_entries(entries), {"pretty": "true"}).alias("json"))


def append_log(df: DataFrame, path: str) -> None:
    """K9: append rows to a log table."""
    df.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """A new version beside the old ones, which serve as backups; the path written."""
    out = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(out)
    return out


def write_ids(df: DataFrame, column: str, path: str) -> None:
    """Sorted ids as lines."""
    df.select(F.col(column).cast("string")).orderBy(column).write.mode("overwrite").text(path)


def write_missing(wanted: DataFrame, have: DataFrame, on: str, path: str) -> None:
    """Sorted ids that are still missing."""
    write_ids(still_missing(wanted, have, on), on, path)


def file_name(class_name: Column) -> Column:
    """K2: the file name of a class."""
    return F.concat(slug(class_name), F.lit(".csv"))
