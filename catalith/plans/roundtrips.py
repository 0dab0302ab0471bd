"""Queries that write a table in a format and read it back, with SQL over the table itself.

Each run writes to a folder of its own under the session's scratch folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.plans.queries import Tables, query
from catalith.session import scratch
from catalith.sources import files


def _folder(t: Tables) -> str:
    return f"{scratch(t.spark)}/roundtrip-{uuid.uuid4().hex}"


def _text(rows: DataFrame, path: str) -> str:
    rows.write.text(path)
    return path


@query("csv_back", """SELECT doc_id, '"' || source || '", ' || lang AS v FROM documents""")
def csv_back(t):
    """Comma-separated cells with quotes and commas; the mark before the first header goes."""
    path = _folder(t)
    files.write_csv(t.documents.select("doc_id", F.concat(F.lit('"'), "source", F.lit('", '), "lang").alias("v")), path)
    return files.read_table(t.spark, path, ",").select(F.col("doc_id").cast("bigint"), "v")


@query("class_files_back", r"""SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def class_files_back(t):
    """K2: a folder for each class."""
    path = _folder(t)
    files.write_by_class(t.part.select("p_partkey", "p_type"), path, "p_type")
    rows = t.spark.read.options(header=True, escape='"').csv(path)
    return rows.select(F.col("p_partkey").cast("bigint"), "slug")


_CELLS = r"""SELECT o_orderkey::VARCHAR AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS b, o_custkey::VARCHAR || '"' AS c FROM orders"""


def _cells(t: Tables):
    """Lines of three cells, every fifth of two."""
    return t.orders.select(F.concat_ws("\t", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")), F.concat(F.col("o_custkey").cast("string"), F.lit('"'))))


@query("positional_back", f"WITH c AS ({_CELLS}) SELECT a, c FROM c WHERE b IS NOT NULL")
def positional_back(t):
    """Cells by position from lines with enough of them."""
    return files.read_positional(t.spark, _text(_cells(t), _folder(t)), {0: "a", 2: "c"}, 3, skip=0).select("a", "c")


@query("lines_back", f"WITH c AS ({_CELLS}) SELECT a, CASE WHEN b IS NULL THEN c ELSE b || chr(9) || c END AS rest FROM c")
def lines_back(t):
    """Lines cut into at most two parts."""
    return files.read_lines(t.spark, _text(_cells(t), _folder(t)), ["a", "rest"]).select("a", "rest")


@query("list_back", """SELECT DISTINCT o_custkey::VARCHAR AS id FROM orders WHERE o_custkey % 3 > 0""")
def list_back(t):
    """Different lines that aren't blank."""
    line = F.when(F.col("o_custkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), F.col("o_custkey").cast("string")))
    return files.read_list(t.spark, _text(t.orders.select(line), _folder(t)))


@query("json_back", """SELECT p_brand AS key, count(*) AS value FROM part GROUP BY p_brand""")
def json_back(t):
    """One object of a vocabulary."""
    counts = t.part.groupBy("p_brand").agg(F.count("*").alias("n"))
    path = _text(files.as_sorted_json(counts, "p_brand", "n"), _folder(t))
    return files.read_json(t.spark, path, "map<string,bigint>")


@query("manifest_back", """SELECT p_type AS class, count(*) AS n FROM part GROUP BY p_type""")
def manifest_back(t):
    """K3: a record for each class."""
    path = _folder(t)
    files.write_manifest(t.part.groupBy(F.col("p_type").alias("class")).agg(F.count("*").alias("n")), path)
    return t.spark.read.schema("class string, n bigint").json(path)


@query("checkpoint_back", """SELECT o_orderkey, o_orderkey % 2 = 0 AS done FROM orders""")
def checkpoint_back(t):
    """What an earlier run wrote, and nothing where there was none."""
    path, schema = _folder(t), "o_orderkey bigint"
    orders = t.orders.select(F.col("o_orderkey").cast("bigint"))
    orders.where("o_orderkey % 2 = 0").write.parquet(f"{path}/first")
    done = files.read_checkpoint(t.spark, f"{path}/first", schema).unionByName(files.read_checkpoint(t.spark, f"{path}/none", schema))
    return orders.join(done.withColumn("done", F.lit(True)), "o_orderkey", "left").select("o_orderkey", F.coalesce("done", F.lit(False)).alias("done"))


@query("log_back", """SELECT event_id, 1 AS run FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 2 FROM events""")
def log_back(t):
    """K9: two runs that append to one log."""
    path = _folder(t)
    files.append_log(t.events.where("event_id % 2 = 0").select("event_id", F.lit(1).alias("run")), path)
    files.append_log(t.events.select("event_id", F.lit(2).alias("run")), path)
    return t.spark.read.parquet(path)


@query("snapshots_back", """SELECT p_partkey, p_brand, 1 AS version FROM part UNION ALL SELECT p_partkey, p_brand || '!', 2 FROM part""")
def snapshots_back(t):
    """Two versions beside each other."""
    path, rows = _folder(t), t.part.select("p_partkey", "p_brand")
    files.write_snapshot(rows, path, 1)
    files.write_snapshot(rows.withColumn("p_brand", F.concat("p_brand", F.lit("!"))), path, 2)
    return t.spark.read.parquet(path).withColumn("version", F.col("version").cast("int"))


@query("missing_back", """SELECT DISTINCT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 8 = 1)""")
def missing_back(t):
    """Ids that are still missing, as lines."""
    path = _folder(t)
    files.write_missing(t.customer.select(F.col("c_custkey").alias("k")), t.orders.where("o_orderkey % 8 = 1").select(F.col("o_custkey").alias("k")), "k", path)
    return files.read_list(t.spark, path)
