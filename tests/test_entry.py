import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def same(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v.isoformat()[:19] if hasattr(v, "isoformat") else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the synthetic tables")
@pytest.mark.parametrize("name", sorted(n for n in entry.QUERIES if n in entry.SQL))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df = entry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = con.execute(entry.SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(same(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
    assert got == want and got


def test_rows_only_queries(spark):
    for name in sorted(set(entry.QUERIES) - set(entry.SQL)):
        assert entry.QUERIES[name](spark, FOLDER).count() > 0
    assert entry.entry(spark).count() > 0


def test_merges_take_every_order_and_pair():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("create view lineitem as select unnest([1, 2, 3, 2001, 2002]) as l_orderkey, 1 as l_partkey, 3 as l_suppkey")
    con.execute("create view orders as select 3000 as o_orderkey, 1 as o_custkey")
    ids = {n: sorted(r[0] for r in con.execute(entry.SQL[n]).fetchall()) for n in ("merge_pairs", "apply_inserts", "apply_updates")}
    assert ids == {"merge_pairs": [2, 3, 2002], "apply_inserts": [1, 2, 3, 2001, 2002, 3000], "apply_updates": [1, 2, 3, 2001, 2002]}


def test_urls_documents_and_orders_are_all_taken(spark):
    tables = {n: spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("pages", "documents")}
    assert entry.QUERIES["url_language"](spark, FOLDER).count() == tables["pages"].count()
    left = tables["documents"].select("doc_id").join(entry.QUERIES["outer_general"](spark, FOLDER), F.col("doc_id") == F.col("k"), "left_anti")
    assert left.count() == 0


def test_collections_above_9999(spark, tmp_path):
    spark.range(1).selectExpr("123456L as l_orderkey", "7L as l_suppkey", "1L as l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1).selectExpr("123456L as o_orderkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in entry.QUERIES["derived_parent"](spark, str(tmp_path)).collect()] == [("AB-001-G-F-123456-007-R0001", "AB-001-G-F-123456")]
