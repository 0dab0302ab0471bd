import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from catalith.llm.registry import oracle_sql, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages_keep_the_columns(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, "no such passage")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for name, stage in pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()
        assert pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == docs.count()


def test_one_of_each_group_stays(spark, corpus, rows):
    text = " ".join(f"w{i}" for i in range(60))
    docs = corpus(spark, [text, text + " x", "other words that are few", text.upper(), "other words that are few"])
    kept = pipeline.near_dedup(spark, docs.unionByName(docs.where("doc_id = 2")), FOLDER)
    assert rows(kept, "doc_id") == [(0,), (2,)]


def test_masking_counts_anew(spark, corpus):
    r = pipeline.personal_data(spark, corpus(spark, ["call +1 (212) 555-0100 or a@b.org"]), FOLDER).first()
    assert r["text"] == "call [phone] or [email]" and r["n_chars"] == len(r["text"])


def test_run(spark):
    out = pipeline.run(spark, FOLDER)
    assert 0 < out.count() < spark.read.parquet(f"{FOLDER}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, name):
    import os

    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    df = queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    result = con.execute(oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)


def test_near_dedup_keeps_unrelated_texts_of_one_id(spark):
    import random

    random.seed(3)
    a, b = (" ".join(random.choices([f"q{i}" for i in range(900)], k=100)) for _ in range(2))
    rows = [(5, a), (5, b), (8, b), (8, a + " more"), (9, None), (9, ""), (None, a), (5, a)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, _id int, _hash string")
    got = pipeline.near_dedup(spark, df, "")
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(5, a), (5, b), (9, None), (9, ""), (None, a)], key=repr)
