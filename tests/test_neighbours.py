import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalith.operators import features, neighbours
from catalith.operators.neighbours import Tree, bandwidths, embed, layout, nearest, settle, squares


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 16)) * 4
    return (middles[rng.integers(0, 12, 700)] + rng.normal(size=(700, 16))).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, vectors):
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    rows += [(1000 + k, vectors[3].tolist()) for k in range(50)] + [(2000, None), (2001, []), (2002, [1.0, 2.0]), (2003, [float("nan")] * 16)]
    return spark.createDataFrame(rows, "id long, features array<float>").withColumns({"x": F.lit("kept?"), "point": F.lit(1)}).repartition(3)


def truth(x, k):
    d = squares(x.astype(float), x.astype(float))
    np.fill_diagonal(d, np.inf)
    return d, np.argsort(d, axis=1)[:, :k]


def trust(x, y, k=10):
    d, _ = truth(x, k)
    _, near = truth(y, k)
    rank, n = d.argsort(1).argsort(1) + 1, len(x)
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


def test_recall_against_brute_force(table, vectors):
    got = {}
    for r in nearest(table, "id", 10, leaf=40, trees=6).collect():
        got.setdefault(r["id"], {})[r["neighbour"]] = r["distance"]
    d, near = truth(vectors, 10)
    recall = np.mean([len(set(got[k]) & set(near[k].tolist())) / 10 for k in range(700)])
    assert recall >= 0.9
    assert all(abs(v**2 - d[k][o]) < 1e-2 for k in range(700) for o, v in got[k].items())
    # copies: linked with the least one, and with its neighbours
    assert all(got[1000 + k].pop(3) == 0 and got[1000 + k] == got[3] for k in range(50))
    assert not {2000, 2001, 2002, 2003} & set(got)


def test_embedding_keeps_neighbours_better_than_components(table, vectors):
    rows = {r["id"]: r for r in embed(table, landmarks=200, leaf=60).collect()}
    again = {r["id"]: (r["x"], r["y"]) for r in embed(table.repartition(5), landmarks=200, leaf=60).collect()}
    assert again == {k: (r["x"], r["y"]) for k, r in rows.items()} and len(rows) == table.count()
    assert all(rows[k]["x"] is None and rows[k]["y"] is None for k in (2000, 2001, 2002, 2003))
    assert len({(rows[k]["x"], rows[k]["y"]) for k in [3, *range(1000, 1050)]}) == 1
    y = np.array([(rows[k]["x"], rows[k]["y"]) for k in range(700)])
    plain = {r["id"]: (r["x"], r["y"]) for r in features.project(table.where("id < 1000").drop("x"), "features").collect()}
    assert trust(vectors, y) > trust(vectors, np.array([plain[k] for k in range(700)]))


def test_small_tables(spark, table):
    none = table.limit(0)
    assert embed(none).count() == 0 and nearest(none, "id").count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)], "id long, features array<float>")
    assert sorted((r["id"], r["x"] is None) for r in embed(one).collect()) == [(1, False), (2, False), (3, True)]
    assert [tuple(r) for r in nearest(one, "id").collect()] == [(2, 1, 0.0)]
    three = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(3)], "id long, features array<float>")
    assert {(r["id"], r["neighbour"]) for r in nearest(three, "id", 5).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}


def test_lists_are_compared_across_batches_and_only_where_new():
    rng = np.random.default_rng(4)
    rows = [(p, 100 * p + j, rng.normal(size=3).astype(np.float32).tolist(), 4.0 + j, int((p + j) % 3 == 0)) for p, n in ((1, 4), (2, 1), (3, 7), (4, 5)) for j in range(n)]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.float64(), pa.int32()]
    names = ["point", "other", "vector", "reach", "new"]

    def batches(size):
        for i in range(0, len(rows), size):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size], strict=True), kinds, strict=True)], names)

    x = squares(*[np.array([r[2] for r in rows], float)] * 2)
    want = [(a[1], b[1], x[i, j]) for i, a in enumerate(rows) for j, b in enumerate(rows) if i != j and a[0] == b[0] and (a[4] or b[4]) and x[i, j] < a[3]]
    for size in (1, 3, 100):
        got = sorted(tuple(r.values()) for b in neighbours._among(batches(size)) for r in b.to_pylist())
        assert np.allclose(got, sorted(want)) and len(got) == len(want) > 10
    assert list(neighbours._among(iter([]))) == []


def test_bandwidths_reach_the_perplexity():
    distance = np.random.default_rng(1).random((50, 15)) * 10
    distance[0, 5:], distance[1] = np.inf, 1.0
    share = bandwidths(distance, 4.0)
    reached = np.exp(-(share * np.log(np.maximum(share, 1e-300))).sum(1))
    assert np.allclose(share.sum(1), 1) and np.allclose(reached[2:], 4, atol=1e-3) and abs(reached[0] - 4) < 1e-3 and not share[0, 5:].any()
    assert np.allclose(share[1], 1 / 15)


def test_layout_parts_groups_and_trees_are_balanced(vectors):
    two = np.concatenate([np.random.default_rng(2).normal(size=(40, 5)), np.random.default_rng(3).normal(size=(40, 5)) + 30])
    y = layout(two)
    near = truth(y, 5)[1] < 40
    assert (near[:40]).all() and not near[40:].any()
    leaves = Tree(vectors[:300].astype(float), 8, 1).leaf(vectors.astype(float))
    assert np.bincount(leaves, minlength=8).max() < 4 * 700 / 8


def test_settle_joins_a_group_not_the_middle():
    near = np.array([[[0.0, 0.0], [0.0, 1.0], [100.0, 0.0]]])
    assert abs(settle(np.array([[0.4, 0.3, 0.3]]), near)[0, 0]) < 2
    assert neighbours.LANDMARKS <= 2000
