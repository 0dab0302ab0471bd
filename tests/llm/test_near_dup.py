import random

import numpy as np
import pytest

from catalith.llm import near_dup
from catalith.llm.graph import components
from catalith.llm.near_dup import BANDS, ROWS, link, near_duplicates, op1_minhash


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    return out


def brute(texts, percent):
    sets = sets_of(texts)
    root = list(range(len(texts)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), top(i), top(i) == i) for i, s in enumerate(sets)]


def near_copies(n):
    random.seed(9)
    out = []
    for _ in range(12):
        base = random.choices([f"v{i}" for i in range(500)], k=random.choice([3, 8, 60, 200]))
        for _ in range(n):
            w = list(base)
            for _ in range(random.choice([0, 0, 1, 1, 2, 4])):
                w[random.randrange(len(w))] = f"x{random.random()}"
            out.append(" ".join(w).upper() if random.random() < 0.2 else " ".join(w))
    random.shuffle(out)
    return out


@pytest.mark.parametrize("percent", [80, 85])
def test_against_brute_force(spark, corpus, rows, percent):
    texts = near_copies(12)
    got = rows(near_duplicates(corpus(spark, texts), percent), "doc_id", "n_shingles", "component_id", "kept")
    assert got == sorted(brute(texts, percent), key=repr)


def test_large_clusters_go_in_tiles(spark, corpus, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 700)
    texts = near_copies(10)
    assert rows(op1_minhash(corpus(spark, texts)), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(texts, 85), key=repr)


def test_link_connects_what_all_pairs_connect():
    random.seed(2)
    for _ in range(40):
        base = np.arange(100, dtype=np.uint64)
        sets = [np.unique(np.array(random.sample(list(base), random.randint(80, 100)) + [random.randrange(1000, 9000) for _ in range(random.randint(0, 8))], np.uint64)) for _ in range(25)]
        root = list(range(25))

        def top(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(25):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    root[max(top(i), top(j))] = min(top(i), top(j))
        mine = list(range(25))

        def up(x, mine=mine):
            while mine[x] != x:
                x = mine[x]
            return x

        for u, v in link(list(range(25)), sets, 85):
            mine[max(up(u), up(v))] = min(up(u), up(v))
        assert [top(x) for x in range(25)] == [up(x) for x in range(25)]


def test_bands_miss_little():
    assert (1 - 0.85**ROWS) ** BANDS < 1e-6 and (1 - 0.8**ROWS) ** BANDS < 1e-4


def test_odd_rows(odd, none):
    got = {}
    for r in op1_minhash(odd).collect():
        got.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"], r["kept"]))
    assert (got[1], got[2], got[3]) == ([(0, 1, True)], [(0, 2, True)], [(0, 3, True)])
    assert got[4] == [(1, 4, True)] and got[5] == [(1, 4, False)] * 2
    assert got[7][0][1:] == (7, True) and got[8][0][1:] == (7, False) and got[11][0][1:] == (10, False)
    assert all(c is None and kept for _, c, kept in got[None]) and len(got[None]) == 2
    assert op1_minhash(none).count() == 0


def test_components(spark, rows):
    edges = [(i + 1, i) for i in range(40)] + [(101, 100), (105, 101), (205, 200), (206, 205), (206, 200)]
    got = dict(rows(components(spark.createDataFrame(edges, "u long, v long"))))
    assert all(got[i] == 0 for i in range(41)) and got[105] == 100 and got[206] == got[205] == 200
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = [(i, 0) for i in range(1, 400)] + [(i, 5000) for i in range(5001, 5300)] + [(5299, 399)]
    got = dict(rows(components(spark.createDataFrame([(max(e), min(e)) for e in star], "u long, v long"))))
    assert set(got.values()) == {0} and len(got) == 700


def test_one_id_with_two_texts(spark, rows):
    random.seed(1)
    a, b = (" ".join(random.choices([f"q{i}" for i in range(900)], k=100)) for _ in range(2))
    more = b + " more"
    for other, texts in ((b, [(5, a), (5, b), (8, b), (9, more)]), (a, [(5, b), (5, a), (8, a), (9, a + " more")])):
        for order in (texts, texts[::-1], texts[1:] + texts[:1]):
            df = spark.createDataFrame([(i, t, t[:9]) for i, t in order], "doc_id long, text string, more string")
            got = rows(op1_minhash(df), "doc_id", "component_id", "kept")
            assert got == [(5, 5, True), (5, 5, True), (8, 5, False), (9, 5, False)], other


def test_chained_clusters_cost_their_buckets(spark, corpus, rows, monkeypatch):
    """A cluster of ten tiles, of which neighbours tie: sets are sent a bounded number of times, not once a tile."""
    random.seed(8)
    words = [f"c{i}" for i in range(5000)]
    texts = [" ".join(words[6 * i : 6 * i + 60]) for i in range(200)]
    monkeypatch.setattr(near_dup, "TILE", sum(len(s) for s in sets_of(texts)) // 10)
    sent = []
    plain = near_dup._links
    monkeypatch.setattr(near_dup, "_links", lambda tiles, *a: sent.append(tiles.distinct().count()) or plain(tiles, *a))
    assert rows(op1_minhash(corpus(spark, texts)), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(texts, 85), key=repr)
    assert sent and sum(sent) < 8 * len(texts), sent


def test_large_group_of_near_copies(spark, corpus, rows, monkeypatch):
    random.seed(12)
    base = random.choices([f"v{i}" for i in range(5000)], k=120)
    texts = []
    for _ in range(80):
        w = list(base)
        for _ in range(random.choice([1, 1, 2, 3, 5])):
            w[random.randrange(len(w))] = f"x{random.random()}"
        texts.append(" ".join(w))
    monkeypatch.setattr(near_dup, "TILE", 1000)
    assert rows(op1_minhash(corpus(spark, texts)), "doc_id", "n_shingles", "component_id", "kept") == sorted(brute(texts, 85), key=repr)
