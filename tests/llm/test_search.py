import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from catalith.llm import search as module
from catalith.llm.search import Best, norms, op13_search, radix_order, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, top=10):
    held = [(LAST if i is None else i, split(t)) for i, t in docs]
    held = [d for d in held if d[1]]
    n, total = len(held), sum(len(w) for _, w in held)
    df = {}
    for _, words in held:
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    terms = {}
    for i, t in items:
        terms.setdefault(i, set()).update(split(t))
    out = []
    for item, wanted in terms.items():
        scores = []
        for i, words in held:
            m = 10 + 90 * len(words) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * words.count(w) // (1000 * words.count(w) + 8 * m)) for w in wanted if w in words)
            if score > 0:
                scores.append((-score, i))
        out += [(item, k + 1, None if i == LAST else i, -score) for k, (score, i) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force(spark, monkeypatch):
    random.seed(2)
    vocabulary = [f"w{k}" for k in range(40)] + ["The", "the", "THE", "Été", "x9", "9"]
    text = lambda most: random.choice([" ", ", ", "\n"]).join(random.choices(vocabulary, k=random.randint(0, most)))
    docs = [(k, text(60)) for k in range(200)] + [(None, "w1 w2 the"), (3, "w1 w2"), (3, "w1 w2"), (900, None), (901, ""), (902, "w5 " * 3000)]
    items = [(k, text(12)) for k in range(30)] + [(None, "w1 w7"), (5, "w3 w4"), (6, None), (77, "-"), (78, "nowhere")]
    want = brute(docs, items)
    assert got(search(*tables(spark, docs, items))) == want
    monkeypatch.setattr(module, "RANGE", 300)
    monkeypatch.setattr(module, "TOGETHER", 50)
    assert got(search(*tables(spark, docs, items))) == want
    # queries in blocks, each with its own pass
    assert got(search(*tables(spark, docs, items), most_terms=40, most_items=4)) == want


def test_ties_go_by_doc_id_and_copies_of_a_third(spark):
    docs = [(k, "same words here") for k in range(300)] + [(k, f"other {k} text") for k in range(300, 900)]
    items = [(1, "same"), (2, "other text"), (3, "text text text")]
    assert got(op13_search(*tables(spark, docs, items))) == brute(docs, items)


def test_odd_rows_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "word a b"), (None, "café"), (2, None)], "item_id long, text string").withColumn("score", F.lit("x"))
    want = brute([(r["doc_id"], r["text"]) for r in odd.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert got(op13_search(odd, items)) == want and want
    assert op13_search(none, items).count() == 0 and op13_search(odd, items.limit(0)).count() == 0


def test_radix_order_and_heaps():
    rng = np.random.default_rng(1)
    for most in (1, 60_000, 70_000, 2**33, 2**50):
        key = rng.integers(0, most, 5000)
        assert (radix_order(key, most) == np.argsort(key, kind="stable")).all()
    best = Best(3, 4)
    item, score, doc = np.sort(rng.integers(0, 3, 4000)), rng.integers(-5, 60, 4000), rng.integers(0, 10**6, 4000)
    for part in np.array_split(np.arange(4000), 7):
        best.add(item[part], score[part], doc[part])
    want = sorted(r for k in range(3) for r in sorted(((k, d, s) for i, s, d in zip(item, score, doc, strict=True) if i == k and s > 0), key=lambda r: (-r[2], r[1]))[:4])
    assert sorted(zip(*(x.tolist() for x in best.rows()), strict=True)) == want


def test_norms_beyond_64_bits():
    length = np.array([1, 7, 10**7], np.int64)
    assert norms(length, 10**12, 10**15).tolist() == [10 + 90 * n * 10**12 // 10**15 for n in length.tolist()]
    assert norms(length, 10, 100).tolist() == [10 + 90 * n * 10 // 100 for n in length.tolist()]
