import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import divergence
from catalith.llm.divergence import Audit, op12_divergence, share

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, listed=50):
    """Pairs and terms of (lang, source, text) rows, by whole numbers of any size."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for a, b, t in docs]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = {}
        for _, _, words in own:
            for w in set(words):
                held[w] = held.get(w, 0) + 1
        kept = sorted(w for w, n in held.items() if n >= least)
        count = lambda rows: {w: sum(words.count(w) for _, _, words in rows) for w in kept}
        shares = lambda c: {w: 1 + 10**9 * (c[w] + 5) // (sum(c.values()) + 5 * len(kept)) for w in kept}
        whole, sources = shares(count(own)), sorted({d[1] for d in own})
        counts = {s: count([d for d in own if d[1] == s]) for s in sources}
        p = {s: shares(counts[s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - whole[w], w) for w in kept if counts[s][w] and p[s][w] > whole[w]]
            for part, rows in (("pair", pairs), ("term", terms)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(rows) if part == "pair" or k < listed]
    return sorted(out)


def rows(audit, listed=50):
    pick = ["lang", "source", "part", "item", "value", "rank"]
    parts = audit.pairs().withColumn("part", F.lit("pair")), audit.listed_terms(listed).withColumn("part", F.lit("term"))
    return sorted(tuple(r) for part in parts for r in part.select(*pick).collect())


@pytest.mark.parametrize("block, chunk", [(16, 4096), (2, 3), (1, 1)])
def test_tiles_against_brute_force(spark, block, chunk):
    random.seed(block)
    vocabulary = [*"abcdefghij", "Été", "été", "ÉTÉ", "ß", "Z9z", "x-y", "日本"]
    docs = [(random.choice(["en", "de", None]), random.choice(["s1", "s2", "S3", "é", "", None, "s4"]), " ".join(random.choices(vocabulary, k=random.randint(0, 9)))) for _ in range(150)]
    docs += [("only", "one", "a b c"), ("few", "s1", "rare"), ("few", "s2", None), ("en", "blank", "12 - 34")] + [("hot", "s1", "a a a b")] * 60 + [("hot", "s2", "b c c")] * 5
    df = spark.createDataFrame(docs, "lang string, source string, text string").repartition(3)
    assert rows(Audit(df, 4, block=block, chunk=chunk), 3) == brute(docs, 4, 3)


def test_query_takes_terms_of_thirty_documents(spark):
    docs = [("en", f"s{k % 3}", "often " * (k % 3) + "always " + ("seldom" if k < 29 else "")) for k in range(60)]
    got = sorted(tuple(r) for r in op12_divergence(spark.createDataFrame(docs, "lang string, source string, text string")).collect())
    assert got == brute(docs, 30) and {r[3] for r in got if r[2] == "term"} == {"often", "always"}


def test_odd_rows_and_empty_table(odd, none):
    assert rows(Audit(odd, 1)) == brute([(r["lang"], r["source"], r["text"]) for r in odd.collect()], 1)
    assert op12_divergence(none).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    pairs = [(0, 5), (5, 5), (1, 3), (10**12 + 7, 9 * 10**12), (8 * 10**15, 8 * 10**15 + 1), (123_456_789_012, 10**15)]
    want = [1 + 10**9 * n // d for n, d in pairs]
    got = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, n long, d long").orderBy("k").select(share(F.col("n"), F.col("d")).alias("p")).collect()
    assert [r["p"] for r in got] == want
    assert divergence._shares(*(np.array(x, np.int64) for x in zip(*pairs, strict=True))).tolist() == want
