import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalith.llm import classifier
from catalith.llm.classifier import NAMES, RuleEnsemble, extract_rules, fit, lasso, measure, op11_quality, statistics, train

FOLDER = "/root/testdata/sf0.01"


def plain(text):
    """Some of the statistics, word by word."""
    words, size = (text or "").encode().split(), len((text or "").encode())
    lines = [x for x in (text or "").encode().split(b"\n") if x]
    fives = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n, letters = max(1, len(words)), [c for c in text or "" if c.isalpha()]
    return {
        "words": len(words), "word_bytes": sum(map(len, words)) / n, "same_as_before": sum(a == b for a, b in zip(words, words[1:])) / n,  # noqa: B905, RUF007
        "different_words": len(set(words)) / n, "top_word": max((words.count(w) for w in set(words)), default=0) / n, "repeated_fives": (len(fives) - len(set(fives))) / max(1, len(fives)),
        "lines": len(lines), "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "symbols": sum(c in "#*$%&|<>@^~=+_{}[]\\/" for c in text or "") / max(1, size),
        "upper": sum("A" <= c <= "Z" or "À" <= c <= "Þ" for c in letters) / max(1, len("".join(letters).encode())), "capitals": sum(65 <= w[0] <= 90 for w in words) / n,
        "bare_words": sum(not any(b >= 128 or chr(b).isalnum() for b in w) for w in words) / n, "ends": sum(w[-1:] in (b".", b"!", b"?") for w in words) / n,
    }


TEXTS = ["", None, "one", "The cat. The cat!\nA | b\n\nÀ É ça a a a", "a b c d e a b c d e x", "#### $$ 12 %", " \n\t ", "word " * 50, "naïve — 日本 \U0001f600", "UP DOWN\nUP DOWN\nup"]


def test_statistics_against_plain_ones(spark):
    got = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k int, text string").orderBy("k").select(statistics(F.col("text")).alias("s")).collect()
    for text, row in zip(TEXTS, got, strict=True):
        assert {k: pytest.approx(v) for k, v in plain(text).items()} == {k: row["s"][k] for k in plain(text)}, text
        assert all(math.isfinite(v) for v in row["s"])


def test_a_text_has_the_same_statistics_in_any_company():
    raw = [(t or "").encode() for t in TEXTS]
    at = np.append(0, np.cumsum([len(t) for t in raw]))
    whole = measure(np.frombuffer(b"".join(raw), np.uint8), at)
    for k, t in enumerate(raw):
        assert measure(np.frombuffer(t, np.uint8), np.array([0, len(t)])).tolist() == whole[k : k + 1].tolist()


def test_rules_are_tree_paths_and_lasso_is_sparse():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.7) & (x[:, 3] <= 0.4)).astype(float)
    names = list("abcde")
    rules = extract_rules(x, y, names)
    assert len({r.holds(x, names).tobytes() for r in rules}) == len(rules) and max(len(r.conditions) for r in rules) <= classifier.DEPTH
    model = fit(x, y, names)
    assert 0 < len(model.rules) < len(rules)
    other = rng.random((2000, 5))
    assert ((model.predict(other, names) > 0.5) == ((other[:, 0] > 0.7) & (other[:, 3] <= 0.4))).mean() > 0.97
    held = np.stack([r.holds(x, names) for r in rules], axis=1).astype(float)
    w = lasso(held, y, 1.0)
    assert not w[1:].any() and abs(1 / (1 + np.exp(-w[0])) - y.mean()) < 1e-3


def test_column_equals_prediction(spark):
    random.seed(1)
    rng = np.random.default_rng(1)
    texts = [" ".join(random.choices(["a", "The", "###", "word.", "LOUD"], k=random.randint(0, 40))) for _ in range(300)]
    raw = [t.encode() for t in texts]
    x = measure(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])))
    model = fit(x, (x[:, NAMES.index("symbols")] < 0.2).astype(float) * (rng.random(300) < 0.9))
    rows = model.score(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")).orderBy("k").collect()
    assert model.rules and np.allclose([r["score"] for r in rows], model.predict(x))


def test_labels_learned_from(spark, odd, none):
    text = lambda k: "good words in a row. " * 3 if k % 2 else "### $$$ ### " * 5
    docs = spark.createDataFrame([(k, text(k)) for k in range(400)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(400)]
    want = op11_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) == (r["doc_id"] % 2 == 1) for r in want)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in want)
    # labels of held-out rows, nulls and other columns change nothing
    wrong = [(k, 1 - v) if zlib.crc32(str(k).encode()) % 5 == 0 else (k, v) for k, v in labels] + [(None, 0), (3, None)]
    again = op11_quality(docs.withColumn("_stats", F.lit(1)), spark.createDataFrame(wrong, "doc_id long, quality int").withColumn("text", F.lit("x")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, want))
    got = op11_quality(odd, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op11_quality(odd, nothing).collect()} == {0.5} and op11_quality(none, nothing).count() == 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k % 50, "a b c " * (k % 7)) for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    assert isinstance(train(docs, labels, most=30), RuleEnsemble)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the synthetic tables")
def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    rows = op11_quality(docs, labels).join(labels, "doc_id").where("held_out").select("quality", "score", "predicted").collect()
    good, bad = ([r for r in rows if r["quality"] == k] for k in (1, 0))
    auc = sum((a["score"] > b["score"]) + (a["score"] == b["score"]) / 2 for a in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.97 and sum(r["predicted"] == r["quality"] for r in rows) > 0.95 * len(rows)
