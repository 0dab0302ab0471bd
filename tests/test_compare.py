"""Items against the description they come from (U8), also against a plain loop."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from catalith.operators import compare


def plain(descriptions, items, gram=3, percent=50):
    """The rows of ``differences`` by loops: {(collection, side, words): (pos, times, n_words, covered, status)}."""
    form = lambda s: " ".join(re.findall(r"[^\W_]+", (s or "").lower()))
    d, i = {}, {}
    for c, text in descriptions:
        parts = [p.strip() for p in re.split(r"(?<=[.;])\s+|\n+", text or "")]
        for pos, p in enumerate(p for p in parts if p):
            if form(p):
                d.setdefault(c, []).append((pos, form(p)))
    for c, pos, text in items:
        if form(text):
            i.setdefault(c, []).append((pos, form(text)))
    out = {}
    for c in {*d, *i}:
        nd, ni = Counter(f for _, f in d.get(c, [])), Counter(f for _, f in i.get(c, []))
        runs = lambda w: [(at, tuple(w[at : at + gram])) for at in range(max(len(w) - gram, 0) + 1)]
        alone = [{r for f in a if not b[f] for _, r in runs(f.split())} for a, b in ((nd, ni), (ni, nd))]
        for a, b, side, rows, other, gone, more in ((nd, ni, "description", d, alone[1], "lost", "fewer"), (ni, nd, "items", i, alone[0], "invented", "repeated")):
            for f in a:
                if a[f] <= b[f]:
                    continue
                w = f.split()
                seen = set() if b[f] else {at + o for at, r in runs(w) if r in other for o in range(len(r))}
                status = more if b[f] else "altered" if 100 * len(seen) >= percent * len(w) else gone
                out[c, side, f] = (min(p for p, g in rows[c] if g == f), a[f] - b[f], len(w), len(seen), status)
    return out


def found(spark, descriptions, items):
    told = spark.createDataFrame(descriptions, "c string, text string")
    have = spark.createDataFrame(items, "c string, item_pos int, item_description string")
    rows = compare.differences(told, have, "c", "text").collect()
    out = {(r.collection, r.side, r.words): (r.pos, r.times, r.n_words, r.covered, r.status) for r in rows}
    assert len(out) == len(rows)
    return out


def test_each_status(spark):
    text = "A letter from Haifa. Two photographs of the old house; A ship ticket. A ship ticket.\nThe diary"
    items = [("k", 0, "a LETTER from Haifa"), ("k", 1, "Two photographs of the old villa"), ("k", 2, "A ship ticket"), ("k", 3, "A map of Mars"), ("k", 4, "A letter, from Haifa.")]
    got = found(spark, [("k", text)], items)
    assert {(side, words): v[-1] for (_, side, words), v in got.items()} == {
        ("items", "a letter from haifa"): "repeated",
        ("description", "two photographs of the old house"): "altered",
        ("items", "two photographs of the old villa"): "altered",
        ("description", "a ship ticket"): "fewer",
        ("description", "the diary"): "lost",
        ("items", "a map of mars"): "invented",
    }
    assert got["k", "description", "two photographs of the old house"] == (1, 1, 6, 5, "altered")


def test_edges(spark):
    told = [("none", None), ("blank", " \n"), ("marks", "... ; --"), (None, "No collection."), ("only", "One two three four.")]
    items = [("new", 0, "Out of nowhere"), ("none", 0, None), (None, 5, "no collection"), ("marks", 0, "?")]
    got = found(spark, told, items)
    assert got == {("only", "description", "one two three four"): (0, 1, 4, 0, "lost"), ("new", "items", "out of nowhere"): (0, 1, 3, 0, "invented")}
    assert found(spark, [], []) == {}


def test_names_that_clash(spark):
    told = spark.createDataFrame([("k", "A b c. D e f.", 1, 2)], "words string, text string, unit int, pos int")
    have = spark.createDataFrame([("k", 0, "a b c", "x")], "words string, item_pos int, item_description string, collection string")
    assert [(r.collection, r.words) for r in compare.differences(told, have, "words", "text").collect()] == [("k", "d e f")]
    row = compare.coverage(told, have, "words", "text").first()
    assert (row.n_passages, row.n_items, row.n_kept, row.n_lost, row.n_words, row.n_covered, row.share) == (2, 1, 1, 1, 6, 3, 0.5)


@pytest.mark.parametrize("seed", range(3))
def test_like_a_plain_loop(spark, seed):
    r = random.Random(seed)
    words = ["a", "b", "na", "haus", "בית", "x1"]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 9)))
    told, items = [], []
    for c in range(40):
        parts = [sentence() for _ in range(r.randint(0, 12))]
        told.append((str(c), ". ".join(parts)))
        kept = [p if r.random() < 0.6 else p.replace("a", "b", 1) + r.choice(["", " b x1"]) for p in parts if r.random() < 0.9]
        items += [(str(c), k, p) for k, p in enumerate(kept + [sentence() for _ in range(r.randint(0, 3))])]
    told.append(("long", "na " * 5000 + ". a b na"))
    items += [("long", 0, "na " * 4000), ("long", 1, "na na x1")]
    assert found(spark, told, items) == plain(told, items)
