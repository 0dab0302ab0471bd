import hashlib
import random
import re

import numpy as np
import pytest

from catalith.llm import repeats, substrings, suffixes
from catalith.llm.repeats import remove_repeats
from catalith.llm.substrings import WORDS, op10_words
from catalith.llm.suffixes import BYTES, op9_bytes


def brute(units, length):
    """Which symbols runs starting in documents of smaller id cover."""
    first = {}
    for d, u in units:
        for i in range(len(u) - length + 1):
            k = u[i : i + length]
            first[k] = min(first.get(k, d), d)
    out = []
    for d, u in units:
        gone = bytearray(len(u))
        for i in range(len(u) - length + 1):
            if first[u[i : i + length]] < d:
                gone[i : i + length] = b"\x01" * length
        out.append(bytes(gone))
    return out


def check(df, texts):
    """Both queries against brute force, for (doc_id, text) rows; null ids are the largest."""
    order = lambda r: repr(tuple(r))
    ids = [(2**63 - 1 if i is None else i) for i, _ in texts]
    raw = [(t or "").encode() for _, t in texts]
    want = []
    for (i, _), u, gone in zip(texts, raw, brute(list(zip(ids, raw, strict=True)), 50), strict=True):
        kept = bytes(b for b, g in zip(u, gone, strict=True) if not g)
        want.append((i, len(u), sum(gone), len(re.findall(b"\x01+", gone)), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in op9_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
    split = [tuple(u.split()) for u in raw]
    want = []
    for (i, _), u, gone in zip(texts, split, brute(list(zip(ids, split, strict=True)), 13), strict=True):
        kept = b" ".join(w for w, g in zip(u, gone, strict=True) if not g)
        want.append((i, len(u), sum(gone), hashlib.sha256(kept).hexdigest()))
    got = [tuple(r) for r in op10_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=order) == sorted(want, key=order)


def test_against_brute_force(spark, corpus, words):
    texts = [words() for _ in range(150)]
    texts += texts[:10]
    check(corpus(spark, texts), list(enumerate(texts)))


def test_many_small_segments(spark, corpus, words, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    monkeypatch.setattr(suffixes, "BLOCK", 300)
    monkeypatch.setattr(substrings, "BLOCK", 300)
    monkeypatch.setattr(suffixes, "TOGETHER", 900)
    monkeypatch.setattr(substrings, "TOGETHER", 900)
    texts = [words() for _ in range(60)]
    check(corpus(spark, texts).repartition(7), list(enumerate(texts)))


def test_periodic_texts(spark, corpus):
    texts = ["a" * 200, "a" * 49, "a" * 50, "ab" * 80, "b" * 60 + "a" * 60, "na " * 40, "na " * 12, "na na x " * 10]
    check(corpus(spark, texts), list(enumerate(texts)))


PERIODIC = ["a " * 13, "ha ho hi " * 5, "na na x " * 6, "x " + "ha ho hi " * 5, "p q r s t u v w p q r s t " * 2, "menu home menu about menu home menu about home " * 2]


@pytest.mark.parametrize("method", [BYTES, WORDS])
def test_periodic_passages_at_every_place(method):
    """A repeated periodic passage is found wherever its copies stand in one segment."""
    for passage in PERIODIC:
        for pad in range(131):
            texts = [" ".join(f"p{i}" for i in range(pad)), f"{passage}u1 ", f"u2 u3 {passage}u4 ", f"{passage}{passage}"]
            raw = [t.encode() for t in texts]
            segment = method.read(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw])), np.arange(4), np.zeros(4, bool))
            units = [tuple(t.split()) for t in raw] if method.words else raw
            want = [bool(g) for part in brute(list(enumerate(units)), method.length) for g in part]
            assert segment.cover(method.local(segment), method.length).tolist() == want, (passage, pad)


def test_periodic_passages_across_segments(spark, corpus, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 300)
    texts = []
    for pad in range(0, 131):
        texts += [" ".join(f"p{pad}-{i}" for i in range(pad)) + f" {PERIODIC[pad % 6]}e{pad} "]
    check(corpus(spark, texts).repartition(5), list(enumerate(texts)))


def test_units_with_windows_in_another_order_differ():
    """Copies of a unit have the same windows in the same order."""
    run = np.array([5, 9, 9, 5, 9, 5, 5, 9, 5, 9, 9, 5], np.uint64)
    lo, count = np.array([0, 4, 8]), np.array([4, 4, 4])
    segment = repeats.Segment(np.arange(1), np.array([0, 12]), run, run, lo, count, np.full(3, 3, np.uint64), lo)
    assert segment.distinct(np.arange(3), 1)[2].tolist() in ([0, 1, 0], [1, 0, 1])


def test_odd_rows(spark, odd):
    from tests.llm.conftest import ODD

    small = [(i, t) for i, t in ODD if not t or len(t) < 10_000]
    check(odd.where("text is null or length(text) < 10000"), small)
    got = {r["doc_id"]: r for r in op9_bytes(odd).where("doc_id >= 6").collect()}
    assert got[8]["n_removed"] == got[8]["n_bytes"] and got[6]["n_removed"] == got[7]["n_removed"] == 0


@pytest.mark.parametrize("unit", [BYTES, WORDS])
def test_empty_table(none, unit):
    assert remove_repeats(none, unit).count() == 0


def test_spans_and_texts(spark, corpus):
    passage = " ".join(f"w{i}" for i in range(15))
    rows = {r["doc_id"]: r for r in remove_repeats(corpus(spark, [passage, f"x {passage} y"]), WORDS).collect()}
    assert [tuple(s) for s in rows[1]["removed"]] == [(1, 16)] and bytes(rows[1]["kept"]) == b"x y" and rows[0]["removed"] == []


def test_frequent_seeds(spark, corpus, words, monkeypatch):
    """Seeds over the limit are grouped by their windows, with the same result."""
    monkeypatch.setattr(repeats, "HOT", 2)
    monkeypatch.setattr(repeats, "SEGMENT", 500)
    texts = [words() for _ in range(60)] + ["ab " * 100, "x " + "ab " * 70, "ab " * 12]
    check(corpus(spark, texts).repartition(5), list(enumerate(texts)))


def test_refinement_doubles_its_depth():
    random.seed(4)
    assert suffixes.depths() == [8, 16, 32, 50] and suffixes.depths(50, 3) == [3, 6, 12, 24, 48, 50]
    for gram in (1, 3, 8):
        texts = [bytes(random.choices(b"ab", k=random.randint(20, 200))) for _ in range(6)] + [b"a" * 90, b"ab" * 40]
        text = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum([len(t) for t in texts])
        begin = end - [len(t) for t in texts]
        pointer = suffixes.refine(text, begin, end, 20, gram)
        where = [(b + i, t[i : i + 20]) for b, t in zip(begin.tolist(), texts, strict=True) for i in range(len(t) - 19)]
        by_text, by_bucket = {}, {}
        for at, s in where:
            by_text.setdefault(s, set()).add(at)
            by_bucket.setdefault(pointer[at], set()).add(at)
        assert sorted(map(sorted, by_text.values())) == sorted(map(sorted, by_bucket.values()))
        # pointers order the strings
        assert [s for _, s in sorted((pointer[at], s) for at, s in where)] == sorted(s for _, s in where)


def test_matches_are_extended_both_ways():
    def row(left, right):
        ids = lambda w: np.array([hash(x) & 0xFFFF_FFFF for x in w] + [0] * (6 - len(w)), np.uint64)
        return ids(left), np.arange(6) < len(left), ids(right), np.arange(6) < len(right)

    rows = [row("abcdef", "uvwxyz"), row("abcdeX", "uvwxyz"), row("abX", "uvwxyQ"), row("abcdef", "u"), row("", "uvwxyz"), row("XYZ", "QQ")]
    left, has_left, right, has_right = (np.array(x) for x in zip(*rows, strict=True))
    least = substrings.extend(np.full(6, 7, np.uint64), left, has_left, right, has_right, np.array([3, 2, 1, 0, 4, 0]))
    # columns: words to the left; the rest of the six to the right
    assert least.tolist() == [[2, 1, 1, 2, 2, 0, 0], [2, 1, 1, 2, 2, 0, 2], [1] * 7, [0] * 7, [2, 4, 4, 4, 4, 4, 4], [0] * 7]


@pytest.mark.parametrize("method, module", [(BYTES, suffixes), (WORDS, substrings)])
def test_blocks_and_small_steps(words, monkeypatch, method, module):
    """A segment's own repeats are the same however it is cut."""
    texts = [words().encode() for _ in range(80)]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    args = np.frombuffer(b"".join(texts), np.uint8), at, np.arange(80), np.zeros(80, bool)
    segment = method.read(*args)
    whole = segment.cover(method.local(segment), method.length)
    units = [tuple(t.split()) for t in texts] if method.words else texts
    assert whole.tolist() == [bool(g) for part in brute(list(enumerate(units)), method.length) for g in part]
    monkeypatch.setattr(module, "BLOCK", 64)
    monkeypatch.setattr(module, "TOGETHER", 700)
    small = method.read(*args)
    assert (small.cover(method.local(small), method.length) == whole).all()


def test_messages_stay_proportional():
    for total in (10**9, 3 * 10**10, 10**12, 10**14):
        parts, ranges_ = repeats.sizes_of(total)
        assert parts * ranges_ <= total / 500 and total / parts <= 1e9 and total / ranges_ <= 2e8
