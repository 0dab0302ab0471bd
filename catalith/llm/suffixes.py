"""Repeated byte strings by bucket-pointer refinement of suffixes.

Suffixes that may repeat come in by their seeds (``repeats``), those of one seed
together. They are put into buckets by their first ``GRAM`` bytes, and each suffix
has a pointer to its bucket. A bucket is refined by sorting its suffixes on the
pointers of the suffixes that start ``GRAM`` bytes later: what has been refined for
those is used at once, so the depth of the buckets doubles: 8, 16, 32 and then the 50
bytes asked for, by the pointers 18 bytes later. A suffix that is alone in its bucket
is settled and leaves. Suffixes that end before a depth have no pointer of it. At the
end each bucket holds equal strings, and the least document in it removes the others.

Equality is that of the bytes themselves; only seeds, which choose what is compared,
are hashes, and equal contents sent by several segments are compared once, by a
64-bit identifier. Null ids, empty and long texts, repeated rows, clashing columns
and empty tables are as ``repeats`` states.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm import repeats
from catalith.llm.grams import BYTE, join_ids, mix, powers, qgrams, sliding_min
from catalith.llm.repeats import Method, Segment, blocks, n_removed, ranges, remove_repeats

LENGTH, GRAM, SEED = 50, 8, 25
#: Bytes that are refined together, unless one seed has more, and symbols hashed at a time.
TOGETHER, BLOCK = 1 << 20, 1 << 16

_U = np.uint64


def depths(length: int = LENGTH, gram: int = GRAM) -> list[int]:
    """Depths of the buckets, each at most twice the one before."""
    out = [gram]
    while out[-1] < length:
        out.append(min(2 * out[-1], length))
    return out


def refine(text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """Bucket pointers of the suffixes of the strings text[begin:end], equal where ``length`` bytes are equal.

    Pointers are defined for suffixes with ``length`` bytes or more.
    """
    key = np.zeros(len(text), _U)
    for j in range(gram):
        key[: len(text) - j] |= text[j:].astype(_U) << _U(8 * (gram - 1 - j))
    at, count = ranges(begin, np.maximum(begin, end - gram + 1))
    room = (np.repeat(end, count) - at).astype(np.int32)
    order = np.argsort(key[at])
    at, room = at[order].astype(np.int32), room[order]
    value = key[at]
    pointer = np.full(len(text), -1, np.int32)
    head = np.append(True, value[1:] != value[:-1])[: len(at)]
    start = np.flatnonzero(head)
    pointer[at] = np.repeat(start, np.diff(np.append(start, len(at))))
    del key, value
    for depth, deeper in zip(depths(length, gram)[:-1], depths(length, gram)[1:], strict=True):
        size = np.bincount(pointer[at], minlength=1)
        stay = (size[pointer[at]] > 1) & (room >= deeper)  # others are settled, or too short for this depth
        at, room = at[stay], room[stay]
        own, later = pointer[at].astype(np.int64), pointer[at + (deeper - depth)]
        order = np.argsort(own * len(text) + later)
        at, room, own, later = at[order], room[order], own[order], later[order]
        fresh = np.append(True, own[1:] != own[:-1])[: len(at)]  # a bucket begins, and parts of it:
        head = fresh | np.append(True, later[1:] != later[:-1])[: len(at)]
        place = np.arange(len(at))
        pointer[at] = own + np.maximum.accumulate(place * head) - np.maximum.accumulate(place * fresh)
    return pointer


def compare(seed: np.ndarray, count: np.ndarray, place: np.ndarray, owner: np.ndarray, load: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least owner of each window's 50 bytes; windows in the order of their units."""
    least = np.empty(int(count.sum()), np.int64)
    window, byte = np.cumsum(count) - count, np.cumsum(sizes) - sizes
    for units in blocks(seed, sizes, TOGETHER):
        size = sizes[units]
        text = load[ranges(byte[units], byte[units] + size)[0]]
        begin = np.cumsum(size) - size
        # equal contents are compared once, as the least owner's
        at = np.arange(len(text)) - np.repeat(begin, size)
        name = np.add.reduceat(BYTE[text] * powers(int(size.max()))[at], begin) + size.astype(_U)
        order = np.lexsort((owner[units], name))
        new = np.append(True, name[order][1:] != name[order][:-1])
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        heads = order[new]
        text = text[ranges(begin[heads], begin[heads] + size[heads])[0]]
        end = np.cumsum(size[heads])
        n = count[units[heads]]
        start = ranges(end - size[heads], end - size[heads] + n)[0]
        bucket = refine(text, end - size[heads], end)[start]
        own = np.repeat(owner[units[heads]], n)
        order = np.argsort(bucket)
        first = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1]))
        found = np.empty(len(bucket), np.int64)
        found[order] = np.repeat(np.minimum.reduceat(own[order], first), np.diff(np.append(first, len(order))))
        base = np.cumsum(n) - n
        least[ranges(window[units], window[units] + count[units])[0]] = found[ranges(base[of], base[of] + count[units])[0]]
    return least


def _read(text: np.ndarray, at: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Segment:
    """Units are stretches of windows whose least ``SEED``-gram is the same."""
    n = len(text)
    run, key = np.zeros(n, _U), np.zeros(n, _U)
    for s in range(0, n - LENGTH + 1, BLOCK):
        gram = qgrams(BYTE[text[s : s + BLOCK + LENGTH - 1]], SEED)
        m = len(gram) - (LENGTH - SEED)
        run[s : s + m] = mix(join_ids(gram[:m], gram[LENGTH - SEED :][:m]))
        gram = mix(gram)
        gram &= ~_U(63)
        gram |= np.arange(s, s + len(gram), dtype=_U) & _U(63)
        key[s : s + m] = sliding_min(gram, LENGTH - SEED + 1)
    valid = repeats.starts(n, at, LENGTH, copies)
    same = np.zeros(n + 1, bool)
    same[1:n] = valid[1:] & valid[:-1] & (key[1:] == key[:-1])
    lo = np.flatnonzero(valid & ~same[:n])
    hi = np.flatnonzero(valid & ~same[1:])
    return Segment(ids, at, text, run, lo, hi - lo + 1, mix(key[lo] & ~_U(63)), lo)


def _send(segment: Segment, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = segment.count[units] + LENGTH - 1
    return segment.symbols[ranges(segment.lo[units], segment.lo[units] + sizes)[0]], sizes


BYTES = Method(False, LENGTH, _read, _send, compare)


def op9_bytes(docs: DataFrame) -> DataFrame:
    """50-byte strings that start in a smaller document, removed."""
    return remove_repeats(docs, BYTES).select(
        "doc_id",
        F.col("n_symbols").alias("n_bytes"),
        n_removed(),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
