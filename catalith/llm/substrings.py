"""Repeated word sequences by seed and extend.

Anchors are winnowed: of the seven-word grams of each window of 13 words the one with
the least identifier is an anchor, at every place where the window has it. Which places
those are depends on the window's words alone, not on where it stands, so equal windows
have all their anchors in common, at the same places. Documents are joined on anchors (``repeats``). From a shared anchor the match
is extended word by word: to the left, each step parts the occurrences by the word
there, and an occurrence that no other one shares stops; to the right likewise. What
occurrences share on both sides is a match; it counts once it is 13 words long, in
every position around the anchor. Neighbouring anchors carry a match on, so the words
covered by matches are the maximal repeats.

All occurrences of an anchor are extended together, by classes rather than by pairs,
so n occurrences cost n steps for each word. Words and anchors are 64-bit
identifiers. Null ids, empty and long texts, repeated rows, clashing columns and
empty tables are as ``repeats`` states.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm import repeats
from catalith.llm.grams import BLANK, BYTE, join_ids, mix, qgrams, sliding_min, tokens
from catalith.llm.repeats import Method, Segment, blocks, n_removed, ranges, remove_repeats

LENGTH, ANCHOR = 13, 7
REACH = LENGTH - ANCHOR
#: Bytes that are extended together, unless one anchor has more, and symbols hashed at a time.
TOGETHER, BLOCK = 4 << 20, 1 << 16

_U = np.uint64


def classes(key: np.ndarray, going: np.ndarray) -> np.ndarray:
    """Numbers of equal keys among the rows that go on; -1 for the others and for keys that only one row has."""
    out = np.full(len(key), -1, np.int64)
    at = np.flatnonzero(going)
    if len(at):
        order = at[np.argsort(key[at])]
        head = np.append(True, key[order][1:] != key[order][:-1])
        size = np.diff(np.append(np.flatnonzero(head), len(order)))
        out[order] = np.where(np.repeat(size, size) > 1, np.cumsum(head) - 1, -1)
    return out


def walk(anchor: np.ndarray, words: np.ndarray, there: np.ndarray) -> list[np.ndarray]:
    """Classes of occurrences that agree on the anchor and on 0, 1, ... words from it on one side."""
    out = [classes(anchor, np.ones(len(anchor), bool))]
    for k in range(words.shape[1]):
        key = mix(out[-1].astype(_U) * _U(0x9E3779B97F4A7C15) + words[:, k])
        out.append(classes(key, there[:, k] & (out[-1] >= 0)))
    return out


def extend(anchor: np.ndarray, left: np.ndarray, has_left: np.ndarray, right: np.ndarray, has_right: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Column l: the least owner among occurrences that agree on l words to the left and REACH - l to the right."""
    to_left, to_right = walk(anchor, left, has_left), walk(anchor, right, has_right)
    least = np.repeat(owner[:, None], REACH + 1, 1)
    for n in range(REACH + 1):
        a, b = to_left[n], to_right[REACH - n]
        at = np.flatnonzero((a >= 0) & (b >= 0))
        if len(at):
            both = a[at] * len(anchor) + b[at]
            order = np.argsort(both)
            first = np.flatnonzero(np.append(True, both[order][1:] != both[order][:-1]))
            least[at[order], n] = np.repeat(np.minimum.reduceat(owner[at[order]], first), np.diff(np.append(first, len(order))))
    return least


def compare(seed: np.ndarray, count: np.ndarray, place: np.ndarray, owner: np.ndarray, load: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The least owner of each window's words; windows in the order of their units."""
    words = load.view(_U)
    total = sizes // 8
    begin, window = np.cumsum(total) - total, np.cumsum(count) - count
    least = np.empty(int(count.sum()), np.int64)
    side = np.arange(REACH)
    for units in blocks(seed, sizes, TOGETHER):
        n_left, n = place[units][:, None], total[units][:, None]
        has_left, has_right = side < n_left, side < n - n_left
        first = begin[units][:, None]
        left = words[np.where(has_left, first + n_left - 1 - side, 0)]
        right = words[np.where(has_right, first + n_left + side, 0)]
        found = extend(seed[units], left, has_left, right, has_right, owner[units])
        row, k = ranges(np.zeros(len(units), np.int64), count[units])[0], np.repeat(np.arange(len(units)), count[units])
        least[ranges(window[units], window[units] + count[units])[0]] = found[k, place[units][k] - row]
    return least


def _read(text: np.ndarray, at: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Segment:
    """Units are anchors, with all windows around them."""
    held, first, total = [], [np.zeros(1, np.int64)], 0
    step = np.unique(np.searchsorted(at, np.arange(at[0], at[-1] + 1, BLOCK * 8), "left").clip(0, len(at) - 1)).tolist()
    for i, j in itertools.pairwise(sorted({0, *step, len(at) - 1})):
        got, _, _, begin = tokens(text, at[i : j + 1], BYTE, BLANK)
        held.append(got)
        first.append(begin[1:] + total)
        total += len(got)
    symbols, first = (np.concatenate(held) if held else np.zeros(0, _U)), np.concatenate(first)
    n = len(symbols)
    run, gram = np.zeros(n, _U), np.zeros(n, _U)
    anchors, valid = np.zeros(n, bool), repeats.starts(n, first, LENGTH, copies)
    for s in range(0, n - LENGTH + 1, BLOCK):
        g = qgrams(symbols[s : s + BLOCK + LENGTH - 1], ANCHOR)
        m = len(g) - REACH
        run[s : s + m] = mix(join_ids(g[:m], g[REACH:][:m]))
        g = mix(g)
        gram[s : s + len(g)] = g
        least = sliding_min(g, REACH + 1)
        for k in range(REACH + 1):
            anchors[s + k : s + k + m] |= valid[s : s + m] & (g[k : k + m] == least)
    anchor = np.flatnonzero(anchors)
    doc = np.searchsorted(first, anchor, "right") - 1
    lo = np.maximum(first[doc], anchor - REACH)
    hi = np.minimum(first[doc + 1] - LENGTH, anchor)
    return Segment(ids, first, symbols, run, lo, hi - lo + 1, gram[anchor], anchor)


def _send(segment: Segment, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words to the left of each anchor and to its right, in the order of the text."""
    lo, place = segment.lo[units], segment.place[units]
    end = lo + segment.count[units] + LENGTH - 1
    at = np.empty(2 * len(units), np.int64)
    upto = at.copy()
    at[::2], upto[::2], at[1::2], upto[1::2] = lo, place, place + ANCHOR, end
    return segment.symbols[ranges(at, upto)[0]].view(np.uint8), 8 * (end - lo - ANCHOR)


WORDS = Method(True, LENGTH, _read, _send, compare)


def op10_words(docs: DataFrame) -> DataFrame:
    """13-word windows that start in a smaller document, removed."""
    return remove_repeats(docs, WORDS).select(
        "doc_id", F.col("n_symbols").alias("n_words"), n_removed(), F.sha2("kept", 256).alias("kept_sha256")
    )
