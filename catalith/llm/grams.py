"""Vectorised identifiers of words, shingles and q-grams over Arrow text buffers.

Identifiers are 64-bit and well mixed. All arithmetic is modulo 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at a time; a longer text is worked on alone.
CHUNK = 1 << 20

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values, in place."""
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """``n`` seeded 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x10001)) * _U(0x9E3779B97F4A7C15))


#: An identifier for each byte, and for each byte with A-Z lower-cased.
BYTE = stream(256, 1)
LOWER = BYTE[np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)])]
#: Bytes between words: white space; or all of ASCII but letters and digits.
BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _grown(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base), np.ones(1, dtype=_U))
    while len(held) < n:
        held = np.concatenate([held, held * (held[-1:] * base)])
    _powers[int(base)] = held
    return held


def powers(n: int) -> np.ndarray:
    """At least ``n`` powers of an odd base."""
    return _grown(_BASE, n)


def inverses(n: int) -> np.ndarray:
    """At least ``n`` powers of the base's inverse modulo 2**64."""
    return _grown(_INVERSE, n)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def chunks(at: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``size`` bytes together, or one text."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + size, "right")) - 1)
        yield i, j
        i = j


def tokens(data: np.ndarray, at: np.ndarray, table: np.ndarray = BYTE, blank: np.ndarray = BLANK):
    """Words of the texts data[at[i]:at[i+1]].

    Returns identifiers, starts and ends (relative to at[0]) and, for each text,
    the number of its first word, with the number of words last.
    """
    text = data[at[0] : at[-1]]
    at = at - at[0]
    n = len(text)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    out = blank[text]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = out[:-1]
    edge[at] = True
    starts = np.flatnonzero(edge[:n] & ~out)
    edge[1:n] = out[1:]
    edge[at] = True
    ends = np.flatnonzero(edge[1:] & ~out) + 1
    first = np.searchsorted(starts, at)
    if not len(starts):
        return np.zeros(0, _U), starts, ends, first
    lengths = ends - starts
    where = np.flatnonzero(~out)
    begin = np.zeros(len(starts), np.int64)
    np.cumsum(lengths[:-1], out=begin[1:])
    value = table[text[where]]
    where -= np.repeat(starts, lengths)
    value *= powers(int(lengths.max()))[where]
    ids = np.add.reduceat(value, begin)
    ids += lengths.astype(_U) * _U(0xD6E8FEB86659FD93)
    return mix(ids), starts, ends, first


def shingles(ids: np.ndarray, k: int) -> np.ndarray:
    """Identifiers of all runs of ``k`` words; runs across texts included."""
    m = len(ids) - k + 1
    if m <= 0:
        return np.zeros(0, _U)
    out = ids[:m] * _U(k | 1)
    for j in range(1, k):
        out *= _BASE
        out += ids[j : j + m]
    return mix(out)


def join_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of a string from those of two of its parts, at fixed offsets."""
    out = a * _U(0xC2B2AE3D27D4EB4F)
    out += b
    out ^= out >> _U(29)
    return out


def qgrams(ids: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of all q-grams, by joining those of half the length at later offsets."""
    k = 1
    while 2 * k <= q:
        ids = join_ids(ids[: max(0, len(ids) - k)], ids[k:])
        k *= 2
    if k < q:
        ids = join_ids(ids[: max(0, len(ids) - (q - k))], ids[q - k :])
    return ids


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` consecutive values."""
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[: max(0, len(x) - k)], x[k:])
        k *= 2
    if k < w:
        x = np.minimum(x[: max(0, len(x) - (w - k))], x[w - k :])
    return x
