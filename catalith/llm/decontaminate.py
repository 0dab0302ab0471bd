"""Benchmark decontamination with spaced seeds.

A seed is a mask over eleven token positions of which seven count; tokens at the
others may differ. Each mask gives every window of eleven tokens a hash.

1. Items with equal tokens are one class, named by the least item_id. Hashes of the
   classes' windows go into a table and a Bloom filter, which has a fixed largest size.
2. One pass over the documents keeps windows whose hash the filter has. It only
   saves work: what it lets through is joined with the table of hashes. With 32
   bits a hash and eight probes it lets one foreign window in 200 000 through.
3. Documents with equal tokens are one class, too, of which one is compared.
   Each join hit names a diagonal (document position minus item position). On a
   diagonal the aligned tokens are compared. A stretch is an overlap if it has
   ``least`` tokens, or the whole item where that is shorter, if at most a fifth of
   them differ, and if it begins and ends with equal tokens or where the item does.
   Reported is the best stretch by +1 a match and -3 a mismatch if it is an overlap,
   and the longest overlap otherwise.

Tokens are runs of letters and digits, ASCII lower-cased; other ASCII characters
part them. Items of up to ``SHORT`` tokens have masks of their own length, which leave
out as many of five sets of positions as tokens may differ, so no substitution that
the rule allows is missed; items of fewer than ``shortest`` tokens, a parameter, are
no evidence. The masks of longer items find at least 0.96 of whole copies with as many
tokens changed, anywhere, as the rule allows; README has the shares. Null texts have no
tokens. Repeated rows are found each for itself; of equally good diagonals the
first counts. A document with a null doc_id is reported with it and never
dropped. ``decontaminate`` drops rows by doc_id and text together, so of two texts with
one doc_id a clean one stays; it keeps all columns, whatever their names. No rows, or no
benchmark, find nothing.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalith.llm.bloom import bloom, held
from catalith.llm.common import cut
from catalith.llm.graph import join_keys
from catalith.llm.grams import LOWER, PUNCT, chunks, mix, stream, tokens, utf8

MASKS = ("11110001101", "10011010111", "11101010011")
SHORTEST, SHORT, LEAST = 5, 15, 13
#: Rows of benchmark hashes, and of found documents, up to which they are broadcast; they are counted first.
BROADCAST_HASHES, BROADCAST_FOUND = 1_000_000, 1_000_000

_U = np.uint64
_PLACE = stream(64, 21)
_SCHEMA = "uid long, doc_id long, text_hash long, digest binary, tokens binary, hits array<struct<hash:long,pos:long>>"


def masks_of(n: int) -> list[str]:
    """Masks of a short length, one of which fits wherever a fifth of the tokens differ."""
    return ["".join("0" if j % 5 in out else "1" for j in range(n)) for out in itertools.combinations(range(5), n // 5)]


def _seeds(ids: np.ndarray, first: np.ndarray, short: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, position among ids) of all windows within one text, for each mask and short length."""
    for k, mask in enumerate([*MASKS, *(mask for n in short for mask in masks_of(n))]):
        span = len(mask)
        m = len(ids) - span + 1
        if m <= 0:
            continue
        h = np.full(m, _PLACE[32 + k] if k < len(MASKS) else mix(np.array([int("1" + mask, 2)], _U) * _PLACE[50])[0], _U)
        for j, c in enumerate(mask):
            if c == "1":
                h += ids[j : j + m] * (_PLACE[j] | _U(1))
        inside = np.ones(m, bool)
        for e in first[1:-1].tolist():  # windows that leave a text
            inside[max(0, e - span + 1) : e] = False
        h = mix(h)
        at = np.flatnonzero(inside)
        yield h[at], at


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Benchmark items as token identifiers."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        ids, _, _, first = tokens(data, at, LOWER, PUNCT)
        parts = [ids[a:b].tobytes() for a, b in itertools.pairwise(first.tolist())]
        sizes = np.diff(first)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), pa.array(parts, pa.binary()), pa.array(sizes, pa.int64())], ["item_id", "tokens", "n"]
        )


def _item_hashes(short: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, hashes, places = [], [], []
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.frombuffer(raw.as_buffer(), _U)
                for h, at in _seeds(ids, np.array([0, len(ids)]), [len(ids)] if len(ids) in short else []):
                    items += [i] * len(h)
                    hashes.append(h)
                    places.append(at)
            h = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            p = np.concatenate(places) if places else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(items, pa.int64()), pa.array(p, pa.int64())], ["hash", "item", "at"])

    return run


def _scan(short: list[int], bits: int, bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36)
        has = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            data, at = utf8(batch.column(1))
            names, of_text = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for i, j in chunks(at):
                ids, _, _, first = tokens(data, at[i : j + 1], LOWER, PUNCT)
                found = []
                for h, pos in _seeds(ids, first, short):
                    keep = held(has, h.view(np.int64), bits)
                    found.append((pos[keep], h[keep]))
                pos = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
                if not len(pos):
                    continue
                h = np.concatenate([x for _, x in found]).view(np.int64)
                order = np.argsort(pos, kind="stable")
                pos, h = pos[order], h[order]
                doc = np.searchsorted(first, pos, "right") - 1
                rows: list[list] = [[], [], [], [], [], []]
                for d in np.unique(doc).tolist():
                    a, b = np.searchsorted(doc, [d, d + 1])
                    rows[0].append(next(serial))
                    rows[1].append(names[i + d])
                    rows[2].append(of_text[i + d])
                    rows[4].append(ids[first[d] : first[d + 1]].tobytes())
                    rows[3].append(hashlib.blake2b(rows[4][-1], digest_size=16).digest())
                    rows[5].append([{"hash": x, "pos": y} for x, y in zip(h[a:b].tolist(), (pos[a:b] - first[d]).tolist(), strict=True)])
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.struct([("hash", pa.int64()), ("pos", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], ["uid", "doc_id", "text_hash", "digest", "tokens", "hits"])

    return run


def best_stretch(equal: np.ndarray) -> tuple[int, int]:
    """(start, end) of the stretch with the greatest +1 / -3 sum; the first of several."""
    score = np.append(0, np.cumsum(np.where(equal, 1, -3)))
    low = np.minimum.accumulate(score)
    end = int(np.argmax(score - low))
    return int(np.flatnonzero(score[: end + 1] == low[end])[-1]), end


def longest_stretch(equal: np.ndarray, opens: bool, closes: bool) -> tuple[int, int]:
    """(start, end) of the longest stretch of which at most a fifth differs; the first of several.

    It begins and ends with equal tokens, or at the ends of the row where ``opens``
    and ``closes`` say that the item begins and ends there.
    """
    score = np.append(0, np.cumsum(np.where(equal, 1, -4)))
    first, last = equal.copy(), equal.copy()
    first[:1] |= opens
    last[-1:] |= closes
    low = np.minimum.accumulate(np.where(first, score[:-1], len(equal) + 1))
    ends = np.flatnonzero(last) + 1
    starts = np.searchsorted(-low, -score[ends])  # the first that lies no higher
    sizes = ends - starts
    if not len(sizes) or sizes.max() <= 0:
        return 0, 0
    k = int(np.argmax(sizes))
    return int(starts[k]), int(ends[k])


def _verify(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["digest", "item_id", "copies", "start", "end", "matched"]
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            rows = zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), batch.column(3), batch.column(4), batch.column(5).to_pylist(), strict=True)
            for doc, item, copies, text, other, diagonals in rows:
                t, o = np.frombuffer(text.as_buffer(), _U), np.frombuffer(other.as_buffer(), _U)
                best = None
                for d in sorted(diagonals):
                    a, b = max(0, d), min(len(t), len(o) + d)
                    equal = t[a:b] == o[a - d : b - d]
                    for i, j in (best_stretch(equal), longest_stretch(equal, a == d, b == len(o) + d)):
                        good = int(equal[i:j].sum())
                        if j - i >= min(least, len(o)) and 5 * good >= 4 * (j - i):
                            if best is None or good > best[2]:
                                best = (a + i, a + j, good)
                            break
                if best:
                    for c, v in zip(out, (doc, item, copies, *best), strict=True):
                        c.append(v)
            kinds = [pa.binary(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


def _found(docs: DataFrame, benchmark: DataFrame, least: int, shortest: int) -> tuple[DataFrame, DataFrame]:
    """Documents with hits (uid, doc_id, text_hash, digest), and overlaps (digest, item_id, copies, start, end, matched) of classes."""
    spark = docs.sparkSession
    items = (
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
        .mapInArrow(_items, "item_id long, tokens binary, n long")
        .where(F.col("n") >= shortest)
    )
    items = items.groupBy("tokens").agg(F.min("item_id").alias("item_id"), F.first("n").alias("n"), F.count("*").alias("copies"))
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))
    short = sorted(r[0] for r in items.where(F.col("n") <= SHORT).select("n").distinct().collect())  # SHORT values at most
    hashes = cut(items.select("item", "tokens").mapInArrow(_item_hashes(short), "hash long, item long, at long"))
    n = hashes.count()
    bitmap, bits = bloom(hashes.select("hash"), n)
    shared = spark.sparkContext.broadcast(bitmap)
    text = F.col("text").cast("string")
    found = cut(docs.select(F.col("doc_id").cast("long"), text, F.xxhash64(text)).mapInArrow(_scan(short, bits, shared), _SCHEMA))
    one = found.join(found.groupBy("digest").agg(F.min("uid").alias("uid")).select("uid"), "uid", "left_semi")
    known = F.broadcast(hashes) if n <= BROADCAST_HASHES else hashes
    hits = one.select("uid", F.explode("hits").alias("h")).select("uid", F.col("h.hash").alias("hash"), F.col("h.pos").alias("pos"))
    lines = hits.join(known, "hash").groupBy("uid", "item").agg(F.collect_set(F.col("pos") - F.col("at")).alias("diagonals"))
    pairs = lines.join(one.select("uid", "digest", "tokens"), "uid").join(items.select("item", "item_id", "copies", F.col("tokens").alias("other")), "item")
    pairs = pairs.select("digest", "item_id", "copies", "tokens", "other", "diagonals").mapInArrow(
        _verify(least), "digest binary, item_id long, copies long, start long, end long, matched long"
    )
    return found.select("uid", "doc_id", "text_hash", "digest"), pairs


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """Rows (doc_id, item_id, start, end, matched): the best overlap of a document with a class of items, in tokens."""
    found, pairs = _found(docs, benchmark, least, shortest)
    return found.join(pairs, "digest").select("doc_id", "item_id", "start", "end", "matched")


def links(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """One row for each document with an overlap: (doc_id, class_id, n_items, item_id, start, end, matched).

    ``class_id`` is the least doc_id with the same tokens, ``n_items`` the number of items
    that overlap, equal ones each; the rest is the overlap that matches most tokens, of
    equally good ones that with the least item_id. So there are as many rows as documents,
    however many items share a line.
    """
    found, pairs = _found(docs, benchmark, least, shortest)
    best = F.max_by(F.struct("item_id", "start", "end", "matched"), F.struct("matched", -F.coalesce("item_id", F.lit(-1))))
    sums = cut(pairs.groupBy("digest").agg(F.sum("copies").alias("n_items"), best.alias("best")))
    # Documents without a doc_id aren't named, so a class has the least id of the others.
    named = cut(join_keys(found, sums, "digest"))
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("class_id"))
    return join_keys(named, classes, "digest").select("doc_id", "class_id", "n_items", "best.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, shortest: int = SHORTEST) -> DataFrame:
    """The documents without an overlap, with the columns they came with; those with a null id stay."""
    found, pairs = _found(docs, benchmark, least, shortest)
    hit = found.join(pairs.select("digest").distinct(), "digest", "left_semi").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    hit = cut(hit)
    few = hit.count() <= BROADCAST_FOUND
    same = (docs["doc_id"].cast("long") == hit["_id"]) & (F.xxhash64(docs["text"].cast("string")) == hit["_hash"])
    return docs.join(F.broadcast(hit) if few else hit.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)
