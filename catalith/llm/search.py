"""Ranked search over all documents for a set of queries, by sort-based accumulation.

1. Queries are dealt into blocks whose terms fit one sorted array of identifiers; only
   such a block goes to every task. One block is the rule: it takes a million terms.
2. A kernel reads each run of documents once and keeps, in one packed row, the
   occurrences of the block's terms: document, length, term and frequency. The rows are
   checkpointed; document frequencies and lengths are added up from them.
3. Accumulation. A range of documents (a packed row) is worked on alone, as a document's
   score needs no other: for each posting the impact goes to all items that have the
   term, in concatenated arrays of item, document and impact. Keys of item and document
   are radix sorted, 16 bits at a time, and ``reduceat`` adds up each key's impacts.
4. A task keeps each item's best documents over its ranges in a heap, and Spark ranks
   what the tasks send: at most ``top`` rows an item and task.

Terms are compared by 64-bit identifiers, so two terms are confused with a chance of
one in 2^64 for each pair. All else is whole numbers.

Null and blank texts have no terms, and neither count as documents nor match. Null
doc_ids are taken as the largest id, repeated rows are documents of their own, and equal
scores go by doc_id, then by row. Rows sharing an item_id, null included, are one item
with the terms of all; an item without terms has no rows. Texts are read whole, other
columns not at all; no documents or no items give no rows.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import cut
from catalith.llm.grams import LOWER, chunks, tokens, utf8

TOP = 10
#: Terms of queries that one block of queries has at most (8 MB of identifiers), repeats over items counted; items too.
TERMS, ITEMS = 1 << 20, 1 << 16
#: Bytes of text in a packed row, and entries that are accumulated together.
RANGE, TOGETHER = 4 << 20, 1 << 21
#: Tasks that the rows of one item are ranked in before the last ranking.
SALTS = 64
LAST = np.iinfo(np.int64).max
#: The length's part of a document's weight in percent, and what scales impacts.
SLOPE, SCALE = 90, 1_000_000_000

#: Bytes between terms: all of ASCII but letters and digits.
BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_PACKED = "docs long, total long, ids binary, lengths binary, sizes binary, terms binary, counts binary"


def _term_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, term): identifiers of the different terms of each text."""
    for batch in batches:
        data, at = utf8(batch.column(1))
        for i, j in chunks(at):
            ids, _, _, first = tokens(data, at[i : j + 1], LOWER, BETWEEN)
            row = np.repeat(np.arange(i, j), np.diff(first))
            order = np.lexsort((ids, row))
            new = np.append(True, (ids[order][1:] != ids[order][:-1]) | (row[order][1:] != row[order][:-1]))[: len(order)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[order][new])), pa.array(ids[order][new].view(np.int64))], ["item", "term"])


def _postings(vocabulary: np.ndarray):
    """Packed rows of the documents' occurrences of terms of the sorted vocabulary; counts of all documents with terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column(0).fill_null(LAST).to_numpy(zero_copy_only=False)
            data, at = utf8(batch.column(1))
            for i, j in chunks(at, RANGE):
                ids, _, _, first = tokens(data, at[i : j + 1], LOWER, BETWEEN)
                length = np.diff(first)
                place = np.searchsorted(vocabulary, ids).clip(max=len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[place] == ids)
                key = np.repeat(np.arange(j - i), length)[hit] * len(vocabulary) + place[hit]
                key, counts = np.unique(key, return_counts=True)
                doc, term = np.divmod(key, len(vocabulary))
                sizes = np.bincount(doc, minlength=j - i)
                some = np.flatnonzero(sizes)
                arrays = doc_ids[i:j][some], length[some].astype(np.int64), sizes[some].astype(np.uint32), term.astype(np.uint32), counts.astype(np.uint32)
                row = [[int((length > 0).sum())], [int(length.sum())], *[[a.tobytes()] for a in arrays]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, pa.int64() if k < 2 else pa.binary()) for k, v in enumerate(row)],
                    ["docs", "total", "ids", "lengths", "sizes", "terms", "counts"],
                )

    return run


def _frequencies(width: int):
    """Rows (term, n): how many documents of the partition have each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for terms in batch.column(0):
                total += np.bincount(np.frombuffer(terms.as_py(), np.uint32), minlength=width)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    return run


def radix_order(key: np.ndarray, most: int) -> np.ndarray:
    """The stable order of whole numbers in 0..most, by counting sorts of 16 bits at a time."""
    order = np.argsort((key & 0xFFFF).astype(np.uint16), kind="stable")
    for shift in range(16, int(most).bit_length(), 16):
        digit = ((key >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
    return order


def impacts(weight: np.ndarray, count: np.ndarray, norm: np.ndarray) -> np.ndarray:
    """What occurrences add to a score."""
    return weight * ((SCALE * count) // (1000 * count + 8 * norm))


def norms(length: np.ndarray, docs: int, total: int) -> np.ndarray:
    """100 for a document of mean length, by whole numbers of any size."""
    if SLOPE * docs * int(length.max(initial=0)) >= 1 << 63:
        return np.array([100 - SLOPE + SLOPE * n * docs // total for n in length.tolist()], np.int64)
    return 100 - SLOPE + (SLOPE * length * docs) // total


class Best:
    """The best documents of each item so far, as heaps with the worst on top."""

    def __init__(self, items: int, top: int) -> None:
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        #: Scores below these can't come in any more.
        self.worst = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Take in rows in the order of items. Long runs are thinned to their best by selection first, ties kept."""
        keep = np.flatnonzero(score >= self.worst[item])
        item, score, doc = item[keep], score[keep], doc[keep]
        edge = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
        for i, j in itertools.pairwise([*edge.tolist(), len(item)]):
            k, scores, docs = int(item[i]), score[i:j], doc[i:j]
            if j - i > 4 * self.top:
                some = np.flatnonzero(scores >= np.partition(scores, -self.top)[-self.top])
                scores, docs = scores[some], docs[some]
            heap = self.heaps[k]
            for entry in zip(scores.tolist(), (-docs).tolist(), strict=True):
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.worst[k] = heap[0][0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Items, documents and scores."""
        every = np.array([(k, -doc, score) for k, heap in enumerate(self.heaps) for score, doc in heap], np.int64).reshape(-1, 3)
        return every[:, 0], every[:, 1], every[:, 2]


def _accumulate(names: pa.Array, weight: np.ndarray, begin: np.ndarray, holders: np.ndarray, docs: int, total: int, top: int):
    """Rows (item_id, doc_id, score): the partition's best documents. Term t is held by items holders[begin[t]:begin[t + 1]]."""
    held_by, items = np.diff(begin), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(items, top)
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5)), strict=True):
                ids, length, sizes, term, count = (np.frombuffer(v.as_py(), kind) for v, kind in zip(row, (np.int64, np.int64, np.uint32, np.uint32, np.uint32), strict=True))
                if not len(ids):
                    continue
                doc = np.repeat(np.arange(len(ids)), sizes)
                added = impacts(weight[term], count.astype(np.int64), norms(length, docs, total)[doc])
                n = held_by[term]
                upto, past = np.cumsum(n), np.cumsum(sizes, dtype=np.int64)
                i = 0
                while i < len(ids):  # whole documents, so many that their entries fit
                    a = int(past[i - 1]) if i else 0
                    done = int(upto[a - 1]) if a else 0
                    fit = int(np.searchsorted(upto, done + TOGETHER, "right"))
                    j = max(i + 1, int(np.searchsorted(past, fit, "right")))
                    part = slice(a, int(past[j - 1]))
                    at = np.arange(int(n[part].sum())) + np.repeat(begin[term[part]] - (upto[part] - n[part] - done), n[part])
                    item = holders[at].astype(np.int64)
                    key = item * (j - i) + np.repeat(doc[part] - i, n[part])
                    order = radix_order(key, items * (j - i))
                    key = key[order]
                    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
                    if len(heads):
                        score = np.add.reduceat(np.repeat(added[part], n[part])[order], heads)
                        item, of = np.divmod(key[heads], j - i)
                        best.add(item, score, ids[i + of])
                    i = j
        item, doc, score = best.rows()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(item)), pa.array(doc), pa.array(score)], ["item_id", "doc_id", "score"])

    return run


def _blocks(terms: DataFrame, most_terms: int, most_items: int) -> Iterator[pa.Table]:
    """(item, term) in blocks of whole items within the bounds, or of one item."""
    total, items = terms.agg(F.count("*"), F.count_distinct(F.coalesce("item", F.lit(LAST)))).first()
    blocks = max(1, -(-total // most_terms), -(-items // most_items))
    while total:
        dealt = terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        sizes = dealt.groupBy("block").agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("item", F.lit(LAST))).alias("items")).collect()
        if all(r["items"] == 1 or (r["n"] <= most_terms and r["items"] <= most_items) for r in sizes):
            for r in sorted(sizes, key=lambda r: r["block"]):
                yield dealt.where(F.col("block") == r["block"]).select("item", "term").toArrow().combine_chunks()
            return
        blocks *= 2


def _search_block(texts: DataFrame, queries: pa.Table, top: int) -> DataFrame | None:
    """(item_id, doc_id, score): each task's best documents for the queries; None without documents."""
    names = queries["item"].combine_chunks().dictionary_encode(null_encoding="encode")
    vocabulary, term = np.unique(queries["term"].to_numpy().view(np.uint64), return_inverse=True)
    order = np.argsort(term, kind="stable")
    holders = names.indices.to_numpy()[order].astype(np.int32)
    begin = np.append(0, np.cumsum(np.bincount(term, minlength=len(vocabulary))))
    packed = cut(texts.mapInArrow(_postings(vocabulary), _PACKED))
    docs, total = packed.agg(F.sum("docs"), F.sum("total")).first()
    if not docs:
        return None
    counted = packed.select("terms").mapInArrow(_frequencies(len(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    weight = np.zeros(len(vocabulary), np.int64)
    weight[counted["term"].to_numpy()] = [math.floor(1000 * math.log((2 * docs + 2) / (2 * n + 1))) for n in counted["n"].to_pylist()]
    kernel = _accumulate(names.dictionary, weight, begin, holders, docs, total, top)
    return packed.select("ids", "lengths", "sizes", "terms", "counts").mapInArrow(kernel, "item_id long, doc_id long, score long")


def _first(rows: DataFrame, top: int, *keys: str) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= top)


def search(docs: DataFrame, items: DataFrame, item_id: str = "item_id", doc_id: str = "doc_id", text: str = "text", top: int = TOP, most_terms: int = TERMS, most_items: int = ITEMS) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents of each item, by score, then by doc_id.

    A block of queries has at most ``most_terms`` terms and ``most_items`` items, or one item; each block is a pass over the documents.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    queries = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).cast("string").alias("text"))
    terms = cut(queries.mapInArrow(_term_ids, "item long, term long").distinct())
    found = [rows for block in _blocks(terms, most_terms, most_items) if (rows := _search_block(texts, block, top)) is not None]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for rows in found[1:]:
        every = every.unionByName(rows)
    # Two levels, so that no task gets an item's rows of all tasks.
    some = _first(every.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), top, "item_id", "salt").drop("rank")
    return _first(some, top, "item_id").select("item_id", "rank", F.when(F.col("doc_id") < LAST, F.col("doc_id")).alias("doc_id"), "score")


def op13_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return search(docs, items)
