"""Term divergence between the sources of a language, tile by tile.

Each language keeps the terms that enough of its documents have. A source's
distribution over them is smoothed and held in whole numbers of 1e-9. Two sources
differ by the sum over all kept terms of the absolute differences.

1. A kernel counts terms in each batch of rows; Spark adds the counts up by
   (language, source, term). A source with a third of all rows sends no more than
   its different terms from each batch.
2. Sources are dealt into blocks and terms into chunks, both by hash, and numbered in
   theirs. A block's counts in a chunk are one packed row.
3. Tiles. Each packed row goes to all tiles of its block: block a meets block b in
   tile (a, b). A task takes a tile's rows sorted by chunk and adds up the pair
   submatrix over one chunk after the other, so it holds two blocks' counts in one
   chunk and a matrix of BLOCK x BLOCK, whatever the vocabulary and corpus.

All arithmetic is on 64-bit whole numbers; rounding down is exact (``share``).

Null text, language and source are empty strings; a document without terms still
brings its source in, whose distribution is then flat. Repeated rows and doc_ids
count each for itself. Texts are read whole. No rows give no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import cut
from catalith.llm.grams import LOWER, chunks, tokens, utf8

#: Documents of a language that must hold a kept term, terms listed for a source, and what is added to each count.
LEAST_DOCS, LISTED, SMOOTH = 30, 50, 5
#: Whole numbers that stand for a share of 1.
UNIT = 1_000_000_000
#: Sources in a block and terms in a chunk, on average.
BLOCK, CHUNK = 16, 4096

#: Bytes between terms: all of ASCII but letters.
BETWEEN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])

_COUNTS = "lang string, source string, term string, docs long, n long"


# --- counts --------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by (lang, source, term) of each run of rows; a null term for each group that occurs."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    for batch in batches:
        groups = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        table = pa.table({"lang": batch.column(0), "source": batch.column(1), "row": pa.array(range(batch.num_rows), pa.int64())})
        firsts = table.group_by(["lang", "source"], use_threads=False).aggregate([("row", "min")])
        names = groups.take(firsts["row_min"].combine_chunks())
        place = {(g["lang"], g["source"]): k for k, g in enumerate(names.to_pylist())}
        group = np.array([place[g] for g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
        yield _rows(names, np.arange(len(place)), pa.nulls(len(place), pa.string()), np.ones(len(place), np.int64), np.zeros(len(place), np.int64))
        data, at = utf8(batch.column(2))
        for i, j in chunks(at, 4 << 20):
            ids, begin, end, first = tokens(data, at[i : j + 1], LOWER, BETWEEN)
            if not len(ids):
                continue
            doc = np.repeat(np.arange(i, j), np.diff(first))
            order = np.lexsort((doc, ids, group[doc]))
            g, t, d = group[doc][order], ids[order], doc[order]
            new = np.append(True, (g[1:] != g[:-1]) | (t[1:] != t[:-1]))
            other = new | np.append(True, d[1:] != d[:-1])
            heads = np.flatnonzero(new)
            docs, n = np.add.reduceat(other.astype(np.int64), heads), np.diff(np.append(heads, len(order)))
            text = lower[data[at[i] : at[j]]]
            token = order[heads]
            lengths = end[token] - begin[token]
            offset = np.append(0, np.cumsum(lengths))
            where = np.arange(offset[-1]) + np.repeat(begin[token] - offset[:-1], lengths)
            terms = pa.Array.from_buffers(pa.large_string(), len(token), [None, pa.py_buffer(offset), pa.py_buffer(text[where])])
            yield _rows(names, g[heads], terms.cast(pa.string()), docs, n)


def _rows(names: pa.StructArray, group: np.ndarray, terms: pa.Array, docs: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    lang, source = names.take(pa.array(group)).flatten()
    return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(docs, pa.int64()), pa.array(n, pa.int64())], ["lang", "source", "term", "docs", "n"])


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, docs, n): documents with the term and occurrences; a row with a null term for each group."""
    held = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return held.mapInArrow(_count, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))


# --- shares --------------------------------------------------------------------


def share(n: Column, total: Column) -> Column:
    """1 + floor(UNIT * n / total) for 0 <= n <= total, digit by digit, so that nothing overflows below 9e15."""
    out, rest = F.call_function("div", n, total), n % total
    for _ in range(3):
        out, rest = out * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return out + 1


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    out, rest = np.divmod(n, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + more
    return out + 1


class Audit:
    """The counts of a corpus, from which pairs and terms are listed."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, block: int = BLOCK, chunk: int = CHUNK):
        self.smooth, self.block, self.chunk = smooth, block, chunk
        counts = cut(count_terms(docs))
        whole = Window.partitionBy("lang", "term")
        terms = counts.where("term is not null").withColumn("lang_docs", F.sum("docs").over(whole)).where(F.col("lang_docs") >= least_docs)
        terms = terms.withColumn("lang_n", F.sum("n").over(whole)).select("lang", "source", "term", "n", "lang_n")
        self.terms = cut(terms)
        #: Of each language the kept terms and their occurrences; of each group its occurrences.
        vocabulary = self.terms.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
        totals = self.terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term is null").select("lang", "source").join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left")
        zero = F.lit(0).cast("long")
        groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("kept", "lang_total", "total")])
        # The block of a group, the number of blocks of its language and its place in the block.
        blocks = F.ceil(F.count("*").over(Window.partitionBy("lang")) / self.block).cast("int")
        groups = groups.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
        self.groups = cut(groups.withColumn("at", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1))

    def listed_terms(self, listed: int = LISTED) -> DataFrame:
        """(lang, source, item, value, rank): terms that a source has more of than its language, the first ``listed``."""
        rows = self.terms.join(self.groups, ["lang", "source"])
        smooth = F.lit(self.smooth).cast("long")
        p = share(F.col("n") + smooth, F.col("total") + smooth * F.col("kept"))
        q = share(F.col("lang_n") + smooth, F.col("lang_total") + smooth * F.col("kept"))
        rows = rows.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
        return _ranked(rows).where(F.col("rank") <= listed)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value, rank): every other source of the language."""
        sums = _tiles(self._blocks(), self._chunks()).mapInArrow(_pair_sums(self.smooth), "lang string, source string, item string, value long")
        return _ranked(sums)

    def _blocks(self) -> DataFrame:
        """A block's sources in the order of their places, with their totals: one row, which comes before the block's counts."""
        rows = self.groups.groupBy("lang", "block", "blocks", "kept").agg(F.sort_array(F.collect_list(F.struct("at", "source", "total"))).alias("sources"))
        none = F.array().cast("array<int>")
        return rows.select("lang", "block", "blocks", F.lit(-1).alias("chunk"), F.col("kept").alias("width"), none.alias("source_at"), none.alias("term_at"),
                           F.array().cast("array<long>").alias("counts"), F.col("sources.source").alias("sources"), F.col("sources.total").alias("totals"))

    def _chunks(self) -> DataFrame:
        """A block's counts in a chunk of the vocabulary: one row."""
        rows = self.terms.join(self.groups.select("lang", "source", "kept", "block", "blocks", "at"), ["lang", "source"])
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("kept") / self.chunk)).cast("int"))
        whole = Window.partitionBy("lang", "chunk")
        rows = rows.withColumn("term_at", F.dense_rank().over(whole.orderBy("term")) - 1).withColumn("width", F.max("term_at").over(whole) + 1)
        packed = rows.groupBy("lang", "block", "blocks", "chunk", "width").agg(F.collect_list(F.struct("at", "term_at", "n")).alias("c"))
        return packed.select("lang", "block", "blocks", "chunk", F.col("width").cast("long").alias("width"), F.col("c.at").alias("source_at"), F.col("c.term_at").alias("term_at"),
                             F.col("c.n").alias("counts"), F.array().cast("array<string>").alias("sources"), F.array().cast("array<long>").alias("totals"))


def _ranked(rows: DataFrame) -> DataFrame:
    line = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(line))


def _tiles(blocks: DataFrame, counts: DataFrame) -> DataFrame:
    """Each block's rows at every tile of its row and column, tiles in one piece, by chunk, the smaller block first."""
    every = blocks.unionByName(counts).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiles = every.withColumn("a", F.least("block", "other")).withColumn("b", F.greatest("block", "other")).drop("other", "blocks")
    return tiles.repartition("lang", "a", "b").sortWithinPartitions("lang", "a", "b", "chunk", "block")


class _Tile:
    """The pair submatrix of two blocks."""

    def __init__(self, key: tuple, smooth: int) -> None:
        self.key, self.smooth, self.kept, self.seen = key, smooth, 0, 0
        self.names: dict[int, list[str]] = {}
        self.totals: dict[int, np.ndarray] = {}
        self.chunk, self.held, self.width = -1, {}, 0

    def head(self, block: int, names: list[str], totals: np.ndarray, kept: int) -> None:
        self.names[block], self.kept = names, kept
        self.totals[block] = totals + self.smooth * kept
        self.sums = np.zeros([len(self.names.get(k, [])) for k in self.key[1:]], np.int64)

    def add(self, chunk: int, block: int, width: int, source: np.ndarray, term: np.ndarray, counts: np.ndarray) -> None:
        if chunk != self.chunk:
            self.close()
        self.chunk, self.width = chunk, width
        self.held[block] = source, term, counts

    def close(self) -> None:
        """Add the chunk's share to the matrix."""
        if self.held and self.sums.size:  # a block may have got no sources
            a, b = (self._dense(k) for k in self.key[1:])
            for i in range(len(a)):
                self.sums[i] += np.abs(b - a[i]).sum(axis=1)
            self.seen += self.width
            self.held = {}

    def _dense(self, block: int) -> np.ndarray:
        source, term, counts = self.held.get(block, (np.zeros(0, np.int64),) * 3)
        dense = np.full((len(self.names[block]), self.width), self.smooth, np.int64)
        dense[source, term] += counts
        return _shares(dense, self.totals[block][:, None])

    def rows(self) -> pa.RecordBatch:
        self.close()
        lang, a, b = self.key
        x, y = self.names.get(a, []), self.names.get(b, [])
        if self.kept > self.seen and self.sums.size:  # chunks that neither block has terms of
            flat = [_shares(np.full(len(self.names[k]), self.smooth, np.int64), self.totals[k]) for k in (a, b)]
            self.sums += (self.kept - self.seen) * np.abs(flat[0][:, None] - flat[1])
        i, j = (k.ravel() for k in np.indices(self.sums.shape))
        if a == b:
            i, j = i[i != j], j[i != j]
            one, two, value = i, j, self.sums[i, j]
            source, item = [x[k] for k in one], [x[k] for k in two]
        else:
            value = np.tile(self.sums[i, j], 2)
            source, item = [x[k] for k in i] + [y[k] for k in j], [y[k] for k in j] + [x[k] for k in i]
        columns = [pa.array([lang] * len(value), pa.string()), pa.array(source, pa.string()), pa.array(item, pa.string()), pa.array(value, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])


def _pair_sums(smooth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = None
        for batch in batches:
            col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            for k in range(batch.num_rows):
                key = (col["lang"][k].as_py(), col["a"][k].as_py(), col["b"][k].as_py())
                if tile is None or key != tile.key:
                    if tile is not None:
                        yield tile.rows()
                    tile = _Tile(key, smooth)
                block, chunk, width = col["block"][k].as_py(), col["chunk"][k].as_py(), col["width"][k].as_py()
                if chunk < 0:
                    tile.head(block, col["sources"][k].as_py(), np.array(col["totals"][k].as_py(), np.int64), width)
                else:
                    values = (np.asarray(col[c][k].values, dtype=np.int64) for c in ("source_at", "term_at", "counts"))
                    tile.add(chunk, block, width, *values)
        if tile is not None:
            yield tile.rows()

    return run


def op12_divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): all pairs of sources, and each source's terms to rank 50."""
    audit = Audit(docs)
    parts = [rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, rows in (("pair", audit.pairs()), ("term", audit.listed_terms()))]
    return parts[0].unionByName(parts[1])
