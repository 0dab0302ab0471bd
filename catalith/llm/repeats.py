"""Repeated passages: what a document shares with documents of smaller id.

A passage is a window of ``length`` symbols, bytes or words. Comparing all windows
would move many times the corpus, so only windows that may have an equal one
elsewhere are compared; how they are is the ``Method`` (``suffixes``, ``substrings``).

1. Documents are packed into segments, compressed, and segments dealt into parts,
   each of which stays in one partition. Whole copies are found by a digest of the
   text; only the first copy takes part in what follows.
2. Seeds. Among the q-grams of each window, the one with the least identifier is its
   seed, so equal windows have equal seeds wherever they stand (winnowing). Parts
   send their segments' distinct seeds to hash ranges; a range answers with one bit
   for each seed, whether another segment has it, too, and one for frequent seeds.
3. Units are the places of seeds with the windows around them. Units whose seed
   occurs elsewhere are sent to the seed's range, once for each distinct content of a
   segment, with the least document id. There the method compares them, and a bit for
   each window goes back: it also starts in a smaller document or not.
4. Seeds with ``HOT`` units or more aren't compared in one task: their windows are
   grouped by a 64-bit identifier of the whole window, with partial sums, and the
   least document id of each goes back. Results are the same.
5. Each segment covers the symbols of marked windows.

A message is one row for a part and a range. Both grow with the root of the corpus
once that exceeds ``PART``, so that rows stay proportional to the corpus, four or
more to every 4 KB. Segments stay where they are; only answers come back to them.

Rows with a null doc_id are taken as the largest id; rows of equal doc_id don't
remove from each other; null and empty texts have no symbols. A text longer than
a segment is a segment alone. Other columns are passed over; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.llm.common import cut
from catalith.llm.grams import inverses, mix, powers, utf8

#: Bytes of text in a segment, and at least in a part, for a range and for each partition.
SEGMENT, PART, RANGE, PARTITION = 2 << 20, 4 << 20, 2 << 20, 16 << 20
#: Bytes of text for each message, as the square root's factor.
MESSAGE = 4096
#: Units of one seed from which on its windows are grouped by their identifiers.
HOT = 1 << 16
#: Tasks over which the copies of one text are spread.
SALTS = 16
LAST = np.iinfo(np.int64).max

_U = np.uint64


@dataclass
class Segment:
    """Symbols and units of one segment.

    ``first``: first symbol of each document; ``run``: an identifier for each window;
    for each unit ``lo`` and ``count``: its first window and how many follow one another,
    ``seed`` and ``place``: the seed's identifier and where it stands.
    """

    ids: np.ndarray
    first: np.ndarray
    symbols: np.ndarray
    run: np.ndarray
    lo: np.ndarray
    count: np.ndarray
    seed: np.ndarray
    place: np.ndarray
    owner: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.owner = self.ids[np.searchsorted(self.first, self.lo, "right") - 1]

    def seeds(self, ranges_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct seeds, their ranges and numbers of units, by range."""
        distinct, units = np.unique(self.seed, return_counts=True)
        to = (distinct % _U(ranges_)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return distinct[order], to[order], units[order]

    def distinct(self, units: np.ndarray, ranges_: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first unit of each content by range, their ranges, of which of them each unit is a copy)."""
        # windows weigh by their place in the unit, so that units with the same windows in another order differ
        total = np.cumsum(self.run * powers(len(self.run))[: len(self.run)])
        lo, hi = self.lo[units], self.lo[units] + self.count[units] - 1
        name = (total[hi] - np.where(lo > 0, total[lo - 1], _U(0))) * inverses(len(self.run))[lo]
        name = mix(name + self.seed[units] * _U(0x9E3779B97F4A7C15) + ((self.place[units] - lo) * 256 + hi - lo).astype(_U))
        to = (self.seed[units] % _U(ranges_)).astype(np.int64)
        order = np.lexsort((units, self.owner[units], name, to))
        new = np.ones(len(order), bool)
        new[1:] = name[order][1:] != name[order][:-1]
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        heads = order[new]
        return units[heads], to[heads], of

    def cover(self, marks: np.ndarray, length: int) -> np.ndarray:
        step = np.zeros(len(self.symbols) + 1, np.int32)
        at = np.flatnonzero(marks)
        step[at] += 1
        np.add.at(step, at + length, -1)
        return np.cumsum(step[:-1]) > 0


@dataclass(frozen=True)
class Method:
    """How windows are found and compared.

    ``read(text, at, ids, copies)`` makes a Segment. ``send(segment, units)`` gives the
    bytes to compare, as one array and each unit's share of it. ``compare(seed, count,
    place, owner, load, sizes)`` tells for each window of each unit the least owner.
    """

    words: bool
    length: int
    read: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Segment]
    send: Callable[[Segment, np.ndarray], tuple[np.ndarray, np.ndarray]]
    compare: Callable[..., np.ndarray]

    def local(self, segment: Segment) -> np.ndarray:
        """Marks of windows that also start in a smaller document of this segment."""
        marks = np.zeros(len(segment.run), bool)
        order = np.argsort(segment.seed, kind="stable")
        units = order[repeated(segment.seed[order])]
        if len(units):
            units = units[np.argsort(units)]
            load, sizes = self.send(segment, units)
            place = segment.place[units] - segment.lo[units]
            least = self.compare(segment.seed[units], segment.count[units], place, segment.owner[units], load, sizes)
            starts, count = ranges(segment.lo[units], segment.lo[units] + segment.count[units])
            marks[starts[least < np.repeat(segment.owner[units], count)]] = True
        return marks


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [lo, hi), and the count of each range."""
    count = hi - lo
    if not len(lo):
        return np.zeros(0, np.int64), count
    begin = np.cumsum(count) - count
    return np.arange(count.sum()) + np.repeat(lo - begin, count), count


def starts(n: int, first: np.ndarray, length: int, copies: np.ndarray) -> np.ndarray:
    """Which of n symbols start a window within one document that isn't a copy."""
    step = np.zeros(n + 1, np.int32)
    long = (np.diff(first) >= length) & ~copies
    np.add.at(step, first[:-1][long], 1)
    np.add.at(step, first[1:][long] - length + 1, -1)
    return np.cumsum(step[:n]) > 0


def repeated(x: np.ndarray) -> np.ndarray:
    """Which values of a sorted array occur twice or more."""
    out = np.zeros(len(x), bool)
    equal = x[1:] == x[:-1]
    out[1:] |= equal
    out[:-1] |= equal
    return out


def blocks(keys: np.ndarray, sizes: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Indices of rows in blocks of ``most`` bytes or one key; equal keys stay together."""
    order = np.argsort(keys, kind="stable")
    ends = np.append(np.flatnonzero(keys[order][1:] != keys[order][:-1]) + 1, len(order))
    total = np.cumsum(sizes[order])
    i = 0
    while i < len(order):
        past = np.searchsorted(total, (total[i - 1] if i else 0) + most, "right")
        k = max(int(np.searchsorted(ends, past, "right")) - 1, int(np.searchsorted(ends, i, "right")))
        yield order[i : ends[k]]
        i = int(ends[k])


# --- segments ----------------------------------------------------------------


def _pack(docs: DataFrame, parts: int, partitions: int) -> DataFrame:
    """Segments: part, seg, ids, digests, at (offsets), the compressed text, and lead: first of its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = itertools.count((TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)
        squeeze = zstandard.ZstdCompressor(level=1)
        held: list = [[], [], [0], []]

        def out() -> pa.RecordBatch:
            ids, digests, at, texts = held
            row = [[next(serial)], [ids], [digests], [at], [squeeze.compress(b"".join(texts))]]
            held[:] = [], [], [0], []
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], ["seg", "ids", "digests", "at", "text"])

        for batch in batches:
            data, at = utf8(batch.column(1))
            view = memoryview(data)
            for k, i in enumerate(batch.column(0).to_pylist()):
                text = view[at[k] : at[k + 1]]
                held[0].append(LAST if i is None else i)
                held[1].append(hashlib.blake2b(text, digest_size=16).digest())
                held[2].append(held[2][-1] + len(text))
                held[3].append(bytes(text))
                if held[2][-1] >= SEGMENT:
                    yield out()
        if held[0]:
            yield out()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "seg long, ids array<long>, digests array<binary>, at array<long>, text binary"
    )
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("seg"), F.lit(parts))).repartition(partitions, "part")
    place = F.row_number().over(Window.partitionBy("part").orderBy("seg"))
    return dealt.withColumn("lead", place == 1)


def _checkpoint_partitioned(df: DataFrame) -> DataFrame:
    """A checkpoint that still knows how its rows are partitioned, which adaptive plans don't.

    Only planning, which takes an instant, sees the changed setting.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df._jdf.queryExecution().executedPlan()
    finally:
        conf.set("spark.sql.adaptive.enabled", before)
    return cut(df)


class Flags:
    """A part's answer bits by range, taken in the order in which its segments asked."""

    def __init__(self, rows: list[dict], name: str, ranges_: int) -> None:
        size = np.zeros(ranges_ + 1, np.int64)
        rows = sorted(rows, key=lambda r: r["to"])
        for r in rows:
            size[r["to"] + 1] = 8 * r["size"]
        self.base = np.cumsum(size)
        bits = b"".join(r[name] or bytes(r["size"]) for r in rows)
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        self.used = np.zeros(ranges_, np.int64)

    def take(self, to: np.ndarray) -> np.ndarray:
        """The bits for entries sent to the ranges ``to``, which are in order."""
        if not len(to):
            return np.zeros(0, bool)
        begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        n = np.diff(np.append(begin, len(to)))
        at = self.base[to] + self.used[to] + np.arange(len(to)) - np.repeat(begin, n)
        self.used[to[begin]] += n
        return self.bits[at]


class Part:
    """What a part's first row brings: whole copies and answers."""

    def __init__(self, row: dict, ranges_: int) -> None:
        self.copies: dict[int, list[int]] = {}
        for c in row.get("copies") or []:
            self.copies.setdefault(c["seg"], []).append(c["at"])
        self.shared = Flags(row.get("seeds") or [], "bits", ranges_)
        self.frequent = Flags(row.get("seeds") or [], "hot", ranges_)
        self.runs = Flags(row.get("runs") or [], "bits", ranges_)
        hot = row.get("hot") or []
        self.hot = np.array([h["run"] for h in hot], np.int64).view(_U)
        self.least = np.array([h["least"] for h in hot], np.int64)
        order = np.argsort(self.hot)
        self.hot, self.least = self.hot[order], self.least[order]

    def units(self, segment: Segment, ranges_: int) -> tuple[np.ndarray, np.ndarray]:
        """Units to compare in ranges, and units of frequent seeds."""
        seeds, to, _ = segment.seeds(ranges_)
        shared, hot = self.shared.take(to), self.frequent.take(to)
        return _with_seed(segment.seed, seeds[shared & ~hot]), _with_seed(segment.seed, seeds[hot])


def _with_seed(seed: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    wanted = np.sort(wanted)
    if not len(wanted):
        return np.zeros(0, np.int64)
    return np.flatnonzero(wanted[np.searchsorted(wanted, seed).clip(max=len(wanted) - 1)] == seed)


def _segments(method: Method, ranges_: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Part, Segment, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, what it brings, segment, text, offsets, copies), one at a time, parts in one piece."""
    open_ = zstandard.ZstdDecompressor()
    part = None
    for batch in batches:
        col = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
        for k in range(batch.num_rows):
            if col["lead"][k].as_py():
                part = Part({n: col[n][k].as_py() for n in ("copies", "seeds", "runs", "hot") if n in col}, ranges_)
            ids = np.array(col["ids"][k].values, dtype=np.int64)
            at = np.array(col["at"][k].values, dtype=np.int64)
            text = np.frombuffer(open_.decompress(col["text"][k].as_py(), max_output_size=max(1, int(at[-1]))), dtype=np.uint8)
            copies = np.zeros(len(ids), bool)
            copies[part.copies.get(col["seg"][k].as_py(), [])] = True
            yield col["part"][k].as_py(), part, method.read(text, at, ids, copies), text, at, copies


def _by_part(walk, add, flush):
    """Rows of ``flush(part, collected)`` for the segments of each part."""
    held, now = [], None
    for part, *rest in walk:
        if part != now and held:
            yield flush(now, held)
            held = []
        now = part
        held.append(add(*rest))
    if held:
        yield flush(now, held)


_MESSAGE = "to int, part long, load binary"
_ANSWER = "to int, part long, bits binary, hot binary"


def _messages(part: int, to: np.ndarray, load) -> pa.RecordBatch:
    """One row for each range in ``to``; ``load(i, j)`` packs entries i to j, which are in order of ranges."""
    edge = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to)) if len(to) else np.zeros(1, np.int64)
    rows = [load(i, j) for i, j in itertools.pairwise(edge.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(to[edge[:-1]], pa.int32()), pa.array([part] * len(rows), pa.int64()), pa.array(rows, pa.binary())], ["to", "part", "load"]
    )


def _send_seeds(method: Method, ranges_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def add(_, segment, *rest):
            seeds, to, units = segment.seeds(ranges_)
            rows = np.empty((len(seeds), 6), np.uint8)
            rows[:, :5] = seeds.view(np.uint8).reshape(-1, 8)[:, 3:]  # the range stands for the low bits
            rows[:, 5] = np.ceil(np.log2(units)) if len(units) else units
            return to, rows

        def flush(part, held):
            to, rows = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(to, kind="stable")
            rows = rows[order]
            return _messages(part, to[order], lambda i, j: rows[i:j].tobytes())

        yield from _by_part(_segments(method, ranges_, batches), add, flush)

    return run


def _bits(flags: np.ndarray, counts: np.ndarray) -> list[bytes]:
    ends = np.cumsum(counts)
    return [np.packbits(flags[e - c : e]).tobytes() for c, e in zip(counts.tolist(), ends.tolist(), strict=True)]


def _answer_seeds(hot: int):
    def run(table: pa.Table) -> pa.Table:
        loads = table["load"].to_pylist()
        counts = np.array([len(x) // 6 for x in loads])
        raw = np.frombuffer(b"".join(loads), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :5] = raw[:, :5]
        values, units = wide.view(_U).ravel(), np.exp2(raw[:, 5].astype(np.float64))
        order = np.argsort(values)
        begin = np.flatnonzero(np.append(True, values[order][1:] != values[order][:-1]))
        size = np.diff(np.append(begin, len(order)))
        shared, many = np.empty(len(order), bool), np.empty(len(order), bool)
        shared[order] = np.repeat(size > 1, size)
        many[order] = np.repeat((size > 1) & (np.add.reduceat(units[order], begin) >= hot), size)
        frequent = [b if any(b) else None for b in _bits(many, counts)]
        return pa.table({"to": table["to"], "part": table["part"], "bits": pa.array(_bits(shared, counts), pa.binary()), "hot": pa.array(frequent, pa.binary())})

    return run


def _send_units(method: Method, ranges_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)

        def add(part, segment, *rest):
            heads, to, _ = segment.distinct(part.units(segment, ranges_)[0], ranges_)
            load, sizes = method.send(segment, heads)
            place = segment.place[heads] - segment.lo[heads]
            return to, segment.seed[heads], segment.count[heads].astype(np.uint8), place.astype(np.uint8), segment.owner[heads], sizes.astype(np.uint32), load

        def flush(part, held):
            *columns, load = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(columns[0], kind="stable")
            to, seed, count, place, owner, sizes = (c[order] for c in columns)
            begin = (np.cumsum(columns[-1], dtype=np.int64) - columns[-1])[order]

            def pack(i, j):
                body = load[ranges(begin[i:j], begin[i:j] + sizes[i:j])[0]]
                return squeeze.compress(b"".join([(j - i).to_bytes(4, "little"), *(c[i:j].tobytes() for c in (seed, count, place, owner, sizes)), body.tobytes()]))

            return _messages(part, to, pack)

        yield from _by_part(_segments(method, ranges_, batches), add, flush)

    return run


_KINDS = (np.dtype(_U), np.dtype(np.uint8), np.dtype(np.uint8), np.dtype(np.int64), np.dtype(np.uint32))


def _answer_units(method: Method):
    def run(table: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor()
        held: list[list] = [[] for _ in range(6)]
        for load in table["load"]:
            raw = open_.decompress(load.as_py())
            n, at = int.from_bytes(raw[:4], "little"), 4
            for k, kind in enumerate(_KINDS):
                held[k].append(np.frombuffer(raw, kind, n, at))
                at += n * kind.itemsize
            held[5].append(np.frombuffer(raw, np.uint8, offset=at))
        counts = np.array([int(c.sum(dtype=np.int64)) for c in held[1]])
        seed, count, place, owner, sizes, load = (np.concatenate(h) for h in held)
        count, place, sizes = count.astype(np.int64), place.astype(np.int64), sizes.astype(np.int64)
        least = method.compare(seed, count, place, owner, load, sizes)
        bits = _bits(least < np.repeat(owner, count), counts)
        return pa.table({"to": table["to"], "part": table["part"], "bits": pa.array(bits, pa.binary()), "hot": pa.array([None] * len(bits), pa.binary())})

    return run


def _send_hot(method: Method, ranges_: int):
    """Rows (run, owner, last, part): windows of frequent seeds, with their least and greatest document in the segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, brings, segment, *_ in _segments(method, ranges_, batches):
            units = brings.units(segment, ranges_)[1]
            starts, count = ranges(segment.lo[units], segment.lo[units] + segment.count[units])
            run_, owner = segment.run[starts], np.repeat(segment.owner[units], count)
            order = np.lexsort((owner, run_))
            new = np.append(True, run_[order][1:] != run_[order][:-1])[: len(order)]
            first, last = order[new], order[np.append(new[1:], True)[: len(order)]]
            columns = [run_[first].view(np.int64), owner[first], owner[last], np.full(len(first), part, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["run", "owner", "last", "part"])

    return run


def _finish(method: Method, ranges_: int):
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, segment, text, at, copies in _segments(method, ranges_, batches):
            marks = method.local(segment)
            units, hot = part.units(segment, ranges_)
            if len(units):
                heads, to, of = segment.distinct(units, ranges_)
                n = segment.count[heads]
                found = part.runs.take(np.repeat(to, n))
                base = np.cumsum(n) - n
                every, n = ranges(segment.lo[units], segment.lo[units] + segment.count[units])
                marks[every[found[ranges(base[of], base[of] + n)[0]]]] = True
            if len(hot) and len(part.hot):
                every, n = ranges(segment.lo[hot], segment.lo[hot] + segment.count[hot])
                k = np.searchsorted(part.hot, segment.run[every]).clip(max=len(part.hot) - 1)
                marks[every[(part.hot[k] == segment.run[every]) & (part.least[k] < np.repeat(segment.owner[hot], n))]] = True
            gone = segment.cover(marks, method.length)
            for d in np.flatnonzero(copies).tolist():
                if segment.first[d + 1] - segment.first[d] >= method.length:
                    gone[segment.first[d] : segment.first[d + 1]] = True
            out: list[list] = [[], [], [], []]
            raw = memoryview(text)
            for d, i in enumerate(segment.ids.tolist()):
                a, b = int(segment.first[d]), int(segment.first[d + 1])
                gap, whole = gone[a:b], raw[at[d] : at[d + 1]]
                turn = np.flatnonzero(np.diff(gap, prepend=False, append=False)).tolist() if gap.any() else []
                out[0].append(None if i == LAST else i)
                out[1].append(b - a)
                out[2].append([{"start": x, "end": y} for x, y in zip(turn[::2], turn[1::2], strict=True)])
                if method.words:
                    kept = bytes(whole).split()
                    out[3].append(b" ".join(itertools.compress(kept, (~gap).tolist()) if turn else kept))
                else:
                    out[3].append(text[at[d] : at[d + 1]][~gap].tobytes() if turn else bytes(whole))
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["doc_id", "n_symbols", "removed", "kept"])

    return run


def sizes_of(total: int) -> tuple[int, int]:
    """Numbers of parts and ranges for so many bytes of text."""
    root = math.isqrt(MESSAGE * total)
    return max(16, -(-total // max(PART, root))), max(16, -(-total // max(RANGE, root // 4)))


def remove_repeats(docs: DataFrame, method: Method) -> DataFrame:
    """Rows (doc_id, n_symbols, removed, kept).

    ``removed`` lists maximal runs (start, end) of symbols that passages starting
    in documents of smaller id cover; ``kept`` has the other symbols: bytes
    joined as they are, words by one space.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, ranges_ = sizes_of(total)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    segments = _checkpoint_partitioned(_pack(docs, parts, tasks))

    heads = segments.select("part", "seg", F.posexplode(F.arrays_zip("ids", "digests")).alias("at", "d")).select(
        "part", "seg", "at", F.col("d.ids").alias("id"), F.col("d.digests").alias("digest")
    )
    first = heads.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = heads.withColumn("salt", F.pmod("seg", F.lit(SALTS)).cast("int"))
    copies = cut(
        salted.join(first, ["digest", "salt"]).where("id > first").groupBy("part").agg(F.collect_list(F.struct("seg", "at")).alias("copies"))
    )

    def attach(held: DataFrame, brought: DataFrame) -> DataFrame:
        other = brought.withColumnRenamed("part", "_part").hint("shuffle_hash")
        return held.join(other, (F.col("part") == F.col("_part")) & F.col("lead"), "left").drop("_part")

    def answers(send, answer, name: str) -> DataFrame:
        rows = held.mapInArrow(send, _MESSAGE).repartition(tasks, "to").groupBy("to").applyInArrow(answer, _ANSWER)
        rows = rows.select("part", F.struct("to", F.octet_length("bits").alias("size"), "bits", "hot").alias("a"))
        return cut(rows.groupBy("part").agg(F.collect_list("a").alias(name)))

    held = attach(segments.select("part", "seg", "lead", "ids", "at", "text"), copies)
    seeds = answers(_send_seeds(method, ranges_), _answer_seeds(HOT), "seeds")
    held = attach(held, seeds)
    if not seeds.where(F.exists("seeds", lambda a: a["hot"].isNotNull())).isEmpty():
        rows = held.mapInArrow(_send_hot(method, ranges_), "run long, owner long, last long, part long")
        rows = cut(rows.groupBy("run", "part").agg(F.min("owner").alias("owner"), F.max("last").alias("last")))
        least = rows.groupBy("run").agg(F.min("owner").alias("least"), F.max("last").alias("most")).where("least < most")
        found = rows.join(least, "run").groupBy("part").agg(F.collect_list(F.struct("run", "least")).alias("hot"))
        held = attach(held, cut(found))
    held = attach(held, answers(_send_units(method, ranges_), _answer_units(method), "runs"))
    return held.mapInArrow(_finish(method, ranges_), "doc_id long, n_symbols long, removed array<struct<start:long,end:long>>, kept binary")


def n_removed():
    return F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"]).alias("n_removed")
