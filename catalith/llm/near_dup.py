"""MinHash near-duplicates with min-max hashing.

Under each permutation both the least and the greatest hash of a document's
shingles are kept, so 65 permutations give a signature of 130 values. Bands of
five values make candidates: 26 bands miss a pair at similarity 0.85 with a
probability of 2e-7, at 0.8 of 3e-5.

1. Documents with the same shingle set are one class, with an id of its own and one
   signature.
2. In each band bucket every class is tied to the bucket's smallest class, and
   components of these ties are clusters: all candidate pairs are inside one.
3. Links are confirmed on full shingle sets, in tiles of bounded size. A cluster
   whose sets fit is one tile. In a larger one, ties are confirmed first, the sets
   tied to one class in as many tiles as they need. Then come the buckets that
   still hold classes without a connection: small ones share tiles, and in one that
   exceeds a tile only the classes outside its largest group meet the others.
   So a large cluster costs what its buckets hold, and not the square of its size.
   In a tile, sets are ordered from rare shingles to common ones; two sets that
   reach the threshold share a shingle among the first few of both (prefix filter),
   and enough of them; their lists give the pairs to confirm. Pairs already
   connected are skipped, which loses no link between classes.
4. Components of the confirmed links are the duplicate groups; a group is named by
   its least doc_id.

Sets are made again from the texts of candidates, which a Bloom filter of their
doc_ids picks out; no texts are shuffled.

A null or blank text has no shingles and is linked with nothing; a text of fewer
words than a shingle is one shingle. Rows sharing a doc_id are documents of their
own, each linked by its own text. A null doc_id is linked with nothing and kept.
Very long texts are hashed in slices. Other columns are passed over; no rows give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.bloom import bloom, held
from catalith.llm.common import cut
from catalith.llm.graph import components, join_keys
from catalith.llm.grams import LOWER, chunks, mix, shingles, stream, tokens, utf8

SHINGLE = 5
PERMUTATIONS, ROWS = 65, 5
BANDS = 2 * PERMUTATIONS // ROWS
#: Shingles in a block of a tile: a tile holds two blocks at most.
TILE = 1_500_000

_U = np.uint64
_XOR = (stream(PERMUTATIONS, 11) >> _U(32)).astype(np.uint32)
_FACTOR = (stream(PERMUTATIONS, 12) >> _U(32)).astype(np.uint32) | np.uint32(1)
_BAND = stream(BANDS, 13)
_SLICE = 1 << 14


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle identifiers of each text."""
    data, at = utf8(column)
    for i, j in chunks(at):
        ids, _, _, first = tokens(data, at[i : j + 1], LOWER)
        every = shingles(ids, SHINGLE)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= SHINGLE:
                s = np.sort(every[a : b - SHINGLE + 1])
                yield s[np.append(True, s[1:] != s[:-1])]
            elif b > a:
                yield shingles(ids[a:b], b - a)
            else:
                yield np.zeros(0, _U)


def signature(s: np.ndarray) -> np.ndarray:
    """Least and greatest value under each permutation."""
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    x = (s >> _U(32)).astype(np.uint32)
    for k in range(0, len(x), _SLICE):
        v = x[None, k : k + _SLICE] ^ _XOR[:, None]
        v *= _FACTOR[:, None]
        np.minimum(low, v.min(1), out=low)
        np.maximum(high, v.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of signatures."""
    values = signatures.astype(_U).reshape(len(signatures), BANDS, ROWS)
    key = np.repeat(_BAND[None, :], len(signatures), 0)
    for r in range(ROWS):
        key = mix(key ^ values[:, :, r])
    return key.view(np.int64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, digests, signatures = [], [], []
        for s in shingle_sets(batch.column(1)):
            n.append(len(s))
            digests.append(_digest(s))
            signatures.append(signature(s))
        keys = band_keys(np.array(signatures, np.uint32).reshape(len(n), 2 * PERMUTATIONS))
        bands = pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel()), BANDS).cast(pa.list_(pa.int64()))
        a, b = zip(*digests, strict=True) if digests else ((), ())
        columns = [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), bands]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])


def _reshingle(bitmap, bits: int):
    """Sets of the documents whose id the filter has, as bytes with their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.frombuffer(bitmap.value, np.uint8)
        for batch in batches:
            ids = batch.column(0)
            known = np.flatnonzero(ids.is_valid().to_numpy(zero_copy_only=False))
            some = known[held(has, ids.take(pa.array(known)).to_numpy(zero_copy_only=False).astype(np.int64), bits)]
            for i in range(0, len(some), 2000):
                sets = list(shingle_sets(batch.column(1).take(pa.array(some[i : i + 2000]))))
                a, b = zip(*map(_digest, sets), strict=True)
                columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["set_a", "set_b", "shingles"])

    return run


def link(ids: list[int], sets: list[np.ndarray], percent: int, groups: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (larger id, smaller id) that connect all sets with similarity of ``percent`` or more.

    Sets of the same number in ``groups`` are connected already.
    """
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sets, sizes, ids = [sets[i] for i in order], sizes[order], [ids[i] for i in order]
    group = np.unique(np.array(groups)[order], return_inverse=True)[1] if groups else np.arange(len(sets))
    begin = np.append(0, np.cumsum(sizes))
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(counts), np.int64)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    ranked = rank[inverse]
    del inverse, rank, counts
    rows, doc = [], []
    for d in range(len(sets)):
        mine = ranked[begin[d] : begin[d + 1]]
        mine.sort()
        first = len(mine) - (percent * len(mine) + 99) // 100 + 1
        rows.append(mine[:first])
        doc.append(np.full(len(rows[-1]), d))
    parts = np.array([len(r) for r in rows])
    token, doc = np.concatenate(rows), np.concatenate(doc)
    by = np.lexsort((doc, token))
    token, doc = token[by], doc[by]
    new = np.append(True, token[1:] != token[:-1])
    start = np.flatnonzero(new)[np.cumsum(new) - 1]
    back = np.argsort(doc, kind="stable")  # of each set, its places in the lists
    edge = np.searchsorted(doc[back], np.arange(len(sets) + 1))
    members: dict[int, list[int]] = {}
    for d, g in enumerate(group.tolist()):
        members.setdefault(g, []).append(d)
    mark = np.zeros(len(begin) and int(ranked.max()) + 1, bool)
    out = []
    for d in range(len(sets)):
        places = back[edge[d] : edge[d + 1]]
        lists = [doc[a:b] for a, b in zip(start[places].tolist(), places.tolist(), strict=True) if b > a]
        if not lists:
            continue
        near = np.concatenate(lists)
        if 4 * len(near) < d:
            near, shared = np.unique(near, return_counts=True)
        else:
            shared = np.bincount(near, minlength=d)
            near = np.flatnonzero(shared)
            shared = shared[near]
        # What both share is in the parts above, or behind the end of the shorter-ranked part.
        least = -(-percent * (sizes[near] + sizes[d]) // (100 + percent)) - np.maximum(sizes[near] - parts[near], sizes[d] - parts[d])
        near = near[(shared >= least) & (group[near] != group[d]) & (100 * sizes[near] >= percent * sizes[d])]
        if not len(near):
            continue
        own = ranked[begin[d] : begin[d + 1]]
        mark[own] = True
        step = 1  # most sets of a group link at once; many that don't are compared together
        while len(near):
            some, near = near[-step:], near[:-step]
            step = min(4096, 8 * step)
            count = sizes[some]
            at = np.arange(count.sum()) + np.repeat(begin[some] - (np.cumsum(count) - count), count)
            both = np.add.reduceat(mark[ranked[at]].astype(np.int64), np.cumsum(count) - count)
            for e in some[100 * both >= percent * (sizes[d] + count - both)].tolist():
                a, b = int(group[d]), int(group[e])
                if a == b:
                    continue
                out.append((max(ids[d], ids[e]), min(ids[d], ids[e])))
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                group[members[b]] = a
                members[a] += members.pop(b)
                near = near[group[near] != group[d]]
        mark[own] = False
    return out


def _confirm(percent: int):
    def run(table: pa.Table) -> pa.Table:
        seen = {}
        for i, g, s in zip(table["id"].to_pylist(), table["group"].to_pylist(), table["shingles"], strict=True):
            seen.setdefault(i, (g, np.frombuffer(s.as_buffer(), _U)))
        groups, sets = zip(*seen.values(), strict=True)
        found = link(list(seen), list(sets), percent, list(groups)) if len(set(groups)) > 1 else []
        u, v = zip(*found, strict=True) if found else ((), ())
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def _links(tiles: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links found in tiles (tile, part, other, id, group) of the sets (id, shingles)."""
    return tiles.distinct().join(sets.hint("shuffle_hash"), "id").groupBy("tile", "part", "other").applyInArrow(_confirm(percent), "u long, v long")


def _packed(key: str, most: Column | int) -> list[Column]:
    """A tile number for small groups, several to a tile."""
    zero = F.lit(0).cast("long")
    return [F.concat(F.lit("p"), F.pmod(F.xxhash64(key), F.lit(most))).alias("tile"), zero.alias("part"), zero.alias("other")]


def _large_clusters(members: DataFrame, keys: DataFrame, ties: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links in clusters that exceed a tile; members (id, n), their keys (id, key), ties (u, v) and sets."""
    packs = max(1, -(-(members.agg(F.sum("n")).first()[0] or 0) // TILE))
    # Ties: the sets tied to one class, in tiles with that class.
    sized = ties.join(members.withColumnRenamed("id", "u"), "u")
    hubs = sized.groupBy("v").agg(F.ceil(F.sum("n") / F.lit(TILE)).alias("tiles"))
    tied = join_keys(sized.drop("n"), hubs, "v")
    part = F.pmod(F.xxhash64("u"), F.col("tiles"))
    big, zero = F.col("tiles") > 1, F.lit(0).cast("long")
    small = tied.where(~big)
    one = small.select(*_packed("v", packs), F.col("u").alias("id")).unionByName(small.select(*_packed("v", packs), F.col("v").alias("id")))
    name = F.concat(F.lit("t"), F.col("v")).alias("tile")
    many = tied.where(big).select(name, part.alias("part"), zero.alias("other"), F.col("u").alias("id"))
    hub = hubs.where(big).select(name, F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("part"), zero.alias("other"), F.col("v").alias("id"))
    first = cut(_links(one.unionByName(many).unionByName(hub).withColumn("group", F.col("id")), sets, percent))

    # Buckets whose classes aren't connected yet.
    groups = components(first)
    placed = members.join(groups, members["id"] == groups["node"], "left").select("id", "n", F.coalesce("component", "id").alias("group"))
    inside = cut(keys.join(placed, "id"))
    parts = inside.groupBy("key", "group").agg(F.sum("n").alias("n"), F.count("*").alias("size"), F.min("id").alias("v"))
    buckets = parts.groupBy("key").agg(
        F.sum("n").alias("held"), F.sum("size").alias("n"), F.max_by("group", F.struct("n", "group")).alias("main"), F.max("n").alias("most"), F.count("*").alias("groups"), F.min("v").alias("v")
    )
    open_ = buckets.where("groups > 1 and n > 2")  # two classes were a tie
    near = open_.groupBy("v").agg(F.sum("held").alias("near"))  # the buckets of one least class, one a band at most, have much in common
    open_ = open_.join(near, "v").withColumn("with", F.when(F.col("near") <= 4 * TILE, F.col("v")).otherwise(F.col("key")))
    tiles = F.ceil(F.col("held") / F.lit(TILE))
    open_ = open_.select("key", "main", "with", tiles.alias("tiles"), F.greatest(F.lit(1).cast("long"), F.ceil((F.col("held") - F.col("most")) / F.lit(TILE))).alias("rest"))
    left = cut(join_keys(inside.drop("n"), open_, "key"))
    mass = left.where(~big).select("with", "id").distinct().join(members, "id").agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-mass // TILE))
    some = left.where(~big).select(*_packed("with", packs), "id", "group")
    name = F.concat(F.lit("b"), F.col("key")).alias("tile")
    large = left.where(big)
    mine, outside = F.pmod(F.xxhash64("id"), F.col("tiles")), F.pmod(F.xxhash64("id"), F.col("rest"))
    every = large.select(name, mine.alias("part"), F.explode(F.sequence(zero, F.col("rest") - 1)).alias("other"), "id", "group")
    others = large.where("group <> main").select(name, F.explode(F.sequence(zero, F.col("tiles") - 1)).alias("part"), outside.alias("other"), "id", "group")
    second = _links(some.unionByName(every).unionByName(others), sets, percent)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept, group_id, text_hash) for documents (doc_id, text).

    ``group_id`` is a number of the group, null without shingles or doc_id; it tells groups
    with equal least doc_ids apart. ``text_hash`` is ``xxhash64`` of the text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    named = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = cut(named.mapInArrow(_sign, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>"))
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b")
    classes = classes.agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    keys = classes.select("id", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("id").alias("v"), F.max("id").alias("most")).where("v < most").drop("most")
    ties = cut(join_keys(keys, buckets, "key").where("id > v").select(F.col("id").alias("u"), "v").distinct())
    clusters = components(ties)
    wanted = classes.select("id", "first", "n", "set_a", "set_b").join(clusters, classes["id"] == clusters["node"]).drop("node")
    wanted = cut(join_keys(wanted, wanted.groupBy("component").agg(F.sum("n").alias("held")), "component"))
    bitmap, bits = bloom(wanted.select("first"), wanted.count())
    shared = spark.sparkContext.broadcast(bitmap)
    sets = rows.mapInArrow(_reshingle(shared, bits), "set_a long, set_b long, shingles binary")
    sets = sets.join(wanted.hint("shuffle_hash"), ["set_a", "set_b"])
    zero = F.lit(0).cast("long")
    small = sets.where(F.col("held") <= TILE).withColumns({"group": F.col("id"), "part": zero, "other": zero})
    links = small.select("id", "group", "shingles", "component", "part", "other").groupBy("component").applyInArrow(_confirm(percent), "u long, v long")
    large = wanted.where(F.col("held") > TILE)
    if not large.isEmpty():
        held_ = cut(sets.where(F.col("held") > TILE).dropDuplicates(["id"]).select("id", "shingles"))
        members = large.select("id", "n")
        inside = members.select("id")
        links = links.unionByName(
            _large_clusters(members, keys.join(inside, "id", "left_semi"), ties.join(inside.withColumnRenamed("id", "u"), "u", "left_semi"), held_, percent)
        )
    groups = components(links)
    placed = classes.select("id", "first", "set_a", "set_b").join(groups, classes["id"] == groups["node"], "left")
    placed = cut(placed.select("first", "set_a", "set_b", F.coalesce("component", "id").alias("group")))
    least = placed.groupBy("group").agg(F.min("first").alias("_class"))
    named = join_keys(placed, least, "group").select("set_a", "set_b", "_class", "group")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_a", "set_b").join(named.hint("shuffle_hash"), ["set_a", "set_b"], "left")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.coalesce(F.when(linked, F.col("_class")), "doc_id").alias("component_id")
    out = out.select("doc_id", "n_shingles", component, F.when(linked, F.col("group")).alias("group_id"), "text_hash")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return out.select("doc_id", "n_shingles", "component_id", kept, "group_id", "text_hash")


def op1_minhash(docs: DataFrame) -> DataFrame:
    """All documents with the threshold of 85 percent."""
    return near_duplicates(docs, 85).select("doc_id", "n_shingles", "component_id", "kept")
