"""Neighbour graphs and embeddings of feature vectors.

``nearest`` finds each row's nearest rows without comparing all with all:

1. Equal vectors are one point; their rows share its neighbours.
2. A forest. Each tree splits space by random directions at medians of a bounded sample,
   so its leaves hold about ``LEAF`` points however many there are. Within a leaf points
   are compared in blocks, and each keeps its nearest.
3. Neighbours of neighbours. The nearest points of one point are compared with one
   another, which finds neighbours that no tree put together.

``embed`` gives two coordinates in which neighbours stay neighbours:

1. Of each point the bandwidth at which its neighbours have the wanted perplexity, by
   bisection.
2. ``LANDMARKS`` points, the least by a hash, are laid out on the driver by gradient
   descent on the divergence between their similarities and those of the plane. Nothing else
   comes to the driver, so its work doesn't grow with the table.
3. Every other point starts at the one of its nearest landmarks that lies best for all of
   them; then, for a few rounds, points move towards their neighbours in the graph. Both
   weigh a neighbour by its similarity and less the farther off it lies in the plane, so
   a point joins one group of its neighbours rather than the middle between groups.

Rows without features, or with features of another length than the first in the table,
have no coordinates and no neighbours. Everything is seeded, so two runs agree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catalith.session import fixed

#: Points in a leaf on average, trees, rounds of comparing neighbours of neighbours at most, and the share of
#: links that a round must change for another one to follow.
LEAF, TREES, ROUNDS, CHANGED = 1000, 12, 8, 0.02
#: Points that the splits are learned from and that are laid out, at most.
SAMPLE, LANDMARKS = 20_000, 1_000
PERPLEXITY, STEPS, MOVES = 5.0, 400, 3
#: Nearest points that are held while searching, for each one wanted.
SPARE = 2
#: Points compared at a time within a leaf.
BLOCK = 1024


def points_of(rows: DataFrame, features: str = "features") -> DataFrame:
    """(point, vector): the different vectors, with a number that depends on the vector alone."""
    vectors = rows.select(F.col(features).cast("array<float>").alias("vector")).where("vector is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x))")
    width = vectors.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if width is None:
        return vectors.select(F.xxhash64("vector").alias("point"), "vector")
    return vectors.where(F.size("vector") == width["n"]).groupBy(F.xxhash64("vector").alias("point")).agg(F.min("vector").alias("vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 0))


class Tree:
    """Random directions and medians of a sample, level by level."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int) -> None:
        draw = np.random.default_rng(seed)
        self.depth = max(0, math.ceil(math.log2(max(1, leaves))))
        self.directions = draw.normal(size=(self.depth, sample.shape[1]))
        self.cuts: list[np.ndarray] = []
        node = np.zeros(len(sample), np.int64)
        for level in range(self.depth):
            along = sample @ self.directions[level]
            cuts = np.zeros(2**level)
            for k in np.unique(node).tolist():
                cuts[k] = np.median(along[node == k])
            self.cuts.append(cuts)
            node = 2 * node + (along > cuts[node])

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), np.int64)
        for level, cuts in enumerate(self.cuts):
            node = 2 * node + (vectors @ self.directions[level] > cuts[node])
        return node


def _leaves(trees: list[Tree]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            for k, tree in enumerate(trees):
                leaf = tree.leaf(vectors) if len(vectors) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), k, np.int32)), pa.array(leaf), batch.column(0), batch.column(1)], ["tree", "leaf", "point", "vector"])

    return run


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of two matrices, rounded so that they don't depend on the company."""
    found = (a**2).sum(-1)[..., :, None] + (b**2).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2))
    return np.round(np.maximum(found, 0), 6)


def _best(distance: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k least of each row."""
    if distance.shape[1] > k:
        return np.argpartition(distance, k - 1, axis=1)[:, :k]
    return np.tile(np.arange(distance.shape[1]), (len(distance), 1))


def _within_leaf(k: int):
    def run(table: pa.Table) -> pa.Table:
        point, vectors = table["point"].to_numpy(), _matrix(table["vector"].combine_chunks())
        out: list[list[np.ndarray]] = [[], [], []]
        for i in range(0, len(point), BLOCK):
            own = np.arange(i, min(i + BLOCK, len(point)))
            held, place = np.full((len(own), 0), np.inf), np.zeros((len(own), 0), np.int64)
            for j in range(0, len(point), BLOCK):
                other = np.arange(j, min(j + BLOCK, len(point)))
                distance = squares(vectors[own], vectors[other])
                distance[own[:, None] == other] = np.inf
                held, place = np.hstack([held, distance]), np.hstack([place, np.tile(other, (len(own), 1))])
                some = _best(held, k)
                held, place = np.take_along_axis(held, some, 1), np.take_along_axis(place, some, 1)
            real = np.isfinite(held)
            out[0].append(np.repeat(point[own], real.sum(1)))
            out[1].append(point[place[real]])
            out[2].append(held[real])
        return pa.table({n: np.concatenate(v) for n, v in zip(("point", "other", "distance"), out, strict=True)})

    return run


_EDGES = "point long, other long, distance double"


def _keep(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each point, each once. Sent once, by point, to all shuffle partitions, which serves both steps."""
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = Window.partitionBy("point").orderBy("distance", "other")
    others = [F.min(c).alias(c) for c in edges.columns if c not in ("point", "other")]
    return edges.repartition(parts, "point").groupBy("point", "other").agg(*others).withColumn("place", F.row_number().over(line)).where(F.col("place") <= k).drop("place")


def _among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the members of each list with one another: rows (point, other, vector, reach, new), lists one after another.

    Pairs of which neither is new have been compared before, and pairs beyond a point's
    reach change nothing; neither are sent. A list that goes on in the next batch waits for it,
    so a batch of lists is held, however long a partition is.
    """
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
        if table.num_rows:
            point = table["point"].to_numpy()
            last = int(np.flatnonzero(point != point[-1])[-1]) + 1 if point[0] != point[-1] else 0
            rest = table.slice(last).to_batches()[0]
            yield from _lists(table.slice(0, last))
    if rest is not None:
        yield from _lists(pa.Table.from_batches([rest]))


def _lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pairs of whole lists."""
    if not table.num_rows:
        return
    point = table["point"].to_numpy()
    begin = np.flatnonzero(np.concatenate([[True], point[1:] != point[:-1]]))
    sizes = np.diff(begin, append=len(point))
    ids, vectors = table["other"].to_numpy(), _matrix(table["vector"].combine_chunks())
    reach, new = table["reach"].to_numpy(), table["new"].to_numpy() > 0
    for n in np.unique(sizes[sizes > 1]).tolist():
        at = begin[sizes == n]
        for part in np.array_split(at, max(1, len(at) // 512)):
            rows = part[:, None] + np.arange(n)
            distance = squares(vectors[rows], vectors[rows])
            near = (distance < reach[rows][:, :, None]) & (new[rows][:, :, None] | new[rows][:, None, :]) & ~np.eye(n, dtype=bool)
            own, other = (np.broadcast_to(x, near.shape)[near] for x in (ids[rows][:, :, None], ids[rows][:, None, :]))
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(other), pa.array(distance[near])], ["point", "other", "distance"])


def graph(points: DataFrame, k: int, trees: int = TREES, rounds: int = ROUNDS, leaf: int = LEAF, sample: int = SAMPLE, seed: int = 5) -> DataFrame:
    """(point, other, distance): about the k nearest points of each point, by squared distance."""
    n = points.count()
    some = points.orderBy(F.xxhash64("point", F.lit(seed))).limit(sample).select("vector").toArrow()
    if n < 2:
        return points.sparkSession.createDataFrame([], _EDGES)
    wanted, k = k, SPARE * k
    first = _matrix(some["vector"].combine_chunks())
    forest = [Tree(first, -(-n // leaf), seed + t) for t in range(trees)]
    dealt = points.select("point", "vector").mapInArrow(_leaves(forest), "tree int, leaf long, point long, vector array<float>")
    live = F.max("new").over(Window.partitionBy("point")) > 0
    kept = fixed(_keep(dealt.groupBy("tree", "leaf").applyInArrow(_within_leaf(k), _EDGES), k).withColumns({"new": F.lit(1), "live": F.lit(True)}))
    for _ in range(rounds):
        # How far the neighbours of a point reach: only what is nearer can change them.
        far = F.when(F.count("*") >= k, F.max("distance")).otherwise(F.lit(float("inf"))).alias("reach")
        known = points.join(kept.groupBy("point").agg(far), "point").withColumnRenamed("point", "other")
        # Lists without a new member have nothing left to compare.
        lists = kept.where("live").select("point", "other", "new")
        both = lists.unionByName(lists.select("point", F.col("point").alias("other"), F.lit(0).alias("new")).distinct())
        sent = both.join(known, "other").select("point", "other", "vector", "reach", "new").repartition("point").sortWithinPartitions("point", "other")
        more = sent.mapInArrow(_among, _EDGES)
        every = kept.drop("live").withColumn("new", F.lit(0)).unionByName(more.withColumn("new", F.lit(1)))
        kept = fixed(_keep(every, k).withColumn("live", live))
        if kept.agg(F.avg("new")).first()[0] < CHANGED:
            break
    return _keep(kept.select("point", "other", "distance"), wanted)


def nearest(rows: DataFrame, key: str, k: int = 15, features: str = "features", **options) -> DataFrame:
    """(key, neighbour, distance): rows of about the k nearest other vectors; rows of equal vectors have distance 0.

    Of equal vectors each row is linked with the least key among them, not with all,
    so a group of n copies gives n - 1 rows; the other links lead to the least key, too.
    """
    points = fixed(points_of(rows, features))
    own = rows.select(F.col(key).alias("_key"), F.xxhash64(F.col(features).cast("array<float>")).alias("point")).join(points.select("point"), "point")
    first = own.groupBy("point").agg(F.min("_key").alias("_first"))
    edges = graph(points, k, **options).join(first.withColumnsRenamed({"point": "other", "_first": "neighbour"}), "other")
    copies = own.join(first, "point").where("_key <> _first").select(F.col("_key").alias(key), F.col("_first").alias("neighbour"), F.lit(0.0).alias("distance"))
    return own.join(edges, "point").select(F.col("_key").alias(key), "neighbour", F.sqrt("distance").alias("distance")).unionByName(copies)


# --- embedding -------------------------------------------------------------------


def bandwidths(distance: np.ndarray, perplexity: float, steps: int = 40) -> np.ndarray:
    """Similarities (rows add up to 1) to neighbours at squared distances; infinite ones are none. By bisection on the precision."""
    real = np.isfinite(distance)
    near = np.where(real, distance, np.inf).min(1, keepdims=True)
    gap = np.where(real, distance - np.where(np.isfinite(near), near, 0), np.inf)
    low, high = np.full(len(distance), -60.0), np.full(len(distance), 60.0)
    want = np.log(np.minimum(perplexity, np.maximum(real.sum(1), 1)))
    for _ in range(steps):
        middle = (low + high) / 2
        weight = np.exp(-np.where(real, gap, 0) * np.exp(middle)[:, None]) * real
        total = np.maximum(weight.sum(1), 1e-300)
        share = weight / total[:, None]
        entropy = -(share * np.log(np.maximum(share, 1e-300))).sum(1)
        wide = entropy > want
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    return share


def layout(vectors: np.ndarray, perplexity: float = PERPLEXITY, steps: int = STEPS) -> np.ndarray:
    """Two coordinates of a bounded set of points, by descent on the divergence of similarities."""
    n = len(vectors)
    if n < 4:
        return np.column_stack([np.arange(n, dtype=float), np.zeros(n)])
    distance = squares(vectors, vectors)
    np.fill_diagonal(distance, np.inf)
    p = bandwidths(distance, min(perplexity, (n - 1) / 3))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    middle = vectors - vectors.mean(0)
    y = np.linalg.svd(middle, full_matrices=False)[0][:, :2] if vectors.shape[1] > 1 else np.column_stack([middle, np.zeros(n)])
    y = y * np.sign(y[np.abs(y).argmax(0), np.arange(2)] + 1e-300)
    y, speed, gain = y / max(y[:, 0].std(), 1e-12) * 1e-2, np.zeros((n, 2)), np.ones((n, 2))
    rate = max(n / 12 / 4, 50.0)
    for step in range(steps):
        weight = 1 / (1 + np.maximum((y**2).sum(1)[:, None] + (y**2).sum(1) - 2 * y @ y.T, 0))
        np.fill_diagonal(weight, 0)
        pull = ((12 if step < 100 else 1) * p - weight / weight.sum()) * weight
        slope = 4 * (pull.sum(1)[:, None] * y - pull @ y)
        gain = np.clip(np.where((slope > 0) == (speed > 0), gain * 0.8, gain + 0.2), 0.01, None)
        speed = (0.5 if step < 100 else 0.8) * speed - rate * gain * slope
        y = y + speed
        y -= y.mean(0)
    return y


def settle(share: np.ndarray, near: np.ndarray, steps: int = 10) -> np.ndarray:
    """Where the sum over neighbours of share * log(1 + squared distance in the plane) is least, from the best neighbour on."""
    apart = ((near[:, :, None] - near[:, None]) ** 2).sum(-1)
    start = (np.log1p(apart) * share[:, None]).sum(-1).argmin(1)
    y = near[np.arange(len(near)), start]
    for _ in range(steps):
        weight = share / (1 + ((near - y[:, None]) ** 2).sum(-1))
        y = (weight[:, :, None] * near).sum(1) / np.maximum(weight.sum(1), 1e-300)[:, None]
    return y


def _place(marks: np.ndarray, spots: np.ndarray, perplexity: float):
    """Coordinates of points from their nearest landmarks."""
    k = min(len(marks), math.ceil(3 * perplexity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(1))
            found = [np.zeros((0, 2))]
            for i in range(0, len(vectors), BLOCK):
                distance = squares(vectors[i : i + BLOCK], marks)
                some = np.sort(_best(distance, k), axis=1)
                share = bandwidths(np.take_along_axis(distance, some, 1), min(perplexity, k))
                found.append(settle(share, spots[some]))
            y = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y[:, 0]), pa.array(y[:, 1])], ["point", "x", "y"])

    return run


def _shares(perplexity: float):
    """(point, other, share): similarities to neighbours, from lists of (distance, other) in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(2)])
            distance = np.full((len(sizes), max(sizes, default=0)), np.inf)
            real = np.arange(distance.shape[1]) < sizes[:, None]
            distance[real] = batch.column(2).flatten().to_numpy()
            share = bandwidths(distance, perplexity)[real] if len(sizes) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), sizes)), batch.column(1).flatten(), pa.array(share)], ["point", "other", "share"]
            )

    return run


def _move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points half of the way to where their neighbours draw them."""
    for batch in batches:
        sizes = np.array([len(x) for x in batch.column(3)])
        real = np.arange(max(sizes, default=0)) < sizes[:, None]
        share, near = np.zeros(real.shape), np.zeros((*real.shape, 2))
        share[real] = batch.column(3).flatten().to_numpy()
        near[real, 0], near[real, 1] = (batch.column(k).flatten().to_numpy() for k in (4, 5))
        y = np.column_stack([batch.column(k).to_numpy() for k in (1, 2)])
        weight = share / (1 + ((near - y[:, None]) ** 2).sum(-1))
        drawn = (weight[:, :, None] * near).sum(1) / np.maximum(weight.sum(1), 1e-300)[:, None]
        y = (y + drawn) / 2
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(y[:, 0]), pa.array(y[:, 1])], ["point", "x", "y"])


def embed(rows: DataFrame, features: str = "features", perplexity: float = PERPLEXITY, landmarks: int = LANDMARKS, moves: int = MOVES, seed: int = 5, **options) -> DataFrame:
    """Add x and y, in which neighbours stay neighbours; null for rows without usable features.

    Coordinates are that of the landmarks' layout, whose axes mean nothing.
    """
    points = fixed(points_of(rows, features))
    some = points.orderBy(F.xxhash64("point", F.lit(seed)), "point").limit(landmarks).toArrow()
    marks = _matrix(some["vector"].combine_chunks()) if len(some) else np.zeros((0, 1))
    spots = layout(marks, perplexity)
    placed = points.mapInArrow(_place(marks, spots, perplexity), "point long, x double, y double") if len(marks) else points.select("point", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    if moves and len(marks) > 1:
        edges = graph(points, math.ceil(3 * perplexity), seed=seed, **options)
        lists = edges.groupBy("point").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("l"))
        near = fixed(lists.select("point", F.col("l.other").alias("others"), F.col("l.distance").alias("distances")).mapInArrow(_shares(perplexity), "point long, other long, share double"))
        for _ in range(moves):
            spot = placed.withColumnsRenamed({"point": "other", "x": "_x", "y": "_y"})
            pull = near.join(spot, "other").groupBy("point").agg(F.sort_array(F.collect_list(F.struct("other", "share", "_x", "_y"))).alias("l"))
            lists = placed.join(pull, "point").select("point", "x", "y", "l.share", F.col("l._x").alias("xs"), F.col("l._y").alias("ys"))
            placed = fixed(lists.mapInArrow(_move, "point long, x double, y double"))
    held = rows.drop("x", "y").withColumn("_point", F.xxhash64(F.col(features).cast("array<float>")))
    return held.join(placed.withColumnRenamed("point", "_point"), "_point", "left").drop("_point")
