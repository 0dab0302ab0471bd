"""A quality classifier as a sparse rule ensemble.

1. Statistics of each text, from one Arrow kernel: lengths, shares of kinds of
   characters and of kinds of words, and how much words, runs of words and lines repeat.
2. Trees. On a bounded sample of labelled rows, small trees are boosted, each on a part
   of the rows and of the statistics. Every node but the root is a rule: the conjunction
   of the conditions on the path to it. Rules that agree on all of the sample are one.
3. A logistic regression with a lasso penalty weighs the rules; the penalty is the
   largest one whose loss on a part of the sample kept apart is within one standard error of
   the least. Most weights become zero.
4. The remaining rules are compiled into one Spark column over the statistics.

The sample has at most ``MOST`` documents, the least by a hash of their doc_id; it is
all that comes to the driver. Labels, language, source and doc_id are never inputs of a
score. One sample gives one model.

Null texts are empty and get a score, too. Labels that are null, or of a null doc_id,
are passed over; of a doc_id with several labels the greater part counts, a tie for 1.
A doc_id's repeated rows are measured each for itself. Without labels of both classes
the score is the share of 1 (without labels at all, 0.5). Texts are read whole. Columns
named like a statistic are left alone: statistics live in one struct, ``_stats``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.grams import BLANK, BYTE, chunks, shingles, tokens, utf8

#: Labelled documents that the model is fitted on, at most.
MOST = 20_000
#: Every FOLDS-th doc_id by its checksum is held out.
FOLDS = 5
#: Score from which a document counts as good.
GOOD = 0.3
#: Trees, their depth, shares of rows and statistics that each sees, least rows in a node, and step of boosting.
TREES, DEPTH, ROWS, STATS, LEAF, STEP = 60, 3, 0.5, 0.6, 10, 0.2
#: Thresholds tried for a statistic.
BINS = 32

NAMES = (
    "words", "word_bytes", "upper", "letters", "digits", "symbols", "points", "marks", "beyond_ascii", "blank",
    "same_as_before", "different_words", "bare_words", "short_words", "long_words", "capitals", "ends",
    "repeated_fives", "top_word", "lines", "repeated_lines", "line_words",
)


def _bytes_in(chars: str) -> np.ndarray:
    return np.array([b < 128 and chr(b) in chars for b in range(256)])


_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_DIGIT, _SYMBOL, _POINT, _MARK = _bytes_in("0123456789"), _bytes_in("#*$%&|<>@^~=+_{}[]\\/"), _bytes_in(".,;:'\"-()"), _bytes_in("!?")
_LINE = _bytes_in("\n")


def _runs(key: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each document the number of different values and how often the most frequent one occurs."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    head = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1]))) if len(k) else np.zeros(0, np.int64)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, d[head], np.diff(np.append(head, len(k))))
    return np.bincount(d[head], minlength=docs), most


def measure(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The statistics of the texts data[at[i]:at[i + 1]], one row a text."""
    docs, base = len(at) - 1, at - at[0]
    text = data[at[0] : at[-1]]
    size = np.diff(base)
    ids, begin, end, first = tokens(data, at, BYTE, BLANK)
    n = np.diff(first)
    doc = np.repeat(np.arange(docs), n)

    def chars(table: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(table[text], dtype=np.int64))
        return total[base[1:]] - total[base[:-1]]

    def count(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc, flags, minlength=docs)

    first_byte, last_byte, length = (text[begin], text[end - 1], end - begin) if len(ids) else (text[:0],) * 2 + (begin,)
    letters_to = np.append(0, np.cumsum(_LETTER[text] | _DIGIT[text], dtype=np.int64))
    latin = np.append(False, (text[1:] >= 0x80) & (text[1:] <= 0x9E) & (text[:-1] == 0xC3)) if len(text) else np.zeros(0, bool)  # À to Þ
    accents = np.append(0, np.cumsum(latin, dtype=np.int64))
    same = np.zeros(len(ids), bool)
    same[1:] = (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1])
    different, most = _runs(ids, doc, docs)
    five = shingles(ids, 5)
    inside = doc[4:] == doc[: len(five)] if len(five) else np.zeros(0, bool)
    five_doc = doc[: len(five)][inside]
    fives, _ = _runs(five[inside], five_doc, docs)
    n_fives = np.bincount(five_doc, minlength=docs)
    lines, line_begin, _, line_first = tokens(data, at, BYTE, _LINE)
    line_doc = np.repeat(np.arange(docs), np.diff(line_first))
    n_lines = np.bincount(line_doc, minlength=docs)
    other_lines, _ = _runs(lines, line_doc, docs)
    upper, letter = chars(_UPPER) + accents[base[1:]] - accents[base[:-1]], chars(_LETTER)

    def share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a / np.maximum(b, 1)

    columns = [
        n, share(count(length), n), share(upper, letter), share(letter, size), share(chars(_DIGIT), size), share(chars(_SYMBOL), size), share(chars(_POINT), size),
        share(chars(_MARK), size), share(chars(np.arange(256) >= 128), size), share(chars(BLANK), size), share(count(same), n), share(different, n),
        share(count(letters_to[end] == letters_to[begin]), n), share(count(length <= 3), n), share(count(length > 20), n), share(count(_UPPER[first_byte]), n),
        share(count(_bytes_in(".!?")[last_byte]), n), share(n_fives - fives, n_fives), share(most, n), n_lines, share(n_lines - other_lines, n_lines), share(n, n_lines),
    ]
    return np.stack([np.asarray(c, np.float64) for c in columns], axis=1)


def statistics(text: Column) -> Column:
    """The statistics of a text as a struct."""
    kind = pa.struct([(name, pa.float64()) for name in NAMES])

    @F.arrow_udf(f"struct<{', '.join(f'{name}: double' for name in NAMES)}>")
    def run(texts: pa.Array) -> pa.Array:
        data, at = utf8(texts)
        found = np.concatenate([measure(data, at[i : j + 1]) for i, j in chunks(at)]) if len(texts) else np.zeros((0, len(NAMES)))
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(found[:, k])) for k in range(len(NAMES))], fields=list(kind))

    return run(F.coalesce(text.cast("string"), F.lit("")))


# --- trees and rules -------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``low`` < statistic <= ``high`` for each (statistic, low, high); None leaves a side open."""

    conditions: tuple[tuple[str, float | None, float | None], ...]

    def holds(self, x: np.ndarray, names: Sequence[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, low, high in self.conditions:
            value = x[:, names.index(name)]
            if low is not None:
                out &= value > low
            if high is not None:
                out &= value <= high
        return out

    def column(self, stats: Column) -> Column:
        out = None
        for name, low, high in self.conditions:
            for part in ([stats[name] > low] if low is not None else []) + ([stats[name] <= high] if high is not None else []):
                out = part if out is None else out & part
        return out

    def __str__(self) -> str:
        return " and ".join(f"{'' if a is None else f'{a:.4g} < '}{name}{'' if b is None else f' <= {b:.4g}'}" for name, a, b in self.conditions)


def _edges(x: np.ndarray) -> np.ndarray:
    """Thresholds between different values of a statistic."""
    values = np.unique(np.quantile(x, np.linspace(0, 1, BINS + 1), method="inverted_cdf"))
    return (values[1:] + values[:-1]) / 2


class _Grower:
    """Regression trees on binned statistics; their nodes as paths of (statistic, bin, right)."""

    def __init__(self, x: np.ndarray) -> None:
        self.edges = [_edges(x[:, k]) for k in range(x.shape[1])]
        self.bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def split(self, rows: np.ndarray, target: np.ndarray, features: np.ndarray) -> tuple[int, int] | None:
        """The statistic and bin whose split lowers the squared error most."""
        best, found = 1e-9, None
        total, n = target[rows].sum(), len(rows)
        for f in features.tolist():
            width = len(self.edges[f]) + 1
            count = np.cumsum(np.bincount(self.bins[rows, f], minlength=width))[:-1]
            left = np.cumsum(np.bincount(self.bins[rows, f], target[rows], minlength=width))[:-1]
            fits = (count >= LEAF) & (n - count >= LEAF)
            if fits.any():
                gain = np.where(fits, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1), -np.inf) - total**2 / n
                k = int(gain.argmax())
                if gain[k] > best:
                    best, found = gain[k], (f, k)
        return found

    def grow(self, rows: np.ndarray, target: np.ndarray, curve: np.ndarray, features: np.ndarray, value: np.ndarray) -> list[tuple]:
        """Paths to the nodes; ``value`` gets each row's leaf."""
        paths, open_ = [], [(rows, np.arange(len(target)), ())]
        while open_:
            seen, all_, path = open_.pop(0)
            cut_ = self.split(seen, target, features) if len(path) < DEPTH else None
            if cut_ is None:
                value[all_] = target[seen].sum() / max(curve[seen].sum(), 1e-6)
                continue
            f, k = cut_
            for right in (False, True):
                inside = [(self.bins[r, f] > k) == right for r in (seen, all_)]
                paths.append((*path, (f, k, right)))
                open_.append((seen[inside[0]], all_[inside[1]], paths[-1]))
        return paths

    def rule(self, path: tuple, names: Sequence[str]) -> Rule:
        bounds: dict[int, list] = {}
        for f, k, right in path:
            low_high, edge = bounds.setdefault(f, [None, None]), float(self.edges[f][k])
            if right:
                low_high[0] = edge if low_high[0] is None else max(low_high[0], edge)
            else:
                low_high[1] = edge if low_high[1] is None else min(low_high[1], edge)
        return Rule(tuple((names[f], *bounds[f]) for f in sorted(bounds)))


def extract_rules(x: np.ndarray, y: np.ndarray, names: Sequence[str], trees: int = TREES, seed: int = 11) -> list[Rule]:
    """Rules of boosted trees, those that agree on all rows of the sample once."""
    draw, grower = np.random.default_rng(seed), _Grower(x)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    rules: dict[bytes, Rule] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(draw.random(len(y)) < ROWS)
        features = np.sort(draw.choice(x.shape[1], max(1, round(STATS * x.shape[1])), replace=False))
        value = np.zeros(len(y))
        for path in grower.grow(rows, y - p, p * (1 - p), features, value):
            rule = grower.rule(path, names)
            held = rule.holds(x, names)
            sides = sorted((np.packbits(held).tobytes(), np.packbits(~held).tobytes()))
            if 0 < held.sum() < len(y):
                rules.setdefault(sides[0], rule)
        margin += STEP * np.clip(value, -4, 4)
    return list(rules.values())


# --- weights ----------------------------------------------------------------------


def _loss(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z) - y * z


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 250) -> np.ndarray:
    """Weights (intercept first, which isn't penalised) of a logistic regression, by accelerated proximal steps."""
    a = np.column_stack([np.ones(len(x), x.dtype), x])
    rate = 4 * len(a) / max(float(np.linalg.norm(a.T @ a, 2)), 1e-12)
    w = np.zeros(a.shape[1], x.dtype) if start is None else start.copy()
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        slope = a.T @ (1 / (1 + np.exp(-(a @ ahead))) - y).astype(x.dtype) / len(a)
        new = ahead - rate * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        later = (1 + math.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / later * (new - w)
        done = np.abs(new - w).max() < 1e-6
        w, t = new, later
        if done:
            break
    return w


@dataclass(frozen=True)
class RuleEnsemble:
    """An intercept and weighted rules; the score is the logistic function of their sum."""

    intercept: float
    rules: tuple[tuple[Rule, float], ...] = field(default=())

    def margin(self, stats: Column) -> Column:
        out = F.lit(self.intercept)
        for rule, weight in self.rules:
            out = out + F.when(rule.column(stats), F.lit(weight)).otherwise(F.lit(0.0))
        return out

    def score(self, rows: DataFrame, text: str = "text") -> DataFrame:
        """The rows with ``_stats`` and ``score``."""
        held = rows.withColumn("_stats", statistics(F.col(text)))
        return held.withColumn("score", 1 / (1 + F.exp(-self.margin(F.col("_stats")))))

    def predict(self, x: np.ndarray, names: Sequence[str] = NAMES) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x, names)
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, names: Sequence[str] = NAMES, seed: int = 11) -> RuleEnsemble:
    """Rules and weights from statistics and labels of the sample."""
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 4 * LEAF:
        share = min(max(share, 0.5 / (len(y) + 1)), 1 - 0.5 / (len(y) + 1))
        return RuleEnsemble(math.log(share / (1 - share)))
    rules = extract_rules(x, y, names, seed=seed)
    if not rules:
        return RuleEnsemble(math.log(share / (1 - share)))
    held = np.stack([r.holds(x, names) for r in rules], axis=1).astype(np.float32)
    apart = np.random.default_rng(seed + 1).random(len(y)) < 0.25
    if y[~apart].min() == y[~apart].max() or not apart.any():
        apart[:] = False
    top = np.abs(held.T @ (y - share)).max() / len(y)
    path = top * np.geomspace(0.5, 0.01, 8)
    check = apart if apart.any() else ~apart
    tried, w = [], None
    for penalty in path:
        w = lasso(held[~apart], y[~apart], penalty, w)
        each = _loss(w[0] + held[check] @ w[1:], y[check])
        tried.append((each.mean(), each.std() / math.sqrt(len(each))))
    least = min(range(len(tried)), key=lambda k: tried[k][0])
    penalty = next(p for p, (mean, _) in zip(path, tried, strict=True) if mean <= sum(tried[least]))
    w = None
    for p in path[path >= penalty]:
        w = lasso(held, y, p, w)
    return RuleEnsemble(float(w[0]), tuple((r, float(v)) for r, v in zip(rules, w[1:], strict=True) if v))


# --- tables -----------------------------------------------------------------------


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Whether the document's label isn't learned from; null ids have no checksum and are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", most: int = MOST) -> RuleEnsemble:
    """The model of a label, fitted on at most ``most`` labelled documents that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    place = F.xxhash64("doc_id")
    some = known.orderBy(place, "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(some), "doc_id")
    rows = rows.select("doc_id", "y", statistics(F.col("text")).alias("_stats")).orderBy(place, "doc_id", "_stats").limit(most)
    table = rows.select("y", *[F.col("_stats")[name].alias(name) for name in NAMES]).toArrow()
    x = np.stack([table[name].to_numpy() for name in NAMES], axis=1) if len(table) else np.zeros((0, len(NAMES)))
    return fit(x, table["y"].to_numpy())


def op11_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    rows = train(docs, labels).score(docs.select("doc_id", "text"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
