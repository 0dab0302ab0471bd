"""Quality rules as a short-circuit cascade.

Each rule needs some measurements and rejects on a condition over them. On a
sample of the rows the operator estimates every rule's cost, from the sample's text
lengths and the measurements' unit costs, and counts what the rule rejects; rules
then run by rejections per cost, and a row that one rule has rejected skips the
measurements of the rules after it. The order decides the cost and which rule is
named, never whether a row is kept.

The sample is a share of the rows in at most ``FILES`` files, the least by a hash of
their names, so the estimate reads the same amount of a small corpus and of a large
one. Its tasks keep the measurements and send back sums, and one table gives one order.
Tables that aren't read from files are sampled as a whole.

Null and blank texts have no words. Repeated rows are judged each for itself.
The filter keeps all columns it got, whatever their names. Texts of any length
are measured whole, within one row; no rows give no rows. Everything stays in
Spark's expressions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.common import WORD, words

WINDOW = 8
#: Files that the sample is taken from.
FILES = 8


@dataclass(frozen=True)
class Rule:
    """``needs``: names of measurements; ``reject``: a condition over them."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[], Column] = field(compare=False)


#: A measurement is a list of steps, each a column over ``_text``, ``_words`` and
#: earlier steps; a step that refers to an array twice must be a column of its
#: own, or Spark would compute that array again for every element.
def _windows() -> Column:
    n = F.size("_word_hashes")
    return F.when(
        n > WINDOW,
        F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("_word_hashes"), i, WINDOW))),
    )


def _ordered() -> Column:
    repeated = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    return F.when(repeated, F.sort_array(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))


def _places() -> Column:
    twice = F.filter(
        "_ordered",
        lambda e, k: F.coalesce(e["h"] == F.get("_ordered", k + 1)["h"], F.lit(False))
        | F.coalesce(e["h"] == F.get("_ordered", k - 1)["h"], F.lit(False)),
    )
    return F.sort_array(F.transform(twice, lambda e: e["i"]))


def _covered() -> Column:
    steps = F.transform(
        "_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_places", k - 1), F.lit(WINDOW)))
    )
    return F.coalesce(F.aggregate(steps, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")


MEASURES: dict[str, list[tuple[str, Callable[[], Column]]]] = {
    "n_words": [("n_words", lambda: F.size("_words").cast("long"))],
    "word_chars": [("word_chars", lambda: F.length(F.array_join("_words", "")).cast("long"))],
    "n_symbols": [
        ("n_symbols", lambda: (F.length("_text") - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long"))
    ],
    "n_lines": [
        ("_lines", lambda: F.filter(F.split("_text", "\n"), lambda x: x.rlike(WORD))),
        ("n_lines", lambda: F.size("_lines").cast("long")),
        ("n_dup_lines", lambda: (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")),
    ],
    "n_upper": [
        ("n_upper", lambda: (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}", ""))).cast("long")),
        ("n_lower", lambda: (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Ll}", ""))).cast("long")),
    ],
    "n_stutter": [
        (
            "n_stutter",
            lambda: F.size(F.filter("_words", lambda w, i: F.coalesce(w == F.get("_words", i - 1), F.lit(False)))).cast("long"),
        )
    ],
    "n_repeat_words": [
        ("_word_hashes", lambda: F.transform("_words", lambda w: F.xxhash64(w))),
        ("_hashes", _windows),
        ("_ordered", _ordered),
        ("_places", _places),
        ("n_repeat_words", _covered),
    ],
}

#: Cost of a measurement for each character and for each word, in nanoseconds on one core.
UNITS: dict[str, tuple[float, float]] = {
    "n_words": (0.0, 0.0),
    "word_chars": (0.0, 20.0),
    "n_symbols": (30.0, 0.0),
    "n_lines": (15.0, 0.0),
    "n_upper": (100.0, 0.0),
    "n_stutter": (0.0, 120.0),
    "n_repeat_words": (0.0, 2000.0),
}

#: Shortest accepted document, in words.
LEAST_WORDS = 20

RULES: tuple[Rule, ...] = (
    Rule("too_short", ("n_words",), lambda: F.col("n_words") < LEAST_WORDS),
    Rule("repeated_words", ("n_words", "n_repeat_words"), lambda: 100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
    Rule("stutter", ("n_words", "n_stutter"), lambda: 100 * F.col("n_stutter") > 30 * F.col("n_words")),
    Rule("symbols", ("n_words", "n_symbols"), lambda: 10 * F.col("n_symbols") > F.col("n_words")),
    Rule("repeated_lines", ("n_lines",), lambda: 100 * F.col("n_dup_lines") > 40 * F.col("n_lines")),
    Rule(
        "word_length",
        ("n_words", "word_chars"),
        lambda: (F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 12 * F.col("n_words")),
    ),
    Rule("shouting", ("n_upper",), lambda: 10 * F.col("n_upper") > 4 * (F.col("n_upper") + F.col("n_lower"))),
)


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    held = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return held.withColumn("_words", words(F.col("_text")))


def _measure(df: DataFrame, name: str, alive: Column | None) -> DataFrame:
    for step, build in MEASURES[name]:
        df = df.withColumn(step, build() if alive is None else F.when(alive, build()))
    return df


def _some_files(docs: DataFrame, files: int) -> DataFrame:
    """The rows in a few of the files that the table is read from, or all rows."""
    paths = docs.inputFiles()
    if len(paths) <= files:
        return docs
    names = {p.rsplit("/", 1)[-1] for p in paths}
    chosen = sorted(names, key=lambda p: hashlib.md5(p.encode()).hexdigest())[:files]
    try:
        some = docs.where(F.col("_metadata.file_name").isin(chosen))
        return docs if some.isEmpty() else some
    except AnalysisException:  # a derived table
        return docs


def costs(rule: Rule, chars: float, words_: float) -> float:
    """Nanoseconds that the rule's measurements take for a text of so many characters and words."""
    return 1.0 + sum(a * chars + b * words_ for a, b in (UNITS.get(name, (0.0, 0.0)) for name in rule.needs))


def order_rules(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    at_most: int = 2000,
    seed: int = 7,
    files: int = FILES,
) -> list[Rule]:
    """Rules by rejections per cost, estimated on about ``at_most`` rows of ``files`` files."""
    some = _some_files(docs, files)
    total = some.count()
    if not total:
        return list(rules)
    sample = _with_words(some.select(F.col(text).alias("_in")).sample(min(1.0, at_most / total), seed), "_in")
    for name in sorted({n for rule in rules for n in rule.needs}):
        sample = _measure(sample, name, None)
    kept = [c for c in sample.columns if not c.startswith("_")]
    measured = sample.select(*kept, F.length("_text").alias("_chars"), F.size("_words").alias("_n")).persist()
    rejected = [F.count_if(F.coalesce(rule.reject(), F.lit(False))).alias(f"_rule{k}") for k, rule in enumerate(rules)]
    n, chars, words_, *hits = measured.agg(F.count("*"), F.sum("_chars"), F.sum("_n"), *rejected).first()
    measured.unpersist()
    if not n:
        return list(rules)
    rated = [(-hit / n / costs(rule, chars / n, words_ / n), rule.name, rule) for hit, rule in zip(hits, rules, strict=True)]
    return [rule for _, _, rule in sorted(rated, key=lambda x: x[:2])]


def cascade(
    docs: DataFrame,
    text: str = "text",
    rules: Sequence[Rule] = RULES,
    always: Sequence[str] = (),
) -> DataFrame:
    """Add ``failed_rule`` (null: kept) and the measurements.

    ``rules`` run in the order given. Measurements named in ``always`` are made
    for every row; others are null where an earlier rule has rejected the row.
    Columns of ``docs`` named like a measurement or with a leading underscore
    are replaced.
    """
    df, made = _with_words(docs, text), set(always)
    for name in always:
        df = _measure(df, name, None)
    df = df.withColumn("failed_rule", F.lit(None).cast("string"))
    for rule in rules:
        for name in rule.needs:
            if name not in made:
                df = _measure(df, name, F.col("failed_rule").isNull())
                made.add(name)
        df = df.withColumn("failed_rule", F.coalesce("failed_rule", F.when(rule.reject(), F.lit(rule.name))))
    return df


def quality_filter(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with the columns they came with."""
    held = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_in"))
    judged = cascade(held, "_in", order_rules(docs, text, rules)).withColumn("_at", F.monotonically_increasing_id())
    # Over a column that isn't deterministic the filter stays where it is. Pushed down, the
    # optimiser would copy each rule's condition into all later ones, once for each mention.
    return judged.where(F.col("failed_rule").isNull() & (F.col("_at") >= 0)).select("_row.*")


def op8_quality(docs: DataFrame) -> DataFrame:
    """One row a document: the measurements, ``base_failed``, ``kept``, ``failed_rule``."""
    base = ("n_words", "word_chars", "n_symbols", "n_lines", "n_repeat_words")
    rows = cascade(docs.select("doc_id", "text"), "text", order_rules(docs), base)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.col("failed_rule").isNull()).alias("kept"),
    )
