"""Column helpers against plain Python on generated texts."""

import re

import pytest
from pyspark.sql import functions as F

from catalith.functions import idents, predicates, text
from catalith.operators import localise

hypothesis = pytest.importorskip("hypothesis")
from hypothesis import HealthCheck, given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

SPACE = " \t\n\r\x0b\x0c\x85\xa0               　"
LETTERS = "abcXYZ019_-.,:;'\\|*/אבגéß\U0001f600" + SPACE
TEXTS = st.lists(st.text(LETTERS, max_size=60), min_size=30, max_size=60)
IDS = st.lists(
    st.builds(
        lambda p, n, f, r: p + f"G-F-{n:04d}" + f + r,
        st.sampled_from(["AB-001-", "", "x "]),
        st.integers(0, 99999),
        st.sampled_from(["", "-001", "-12", "-001-002"]),
        st.sampled_from(["", "-R0001", "-R12345", "-R", "-Rx", "-R1-R2"]),
    ),
    min_size=30,
    max_size=60,
)
ONCE = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def both(spark, values, column, python):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string")
    got = [r["r"] for r in df.select("i", column(F.col("c")).alias("r")).orderBy("i").collect()]
    assert got == [python(v) for v in values]


@ONCE
@given(TEXTS)
def test_texts(spark, values):
    both(spark, values, text.strip, lambda v: v.strip(SPACE))
    both(spark, values, text.slug, lambda v: re.sub("[^a-z0-9]+", "_", v.lower()).strip("_"))
    both(spark, values, lambda c: text.snippet(c, 20), lambda v: v if len(v) <= 20 else v[:20] + "…")
    both(spark, values, text.sql_literal, lambda v: v.replace("\\", "\\\\").replace("'", "''"))
    both(spark, values, text.edge_trim, lambda v: v.strip(" ,-:;\t"))
    both(spark, values, predicates.is_meaningful, lambda v: len(v.strip(SPACE)) >= 3 and v.strip(SPACE).lower() not in predicates.EMPTY_WORDS)
    both(spark, values, predicates.is_auto_number, lambda v: bool(re.search("_[0-9]+$", v.strip(SPACE))))


@ONCE
@given(IDS)
def test_identifiers(spark, values):
    def number(v):
        m = re.search(r"-R([0-9]+)$", v)
        return int(m[1]) if m else None

    both(spark, values, idents.record_number, number)
    both(spark, values, idents.folder_of, lambda v: re.sub(r"-R[0-9]+$", "", v) if re.search(r"-R[0-9]+$", v) else None)
    both(spark, values, idents.before_record, lambda v: v.split("-R", 1)[0])
    both(spark, values, idents.family_id, lambda v: "-".join(v.split("-")[:3]) if v.count("-") >= 2 else None)
    both(spark, values, idents.collection_of, lambda v: re.sub(r"-[0-9]{3}-R[0-9]+$", "", v) if re.search(r"-[0-9]{3}-R[0-9]+$", v) else None)


VALUES = st.lists(
    st.tuples(st.integers(0, 4), st.sampled_from([None, "", "en", "de", "DE-at", "he", "fr"]), st.integers(0, 9)), min_size=20, max_size=40
)


@ONCE
@given(VALUES, st.sampled_from(localise.LOCALES))
def test_locales(spark, rows_, locale):
    df = spark.createDataFrame([(k, lang, f"v{n}-{pos}", pos) for pos, (k, lang, n) in enumerate(rows_)], "k int, lang string, value string, pos int")
    by = {}
    for pos, (k, lang, n) in enumerate(rows_):
        tag = (lang or "")[:2].lower()
        by.setdefault(k, []).append((tag, f"v{n}-{pos}"))
    pick, render = {}, {}
    for k, vs in by.items():
        own, plain, other = [v for t, v in vs if t == locale], [v for t, v in vs if t == ""], [v for t, v in vs if t not in ("", locale)]
        pick[k] = (own + plain + (["TBA"] if other else []))[0]
        render[k] = plain + own or ["TBA"]
    assert {r["k"]: r["picked"] for r in localise.pick_local(df, locale, ["k"], "TBA").collect()} == pick
    got = {}
    for r in localise.render_list(df, locale, ["k"], "TBA").orderBy("k", "n").collect():
        got.setdefault(r["k"], []).append(r["value"])
    assert got == render
