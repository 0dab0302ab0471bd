import datetime

import pytest
from pyspark.sql import functions as F

from catalith.functions import dates, idents, predicates, text
from catalith.functions import json as jsonf


def one(spark, value, build, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(build(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "value, build, want",
    [
        ("  a b　\n", text.strip, "a b"),
        (" NULL ", text.blank_to_null, None),
        ("  ", text.blank_to_null, None),
        (" x ", text.blank_to_null, "x"),
        ("Legal  Document/2", text.slug, "legal_document_2"),
        ("א" * 201, text.snippet, "א" * 200 + "…"),
        ("a" * 200, text.snippet, "a" * 200),
        (" 1. *tag * tail.", text.normalise_tag, "tag"),
        ("12 art.", text.normalise_tag, "art"),
        ("```json\n[1]\n```", text.unfence, "[1]"),
        ("```x\n[1]\n```", lambda c: text.unfence(c, False), "[1]"),
        ("it's \\", text.sql_literal, "it''s \\\\"),
        ("http://h/items/12/?a=1", lambda c: text.url_id(c, "http://h/items/"), 12),
        ("http://h/items/x", lambda c: text.url_id(c, "http://h/items/"), None),
        ("http://h/p", text.url_host, "h"),
        ("not a url", text.url_host, None),
        ("/p?a=1&lang=en", lambda c: text.set_query_parameter(c, "lang", "de"), "/p?a=1&lang=de"),
        ("/p", lambda c: text.set_query_parameter(c, "lang", "de"), "/p?lang=de"),
        ("http://h/p#frag", lambda c: text.set_query_parameter(c, "lang", "de"), "http://h/p?lang=de#frag"),
        ("/p?a=1&lang=he#x?lang=fr", lambda c: text.set_query_parameter(c, "lang", "de"), "/p?a=1&lang=de#x?lang=fr"),
        ("/p?axb=1", lambda c: text.set_query_parameter(c, "a.b", "$1 &"), "/p?axb=1&a.b=%241%20%26"),
        ("/p?a.b=1&a.b", lambda c: text.set_query_parameter(c, "a.b", "2"), "/p?a.b=2&a.b"),
        ("DE-at", text.language_key, "de"),
        (None, text.language_key, ""),
        ("AB-G-F-0001-002-R0003", idents.folder_of, "AB-G-F-0001-002"),
        ("AB-G-F-0001-002-R0003", idents.collection_of, "AB-G-F-0001"),
        ("AB-G-F-0001-002", idents.collection_of, None),
        ("AB-G-F-0001-002", idents.collection_of_folder, "AB-G-F-0001"),
        ("AB-G-F-0001-002-R12345", idents.record_number, 12345),
        ("AB-Rx", idents.record_number, None),
        ("G-F-0008-1", idents.family_id, "G-F-0008"),
        ("G-F", idents.family_id, None),
        ("X-G-F-0008", idents.family_number, "0008"),
        ("AB-G-F-0001-2-R3", lambda c: idents.parent_of_child(c, "AB-G-F-"), "AB-G-F-0001"),
        ("AB-G-F-0001x", lambda c: idents.parent_of_child(c, "AB-G-F-"), None),
        ("AB-G-F-0001-002", idents.short_reference, "0001-002"),
        ("AB-R0003", idents.record_tag, "R0003"),
        ("AB-R1-R2", idents.before_record, "AB"),
        ("Items (AB-1):", idents.label_key, "AB-1"),
        ("AB-1", lambda c: idents.without_prefix(c, "AB-"), "1"),
        (" Pending", predicates.is_meaningful, False),
        ("abc", predicates.is_meaningful, True),
        (None, predicates.is_meaningful, False),
        (" - ", predicates.is_placeholder, True),
        ("photo_012", predicates.is_auto_number, True),
        ("ab", predicates.in_length_band, False),
        ("abc", predicates.in_length_band, True),
        ("a" * 49, predicates.in_length_band, True),
        ("a" * 50, predicates.in_length_band, False),
        (None, predicates.needs_work, True),
        (" ", predicates.is_filled, False),
        (None, lambda c: predicates.not_listed(c, ["a"]), True),
        ("a", lambda c: predicates.not_listed(c, ["a"]), False),
        ("F-1", lambda c: predicates.route(c, [("^F-", "family"), ("1$", "one")], "edge"), "family"),
        (None, lambda c: predicates.route(c, [("^F-", "family")], "edge"), "edge"),
        ("dcterms:title", predicates.is_property_key, True),
        ("o:id", predicates.is_property_key, False),
        ("@type:x", predicates.is_property_key, False),
        ("NULL", predicates.is_key, False),
        ("True", jsonf.truth, True),
        ("maybe", jsonf.truth, None),
        ("a| b||c ", jsonf.split_cell, ["a", "b", "c"]),
        ("F:1,GT:x,F:2", jsonf.status_map, {"F": 2, "GT": None}),
        ("head tags: a|b", lambda c: text.category_tags(c, "tags"), ["a", "b"]),
        ("head tags: a", lambda c: text.category_tags(c, "tags"), []),
        ("a\n \nb", text.paragraphs, ["a", "b"]),
    ],
)
def test_string_functions(spark, value, build, want):
    assert one(spark, value, build) == want


@pytest.mark.parametrize(
    "title, want",
    [
        ("Letters - אב", ("Letters", "אב")),
        ("Letters", ("Letters", None)),
        ("אב", (None, "אב")),
        ("123", (None, None)),
        (None, (None, None)),
        ("-Foo אב", ("-Foo", "אב")),
        ("Foo bar - אב:", ("Foo bar", "אב:")),
        (" ,Foo:;, - אב-", (",Foo", "אב-")),
    ],
)
def test_bilingual_titles(spark, title, want):
    assert tuple(one(spark, title, text.split_bilingual_title)) == want


@pytest.mark.parametrize("low, high, want", [(7630, 7700, "session"), (10, 6500, "old_vs_2025"), (10, 20, "legacy"), (5500, 7000, "other")])
def test_pair_class(spark, low, high, want):
    df = spark.createDataFrame([(low, high)], "a int, b int")
    assert df.select(predicates.pair_class(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize("value, want", [(4999, "<5000"), (5000, "5000s"), (6999, "6000s"), (7629, "early-7000s"), (7630, "session-7000s")])
def test_buckets(spark, value, want):
    assert one(spark, value, predicates.id_bucket, "int") == want


def test_rectangle_includes_its_border(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (1.1, 0.5)], "x double, y double")
    assert df.where(predicates.in_rectangle(F.col("x"), F.col("y"), 1, 0, 0, 1)).count() == 2


D = datetime.date


@pytest.mark.parametrize(
    "value, want",
    [
        ("1933", (D(1933, 1, 1), D(1933, 12, 31), "year")),
        ("1936-02", (D(1936, 2, 1), D(1936, 2, 29), "month")),
        ("1936-02-03", (D(1936, 2, 3), D(1936, 2, 3), "day")),
        ("1930s", (D(1930, 1, 1), D(1939, 12, 31), "decade")),
        ("1930s-1940s", (D(1930, 1, 1), D(1949, 12, 31), "range")),
        ("1914-1918", (D(1914, 1, 1), D(1918, 12, 31), "range")),
        ("19th century", (None, None, "other")),
        ("1936-13", (None, None, "month")),
        (None, (None, None, None)),
    ],
)
def test_partial_dates(spark, value, want):
    assert tuple(one(spark, value, dates.partial_date)) == want


def test_json_replies(spark, rows):
    df = spark.createDataFrame([(1, '[{"d":"x","g":true},2,{"d":"y"}]'), (2, '```json\n{"d":"z","g":false}\n```'), (3, "garbage"), (4, None), (5, "[]")], "k int, reply string")
    got = jsonf.valid_elements(df, "reply", {"d": "string", "g": "boolean"})
    assert rows(got, "k", "d", "g") == [(1, "x", True), (2, "z", False)]


def test_json_objects(spark):
    assert one(spark, '{"a":"1"}', lambda c: jsonf.parse_object(c, ["a", "b"])).asDict() == {"ok": True, "a": "1", "b": ""}
    assert one(spark, "no", lambda c: jsonf.parse_object(c, ["a"])).asDict() == {"ok": False, "a": ""}


def test_nan_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.concat_columns([F.col("x"), F.col("y")])).first()[0] == "a"
    assert df.select(text.concat_columns([F.col("x"), F.col("y")], True)).first()[0] == "a nan"


def test_kinds_of_values_and_pages(spark):
    """F14, F15, F17 and L6."""
    assert [one(spark, n, lambda c: predicates.is_shown_property(c.cast("int"), (10, 11))) for n in ("10", "12")] == [False, True]
    assert [one(spark, u, lambda c: predicates.is_uri_value(F.lit("uri"), c)) for u in ("http://x", "", None)] == [True, False, False]
    assert one(spark, "http://x", lambda c: predicates.is_uri_value(F.lit("literal"), c)) is False
    assert [one(spark, k, predicates.is_link) for k in ("resource:item", "literal")] == [True, False]
    assert [one(spark, n, lambda c: predicates.page_kind(c.cast("int"))) for n in ("5", "2", "3", None)] == ["collection", "folder", "item", "item"]


def test_padding_blanks_and_signatures(spark):
    assert [one(spark, n, lambda c: text.zero_pad(c.cast("int"))) for n in ("7", "12345")] == ["0007", "12345"]
