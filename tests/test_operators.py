import pytest
from pyspark.sql import functions as F

from catalith.operators import aggregates, changes, features, localise, parse, reconcile, sequences, values, vocab
from catalith.streaming import batches

VALUE = "resource_id bigint, term string, pos int, type string, lang string, value string, value_resource_id bigint, uri string, label string, is_public boolean"


def literal(i, term, pos, value, lang=None):
    return (i, term, pos, "literal", lang, value, None, None, None, True)


def test_minting_fills_gaps(spark, rows):
    new = spark.createDataFrame([("A", i) for i in range(4)] + [("B", 0)], "c string, n int")
    used = spark.createDataFrame([("A-R0001",), ("A-R0003",), ("A-R0003",), ("A-R12345",), ("Z-R0001",)], "item_id string")
    assert rows(sequences.mint(new, "c", ["n"], used), "c", "n", "item_id") == [
        ("A", 0, "A-R0002"), ("A", 1, "A-R0004"), ("A", 2, "A-R0005"), ("A", 3, "A-R0006"), ("B", 0, "B-R0001"),
    ]


def test_minting_random_gaps_against_a_loop(spark):
    import random

    random.seed(3)
    taken = sorted(random.sample(range(1, 60), 30))
    want, n, left = [], 1, 40
    while left:
        if n not in taken:
            want.append(f"A-R{n:04d}")
            left -= 1
        n += 1
    new = spark.range(40).withColumn("c", F.lit("A"))
    used = spark.createDataFrame([(f"A-R{t:04d}",) for t in taken], "item_id string")
    assert [r["item_id"] for r in sequences.mint(new, "c", ["id"], used).orderBy("id").collect()] == want


def test_spread_numbers_are_those_of_a_window(spark, rows):
    df = spark.range(500).select((F.col("id") % 7 % 3).alias("k"), (F.col("id") * 37 % 500).alias("v")).withColumn("k", F.when(F.col("k") > 0, F.col("k")))
    want = rows(sequences.numbered(df, ["k"], ["v"], "n"))
    assert rows(sequences.numbered(df, ["k"], ["v"], "n", spread=9)) == want


def test_wide_suffixes(spark):
    rows = spark.createDataFrame([("A", 1)], "c string, n int")
    last = spark.createDataFrame([("A", 9999)], "c string, last bigint")
    assert sequences.mint_after(rows, last, "c", ["n"]).first()["item_id"] == "A-R10000"


def test_siblings(spark, rows):
    df = spark.createDataFrame([("f", "f-R0002"), ("f", "f-R0001"), ("g", "g-R0001")], "p string, i string")
    assert rows(sequences.siblings(df, "p", "i"), "i", "position", "total", "previous", "next") == [
        ("f-R0001", 1, 2, None, "f-R0002"), ("f-R0002", 2, 2, "f-R0001", None), ("g-R0001", 1, 1, None, None),
    ]


def test_family_tags_repeat_over_rows_only(spark):
    df = spark.createDataFrame([("f", 1, ["art", "art", "ab"]), ("f", 2, ["art", "war"])], "f string, p int, t array<string>")
    words = spark.createDataFrame([("art", "Art", "Kunst")], "he string, en string, de string")
    tags = sequences.family_tags(df, "f", "p", F.col("t"), words).first()["tags"]
    assert [tuple(t) for t in tags] == [("art", "Art", "Kunst"), ("art", "Art", "Kunst"), ("war", "war", "war")]


def test_first_wins_outcomes(spark, rows):
    df = spark.createDataFrame([(1, 1, "-"), (1, 2, "x_1"), (1, 3, "a"), (1, 4, "b"), (1, 5, "tba")], "k int, p int, v string")
    from catalith.functions.predicates import is_auto_number, is_placeholder

    got = sequences.classify_first_wins(df, "k", "p", is_placeholder(F.col("v")), is_auto_number(F.col("v")))
    assert [o for _, o in rows(got, "p", "outcome")] == ["bad", "auto", "insert", "duplicate", "bad"]


def test_mode_ties_go_to_the_first(spark, rows):
    df = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 3), ("k", "b", 4), ("k", None, 0)], "k string, v string, p int")
    assert rows(aggregates.mode(df, "k", "v", "p")) == [("k", "b", 2)]


def test_duplicates_count_distinct_ids(spark, rows):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3), ("b", 4)], "k string, i int")
    assert rows(aggregates.duplicates(df, "k", "i")) == [("b", 3, 2, 4)]


def test_class_routing(spark, rows):
    classes = spark.createDataFrame([("A",), ("B",), ("MISC",)], "class string")
    items = spark.createDataFrame([(1, "A|B"), (2, "|B | A|A"), (3, "x"), (4, None), (5, " ")], "i int, c string")
    got = vocab.route_classes(items, "i", "c", classes)
    assert rows(got, "i", "primary", "extras", "unmapped") == [
        (1, "A", ["B"], False), (2, "B", ["A", "A"], False), (3, "MISC", [], True), (4, "MISC", [], True), (5, "MISC", [], True),
    ]
    assert vocab.route_classes(items, "i", "c", classes, blank="skip").count() == 3
    assert sum(r["rows"] for r in vocab.manifest(got, classes).collect()) == 5


def test_vocabulary(spark, rows):
    words = spark.createDataFrame([("a",)], "entry string")
    more = spark.createDataFrame([(" b ",), ("b",), ("",), ("a",)], "entry string")
    once = vocab.extend(words, more)
    assert rows(once) == [("a",), ("b",)] == rows(vocab.extend(once, more))
    assert vocab.bilingual(["x|y|z", "x|y|z", "w"]) == [("x", "y|z"), ("w", "")]


def test_locales(spark, rows):
    df = spark.createDataFrame(
        [("a", None, "u", 2), ("a", "DE-at", "d", 3), ("b", "he", "h", 1), ("c", "", "u1", 2), ("c", None, "u0", 1), ("c", "en", "e", 0)],
        "k string, lang string, value string, pos int",
    )
    assert rows(localise.pick_local(df, "de", ["k"], "TBA")) == [("a", "d"), ("b", "TBA"), ("c", "u0")]
    assert rows(localise.pick_local(df, "de", ["k"])) == [("a", "d"), ("b", None), ("c", "u0")]
    assert rows(localise.render_list(df, "de", ["k"], "TBA")) == [("a", 1, "u"), ("a", 2, "d"), ("b", 1, "TBA"), ("c", 1, "u0"), ("c", 2, "u1")]
    assert rows(localise.translation_gaps(df, ["en", "he"], ["k"])) == [("a", "en"), ("a", "he"), ("b", "en"), ("c", "he")]


@pytest.mark.parametrize(
    "args, want", [((None, None), "en"), (("DE", None), "de"), (("fr", "de"), "en"), (("", "he"), "en"), (("", "he", True), "he"), ((None, "he"), "he")]
)
def test_resolve_locale(args, want):
    assert localise.resolve_locale(*args) == want
    assert localise.text_direction("he") == "rtl"


def test_gap_fill_takes_the_first_filled_candidate(spark, rows):
    new = spark.createDataFrame([(1, "he", " ", 0), (1, "he", "b", 1), (1, "he", "c", 2), (1, "de", "d", 3), (2, "en", "e", 4)], "resource_id int, lang string, value string, pos int")
    have = spark.createDataFrame([(1, "DE"), (2, None)], "resource_id int, lang string")
    assert rows(reconcile.fill_gaps(new, have), "resource_id", "lang", "value") == [(1, "he", "b"), (2, "en", "e")]


def test_redirects(spark, rows):
    links = spark.createDataFrame(
        [(1, 7, "snap", "l"), (2, None, "http://h/items/7/?x=1", "l"), (3, None, "http://h/items/x", None), (4, 9, "u", "k"), (5, None, None, None)],
        "resource_id int, value_resource_id bigint, uri string, label string",
    )
    moved = spark.createDataFrame([(7, 70), (70, 700)], "old bigint, new bigint")
    got = reconcile.redirect(links, moved, "http://h")
    assert rows(got, "resource_id", "value_resource_id", "uri", "label", "changed") == [
        (1, 70, None, None, True), (2, None, "http://h/items/70", "l", True), (3, None, "http://h/items/x", None, False), (4, 9, "u", "k", False), (5, None, None, None, False),
    ]


def test_first_decodable_child(spark, rows):
    links = spark.createDataFrame([(1, 0, 10), (1, 1, 11), (1, 2, 12)], "resource_id int, pos int, child int")
    ids = spark.createDataFrame([(10, "x"), (11, "P-1"), (12, "Q-1")], "child int, identifier string")
    parent = F.nullif(F.regexp_extract("identifier", "^([PQ])-", 1), F.lit(""))
    assert rows(reconcile.first_parent(links, ids, parent)) == [(1, "P")]


def test_values(spark, rows):
    items = spark.createDataFrame([("i1", " t ", None, "e")], "item_id string, title string, item_description string, english_translation string")
    got = values.wide_to_values(items, "item_id")
    assert rows(got, "term", "lang", "value", "property_id") == [
        ("dcterms:identifier", None, "i1", 10), ("dcterms:title", None, "t", 1), ("ric-o:generalDescription", None, "e", 3502),
    ]
    table = spark.createDataFrame([literal(1, "a:x", 0, ""), literal(1, "a:y", 0, "v"), literal(1, "a:y", 1, "w", "de")], VALUE)
    assert rows(values.count_properties(table)) == [(1, 1)]
    resources = spark.createDataFrame([(1, 5, 2, [3], None, "2020")], "id bigint, class_id int, template_id int, item_sets array<int>, media array<int>, created string")
    assert values.payload(table, resources).first()["values"]["a:y"][1]["value"] == "w"
    assert rows(values.summarise(resources, table, "a:y"), "id", "media", "n_properties", "title") == [(1, 0, 1, "v")]


def test_merge_keeps_and_adds(spark, rows):
    table = spark.createDataFrame(
        [literal(1, "a:t", 0, "x"), literal(1, "a:t", 1, "y"), literal(1, "o:z", 0, "no"), literal(2, "a:t", 0, "x", "de"), literal(2, "a:t", 1, "y"), literal(3, "a:t", 0, "z")], VALUE
    )
    pairs = spark.createDataFrame([(1, 2), (3, 3)], "old bigint, new bigint")
    plan = changes.merge_pairs(table, pairs)
    done = changes.apply(table, plan)
    want = [(2, 0, "de", "x"), (2, 1, None, "y"), (2, 2, None, "x"), (3, 0, None, "z")]
    assert rows(done, "resource_id", "pos", "lang", "value") == want
    assert rows(changes.apply(done, plan), "resource_id", "pos", "lang", "value") == want


def test_updates_leave_other_values_alone(spark, rows):
    table = spark.createDataFrame([literal(1, "a:t", 0, "x"), literal(1, "a:u", 0, "y"), literal(2, "a:t", 0, "z")], VALUE)
    update = changes.change(spark.createDataFrame([literal(1, "a:t", 0, "X")], VALUE), "update")
    gone = changes.change(spark.createDataFrame([literal(2, "a:t", 0, None)], VALUE), "delete")
    assert rows(changes.apply(table, update.unionByName(gone)), "resource_id", "term", "value") == [(1, "a:t", "X"), (1, "a:u", "y")]


def test_titles(spark, rows):
    data = spark.createDataFrame([(i, "Art א", "Art", "א", i) for i in (1, 2, 3)], "resource_id bigint, bilingual string, latin string, hebrew string, pos int")
    titles = spark.createDataFrame([(10, 1, "", "Art א"), (11, 1, None, "Art א"), (20, 2, "en", "Art"), (30, 3, "he", "א")], "value_id bigint, resource_id bigint, lang string, value string")
    assert rows(changes.relabel_titles(data, titles)) == [
        ("insert", 1, None, "en", "Art"), ("insert", 2, None, "he", "א"), ("insert", 3, None, "en", "Art"), ("update", 1, 10, "he", "א"),
    ]


def test_sets_and_classes(spark, rows):
    df = spark.createDataFrame([(1, 23, [5]), (2, 23, None), (3, 9, [1])], "id int, class_id int, item_sets array<int>")
    once = changes.add_set(df, F.col("class_id") == 23, 5)
    assert rows(once, "id", "item_sets") == [(1, [5]), (2, [5]), (3, [1])] == rows(changes.add_set(once, F.col("class_id") == 23, 5), "id", "item_sets")
    assert rows(changes.reclass(df, F.col("id") == 3, 7), "id", "class_id") == [(1, 23), (2, 23), (3, 7)]
    assert df.select(values.union_sets(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2), F.lit(2)))).first()[0] == [1, 2, 2]


def test_edits_and_script(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    log = spark.createDataFrame([(1, "delete", None, 1), (2, "modify", "x", 1), (2, "modify", "y", 2), (4, "add", "n", 1)], "k int, op string, v string, pos int")
    assert rows(changes.edit(df, log, "k")) == [(2, "y"), (3, "c"), (4, "n")]
    plan = spark.createDataFrame([("insert", 1, None, "en", "it's"), ("update", 1, 9, "he", "x")], "op string, resource_id bigint, value_id bigint, lang string, value string")
    lines = [r["line"] for r in changes.sql_script(plan, F.lit(1)).collect()]
    assert lines[0] == "START TRANSACTION;" and lines[1].startswith("UPDATE") and "it''s" in lines[2] and lines[3] == "COMMIT;"


def test_ask_survives_a_failing_model(spark, rows):
    def model(messages):
        if "bad" in messages:
            raise RuntimeError
        return ['{"title":"T"}' for _ in messages]

    df = spark.createDataFrame([(1, "good")], "k int, m string").unionByName(spark.createDataFrame([(2, "bad")], "k int, m string"))
    got = parse.ask(df, F.col("m"), model, ["title"])
    assert rows(got.select("k", "reply.ok", "reply.title")) == [(1, True, "T"), (2, False, "")]
    assert rows(batches.outcome_counts(got, F.col("reply.ok"))) == [(1, 1)]


def test_parsing(spark, rows):
    df = spark.createDataFrame([(1, "General: all. One; two"), (2, None)], "k int, d string")
    assert rows(parse.parse_items(df, "d"), "item_pos", "item_description", "is_general") == [(0, "General: all.", True), (1, "One;", False), (2, "two", False)]
    with pytest.raises(ValueError):
        parse.require_columns(df, "k", "x")
    with pytest.raises(ValueError):
        parse.require_columns(df, "k", "k")
    assert parse.requested({"title": True, "creation_place": True}) == ["creation_place", "title"]


def test_projection(spark):
    df = spark.createDataFrame([([float(i), 2.0 * i, 0.0],) for i in range(5)], "features array<float>")
    assert features.select_rectangle(features.project(df), -100, 100, -1, 1).count() == 5


def test_upserts(spark, rows):
    have = spark.createDataFrame([("u", None)], "uri string, label string")
    new = spark.createDataFrame([("u", None), ("u", "l"), ("u", "l")], "uri string, label string")
    once = batches.upsert_new(new, have, ["uri", "label"])
    assert rows(once) == [("u", "l")]
    assert batches.upsert_new(new, have.unionByName(once), ["uri", "label"]).count() == 0


def test_open_and_closed(spark, rows):
    records = spark.createDataFrame([("F-1-R0001",), ("F-2-R0001",)], "id string")
    folders = spark.createDataFrame([("F-1",), ("F-1",)], "folder string")
    assert rows(reconcile.open_and_closed(records, folders, "id")) == [("F-1-R0001", True), ("F-2-R0001", False)]


def test_rewritten_links_carry_all_values_of_a_property(spark, rows):
    table = spark.createDataFrame(
        [(1, "p:hasPart", 0, "resource", None, None, 7, None, None, True), (1, "p:hasPart", 1, "resource", None, None, 8, None, None, True), (2, "p:hasPart", 0, "resource", None, None, 8, None, None, True)],
        VALUE,
    )
    moved = spark.createDataFrame([(7, 70)], "old bigint, new bigint")
    plan = changes.rewrite_links(table, moved, "http://h")
    assert rows(plan, "op", "resource_id", "pos", "value_resource_id") == [("update", 1, 0, 70), ("update", 1, 1, 8)]
    assert rows(changes.apply(table, plan), "resource_id", "pos", "value_resource_id") == [(1, 0, 70), (1, 1, 8), (2, 0, 8)]
    assert rows(changes.redirects(moved, moved)) == [(7, 70)]


def test_constructors_headers_and_features(spark, rows):
    df = spark.createDataFrame([(1, " a ", b"xy")], "i bigint, s string, content binary")
    made = df.select(values.literal(F.col("s"), "de").alias("l"), values.uri(F.lit("u"), F.lit("n")).alias("u"), values.link(F.col("i")).alias("r"))
    assert rows(made.select("l.lang", "l.value", "u.uri", "u.label", "r.type", "r.value_resource_id")) == [("de", " a ", "u", "n", "resource", 1)]
    assert rows(values.fixed_header(df, {"s": "title", "none": "date"}, {"is_public": F.lit("true")})) == [("true", "a", "")]
    assert features.extract(df, lambda batch: [[float(len(x))] for x in batch]).first()["features"] == [2.0]
    table = spark.createDataFrame([literal(1, "a:t", 1, "y"), literal(1, "a:t", 0, "x")], VALUE)
    assert rows(values.by_property(table), "values") == [(["x", "y"],)]
    assert changes.insert_resources(table).where("op = 'insert'").count() == 2
    terms = spark.createDataFrame([("a:t",), ("a:u",)], "term string")
    assert rows(vocab.template_properties(terms, ["a:u"])) == [("a:t", False), ("a:u", True)]


def test_enriching_again_is_passed_over(spark, rows):
    mapping = spark.createDataFrame(
        [(1, "A", 1, "u"), (2, "A", 2, "v"), (3, "A", 3, "v"), (4, "NEW", 4, "u"), (5, "B", 5, "u"), (6, "B", 6, "u"), (7, "NEW", 7, "u"), (8, "C", 8, None)],
        "doc_id int, legacy_id string, pos int, uri string",
    )
    known = spark.createDataFrame([("A", 10), ("C", 11)], "identifier string, resource_id bigint")
    held = spark.createDataFrame([(10, "u", "x"), (10, "u", "x"), (10, "v", "other"), (11, None, "x")], "resource_id bigint, uri string, label string")
    want = [(1, "already", None), (2, "enrich", None), (3, "already", None), (4, "mint", 101), (5, "create", None), (6, "enrich_created", None), (7, "mint", 102), (8, "enrich", None)]
    for spread in (None, 3):
        assert rows(changes.enrich(mapping, known, 100, F.lit("x"), held, spread), "doc_id", "action", "number") == want
    plain = rows(changes.enrich(mapping, known, 100, F.lit("x")), "doc_id", "action")
    assert plain[:3] == [(1, "enrich"), (2, "enrich"), (3, "enrich")]


def test_one_address_under_two_labels(spark, rows):
    columns = "resource_id bigint, term string, pos int, type string, lang string, value string, value_resource_id bigint, uri string, label string, is_public boolean"
    table = spark.createDataFrame([(1, "a:s", 0, "uri", None, None, None, "u", "x", True)], columns)
    new = spark.createDataFrame([(1, "a:s", 0, "uri", None, None, None, "u", label, True) for label in ("x", "y", "y")], columns)
    done = changes.apply(table, changes.change(new, "insert"))
    assert rows(done, "pos", "uri", "label") == [(0, "u", "x"), (1, "u", "y")]


def test_the_last_of_several_updates_holds(spark, rows):
    table = spark.createDataFrame([literal(1, "a:t", 0, "x"), literal(1, "a:t", 1, "y"), literal(2, "a:t", 0, "z"), literal(3, "b:t", None, "n")], VALUE)
    one = changes.change(spark.createDataFrame([literal(1, "a:t", 0, "zzz"), literal(3, "b:t", None, "never")], VALUE), "update")
    two = changes.change(spark.createDataFrame([literal(1, "a:t", 0, "bbb")], VALUE), "update")
    pick = ("resource_id", "pos", "value")
    rest = [(1, 1, "y"), (2, 0, "z"), (3, None, "n")]
    assert rows(changes.apply(table, changes.in_order(one, two)), *pick) == [(1, 0, "bbb"), *rest]
    assert rows(changes.apply(table, changes.in_order(two, one)), *pick) == [(1, 0, "zzz"), *rest]
    seq = one.where("resource_id = 1").withColumn("seq", F.lit(5).cast("bigint")).unionByName(two.withColumn("seq", F.lit(9).cast("bigint")))
    assert rows(changes.apply(table, seq), *pick) == [(1, 0, "bbb"), *rest]
    # a deleted place stays deleted, and what is inserted comes after what is there, in order
    gone = changes.change(spark.createDataFrame([literal(1, "a:t", 0, None), literal(1, "a:t", 1, None)], VALUE), "delete")
    new = [changes.change(spark.createDataFrame([literal(1, "a:t", 0, v)], VALUE), "insert") for v in ("q", "b", "q", "z")]
    assert rows(changes.apply(table, changes.in_order(one, gone, *new)), *pick) == [(1, 0, "q"), (1, 1, "b"), (1, 2, "z"), (2, 0, "z"), (3, None, "n")]
    assert rows(changes.apply(table, changes.in_order(new[0], new[1])), *pick) == [(1, 0, "x"), (1, 1, "y"), (1, 2, "q"), (1, 3, "b"), *rest[1:]]


def test_changes_meet_values_in_all_shuffle_partitions(spark, rows):
    table = spark.createDataFrame([literal(k, "a:t", 0, "x") for k in range(40)] + [literal(None, "a:t", 0, "n"), literal(3, "a:u", None, "u")], VALUE)
    new = changes.change(spark.createDataFrame([literal(k, "a:t", 0, v) for k in range(50) for v in ("x", "y")], VALUE), "insert")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        done = changes.apply(table, new)
        assert done.rdd.getNumPartitions() >= 23
        want = [(k, "a:t", n, v) for k in range(50) for n, v in enumerate("xy")] + [(None, "a:t", 0, "n"), (3, "a:u", None, "u")]
        assert rows(done, "resource_id", "term", "pos", "value") == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    plan = [new.where("resource_id < 2"), changes.change(table.where("resource_id < 5 and pos = 0").withColumn("value", F.lit("z")), "update"), changes.change(table.where("resource_id = 4"), "delete")]
    got = rows(changes.apply(table.where("resource_id < 6"), changes.in_order(*plan)), "resource_id", "pos", "value")
    assert got == [(0, 0, "z"), (0, 1, "x"), (0, 2, "y"), (1, 0, "z"), (1, 1, "x"), (1, 2, "y"), (2, 0, "z"), (3, 0, "z"), (3, None, "u"), (5, 0, "x")]


def test_stored_tables_are_read_by_column(spark, rows):
    from catalith.session import stored

    table = spark.createDataFrame([literal(k, "a:t", 0, "x") for k in range(9)], VALUE)
    kept = stored(table)
    assert rows(kept) == rows(table) and kept.schema.simpleString() == table.schema.simpleString() and kept.inputFiles()
    assert "label" not in kept.select("resource_id")._jdf.queryExecution().executedPlan().toString()


def test_chains_of_redirects(spark, rows):
    def chain(ids, closed=False):
        return list(zip(ids, [*ids[1:], ids[0]] if closed else ids[1:], strict=False))

    ids = list(range(100, 170))
    pairs = chain([1, 2, 3, 4, 5, 6, 7]) + chain([20, 21, 22], True) + [(19, 20), (30, 31), (32, 31), (40, 40), (None, 5), (8, None)] + chain(ids) + [(31, 33)] * 2
    moved = spark.createDataFrame(pairs, "old long, new long")
    got = {r["old"]: (r["last"], r["hops"], r["status"]) for r in reconcile.resolve_chains(moved).collect()}
    want = {k: (7, 7 - k, "resolved") for k in range(1, 7)} | {k: (None, None, "cycle") for k in (19, 20, 21, 22)} | {30: (33, 2, "resolved"), 31: (33, 1, "resolved"), 32: (33, 2, "resolved")}
    assert got == want | {k: (169, 169 - k, "resolved") for k in ids[:-1]}
    placed = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (2, 9, 2), (3, 4, 9), (1, 2, 5)], "old long, new long, at int")
    assert rows(changes.followed(placed, "at")) == [(1, 9), (2, 9), (3, 4)]
    assert rows(changes.followed(placed)) == [(1, 4), (2, 9), (3, 4)]
    assert reconcile.resolve_chains(moved.limit(0)).count() == 0


def test_merges_and_links_follow_chains(spark, rows):
    table = spark.createDataFrame([literal(1, "a:t", 0, "x"), literal(2, "a:t", 0, "y"), literal(3, "a:t", 0, "z"), literal(8, "a:t", 0, "c")], VALUE)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (8, 9), (9, 8)], "old long, new long")
    done = changes.apply(table, changes.merge_pairs(table, pairs, follow=True))
    assert rows(done, "resource_id", "value") == [(3, "x"), (3, "y"), (3, "z"), (8, "c")]
    link = spark.createDataFrame([(5, "a:l", 0, "resource", None, None, 1, None, None, True)], VALUE)
    plan = changes.rewrite_links(link, pairs, "http://h", follow=True)
    assert rows(changes.apply(link, plan), "resource_id", "value_resource_id") == [(5, 3)]


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    from catalith.operators import reconcile as module

    rounds = []
    real = module.fixed
    monkeypatch.setattr(module, "fixed", lambda df: rounds.append(1) or real(df))
    moved = spark.range(300).select(F.col("id").alias("old"), (F.col("id") + 1).alias("new"))
    assert {r["last"] for r in module.resolve_chains(moved).collect()} == {300} and len(rounds) <= 11


def test_minting_among_taken_numbers_over_many_tasks(spark):
    """One collection with all rows: dealt over the tasks, equal to the window, and no window holds a collection."""
    new = spark.range(20_000).select(F.lit("A").alias("c"), (F.col("id") * 7919 % 20_011).alias("n")).unionByName(spark.createDataFrame([("B", 1), ("B", 2)], "c string, n long"))
    used = spark.range(15_000).select(F.format_string("A-R%04d", F.col("id") * F.col("id") % 17_001 + 1).alias("item_id")).unionByName(spark.createDataFrame([("B-R0001",), ("C-R0009",)], "item_id string"))
    dealt = sequences.mint(new, "c", ["n"], used, spread=8)
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, sequences.mint(new, "c", ["n"], used).collect()))
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows) and dealt.count() == 20_002


def test_highest_so_far(spark):
    data = [(k % 3 if k % 7 else None, k * 31 % 97, None if k % 2 else k * 53 % 89) for k in range(97)]
    df = spark.createDataFrame(data, "k int, o int, v int")
    pick = lambda spread: sorted(map(tuple, sequences.highest_so_far(df, ["k"], ["o"], "v", "m", spread).collect()), key=repr)
    assert pick(None) == pick(5)


def test_starting_with_any_prefix(spark, rows):
    values = [(1, "abc"), (2, "abd"), (3, "b"), (4, ""), (5, None), (6, "äöü"), (7, "abc"), (8, "a%c")]
    df = spark.createDataFrame(values, "id int, v string")
    prefixes = ["a", "ab", "abc", "abcd", "", None, "äö", "a%", "ab"]
    wanted = spark.createDataFrame([(p,) for p in prefixes], "p string")
    found = reconcile.starting_with(df, "v", wanted, "p")
    want = sorted(((p, i) for p in {q for q in prefixes if q is not None} for i, v in values if v is not None and v.startswith(p)), key=repr)
    assert rows(found, "p", "id") == want and found.columns == ["p", "id", "v"]
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert rows(reconcile.starting_with(df, "v", wanted, "p", 1).where("p = 'ab'"), "v") == [("abc",)]
    none = wanted.where("p = 'x'")
    assert reconcile.starting_with(df, "v", none, "p").count() == reconcile.starting_with(df.where("id < 0"), "v", wanted, "p").count() == 0


def test_first_of_a_prefix_without_a_window_that_holds_it(spark, rows):
    values = [None, "", "b", "zä"] + [f"{'ab'[k % 2]}{k % 7}{k % 5 * 'x'}" for k in range(300)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string").repartition(3)
    prefixes = ["", "a", "a1", "b3x", "z", "zä", "q", None, "b"]
    wanted = spark.createDataFrame([(p,) for p in prefixes], "p string")
    found = reconcile.starting_with(df, "v", wanted, "p", 20)
    want = [(p, v) for p in prefixes if p is not None for v in sorted(v for v in values if v is not None and v.startswith(p))[:20]]
    assert rows(found, "p", "v") == sorted(want, key=repr) and found.columns == ["p", "id", "v"]
    assert len(set(rows(found, "p", "id"))) == len(want)
    assert "partition by [p" not in found._jdf.queryExecution().toString().lower() and "windowspecdefinition(p#" not in found._jdf.queryExecution().toString()


def test_replies_held_to_a_schema(spark):
    from catalith.functions.json import held_to

    schema = {
        "properties": {"s": {"type": ["string", "null"]}, "n": {"type": "integer"}, "x": {"type": "number"}, "l": {"type": "array"}, "e": {"enum": ["a", 1, None, True]}, "m": {"type": ["string", "integer"]}},
        "required": ["s", "n"],
        "additionalProperties": False,
    }
    cases = [
        ('{"s": null, "n": 3, "x": 2, "l": [1, "b"], "e": "a", "m": 1}', [], (None, 3, 2.0, '[1,"b"]', '"a"', "1")),
        ('```json\n{"s": "é", "n": 3.0, "e": 1}\n```', [], ("é", 3, None, None, "1", None)),
        ('{"s": 1, "n": "3", "e": true}', [("s", "type"), ("n", "type")], (None, None, None, None, "true", None)),
        ('{"n": 3.5, "x": "2", "e": "b", "z": 1, "a.b": 2}', [("s", "missing"), ("n", "type"), ("x", "type"), ("e", "enum"), ("a.b", "unknown"), ("z", "unknown")], (None,) * 6),
        ("[1]", [(None, "object")], (None,) * 6),
        ('{"s": 1, "s": 2, "n": 1}', [(None, "object")], (None,) * 6),
        ("no", [(None, "object")], (None,) * 6),
        (None, [(None, "object")], (None,) * 6),
    ]
    df = spark.createDataFrame([(i, c[0], "kept") for i, c in enumerate(cases)], "id int, reply string, checked string")
    for row in held_to(df, "reply", schema, "out").collect():
        _, errors, value = cases[row["id"]]
        assert [tuple(e) for e in row["out"]["errors"]] == errors and tuple(row["out"]["value"]) == value, row
        assert row["out"]["ok"] == (not errors) and row["checked"] == "kept"
    with pytest.raises(ValueError):
        held_to(df, "reply", {"properties": {"s": {"type": "string", "minLength": 2}}})


def test_a_message_is_asked_once(spark, tmp_path):
    """Messages are counted by the files that the model leaves; a batch that raises is asked again."""
    log, cache = tmp_path / "asked", str(tmp_path / "cache")
    log.mkdir()

    def model(messages):
        if "bad" in messages and not (log / "mended").exists():
            raise RuntimeError
        for m in messages:
            (log / f"{m}-{len(list(log.iterdir()))}").touch()
        return [None if m == "mute" else f'{{"k": {len(m)}}}' for m in messages]

    schema = {"properties": {"k": {"type": "integer"}}, "required": ["k"]}

    def run(messages, name="m"):
        df = spark.createDataFrame([(i, m) for i, m in enumerate(messages)], "id int, text string").coalesce(1)
        found = parse.ask_once(df, F.col("text"), model, name, cache, schema).orderBy("id").collect()
        return [r["reply"]["value"]["k"] if r["reply"]["ok"] else None for r in found]

    def asked():
        return sorted(p.name.split("-")[0] for p in log.iterdir() if p.name != "mended")

    assert run(["aa", "aa", None, "b"]) == [2, 2, None, 1] and asked() == ["aa", "b"]
    assert run(["aa", "ccc"]) == [2, 3] and run(["ccc"]) == [3] and asked() == ["aa", "b", "ccc"]
    assert run(["bad"]) == [None]
    (log / "mended").touch()
    assert run(["bad", "mute"]) == [3, None] and run([]) == []
    assert run(["mute"]) == [None] and asked().count("mute") == 2
    assert run(["aa"], "other") == [2] and asked().count("aa") == 2


def test_distinct_events_keeps_each_once_within_the_watermark(spark, tmp_path):
    at = lambda hour: f"2024-01-01 {hour:02d}:00:00"
    parts = [[(1, at(1)), (1, at(1)), (2, at(2))], [(1, at(1)), (3, at(9))], [(2, at(2)), (4, at(9)), (3, at(9))]]
    schema, out = "event_id bigint, ts timestamp", str(tmp_path / "out")
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "event_id bigint, ts string").select("event_id", F.col("ts").cast("timestamp").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = batches.distinct_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4]  # the second 2 comes after the watermark
