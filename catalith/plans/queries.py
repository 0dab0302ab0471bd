"""One query per operator over the synthetic tables, with the SQL that gives the same rows.

Stand-ins: ``documents`` are item descriptions (source: collection, lang: value
language), ``labels`` an earlier run, ``conversations`` folders and turns,
``lineitem`` identifiers with natural duplicates, ``pages.url`` URI values,
``part`` and ``nation`` vocabularies, ``embeddings`` image features.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catalith.functions import dates, idents, predicates, text
from catalith.functions import json as jsonf
from catalith.operators import (
    aggregates,
    changes,
    compare,
    features,
    localise,
    neighbours,
    parse,
    reconcile,
    sequences,
    values,
    vocab,
)
from catalith.session import scratch, stored
from catalith.streaming import batches

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


class Tables:
    """Tables of a folder by name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            SQL[name] = sql
        return build

    return add


def big(c, name: str):
    return F.col(c).cast("bigint").alias(name) if isinstance(c, str) else c.cast("bigint").alias(name)


# --- sequences and minting ------------------------------------------------------


@query(
    "sibling_nav",
    """SELECT user_id, event_id, row_number() OVER w AS position, count(*) OVER (PARTITION BY user_id) AS total,
  lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
)
def sibling_nav(t):
    rows = sequences.siblings(t.events.select("user_id", "event_id"), "user_id", "event_id")
    return rows.withColumn("position", big("position", "position"))


@query(
    "mint_item_ids",
    """SELECT conv_id, turn, role, printf('C%d-R%04d', conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)) AS item_id FROM conversations""",
)
def mint_item_ids(t):
    rows = t.conversations.withColumn("collection", F.concat(F.lit("C"), F.col("conv_id").cast("string")))
    return sequences.mint(rows, "collection", ["turn", "role", "text"]).select("conv_id", "turn", "role", "item_id")


@query(
    "mint_free_ids",
    """WITH u AS (SELECT DISTINCT source, (d.doc_id % 23) + 1 AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
s AS (SELECT source, max(k) AS m FROM r GROUP BY source),
f AS (SELECT s.source, g.n, row_number() OVER (PARTITION BY s.source ORDER BY g.n) AS k FROM s, LATERAL (SELECT unnest(range(1, s.m + 24)) AS n) g
  WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.source = s.source AND u.n = g.n))
SELECT r.source, r.doc_id, printf('%s-R%04d', r.source, f.n) AS item_id FROM r JOIN f ON r.source = f.source AND r.k = f.k""",
)
def mint_free_ids(t):
    used = t.documents.join(t.labels.select("doc_id"), "doc_id").select(
        idents.record_id(F.col("source"), F.col("doc_id") % 23 + 1).alias("item_id")
    )
    return sequences.mint(t.documents.select("source", "doc_id"), "source", ["doc_id"], used)


@query("mint_free_spread", SQL["mint_free_ids"])
def mint_free_spread(t):
    """W1 among taken numbers, with no window that holds a source."""
    used = t.documents.join(t.labels.select("doc_id"), "doc_id").select(idents.record_id(F.col("source"), F.col("doc_id") % 23 + 1).alias("item_id"))
    return sequences.mint(t.documents.select("source", "doc_id"), "source", ["doc_id"], used, spread=16)


@query(
    "mint_continue",
    """WITH m AS (SELECT source, max(d.doc_id) AS last FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY source),
n AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id))
SELECT n.source, n.doc_id, printf('%s-R%04d', n.source, coalesce(m.last, 0) + k) AS item_id FROM n LEFT JOIN m ON n.source = m.source""",
)
def mint_continue(t):
    docs = t.documents.select("source", "doc_id")
    old = reconcile.only_listed(docs, t.labels, "doc_id").withColumn("item_id", idents.record_id(F.col("source"), F.col("doc_id")))
    new = reconcile.not_done(docs, t.labels, "doc_id")
    return sequences.mint_after(new, sequences.greatest_suffix("source", old), "source", ["doc_id"]).select("source", "doc_id", "item_id")


@query(
    "mint_spread",
    """SELECT source, doc_id, printf('%s-R%04d', source, row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS item_id FROM documents""",
)
def mint_spread(t):
    """W1 with the rows of a source dealt to several tasks."""
    return sequences.mint(t.documents.select("source", "doc_id"), "source", ["doc_id"], spread=16)


@query("first_wins", """WITH e AS (SELECT event_id, user_id, event_type, value < 0.1 AS bad, event_id % 7 = 0 AS auto FROM events),
s AS (SELECT *, coalesce(max((NOT bad AND NOT auto)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM e)
SELECT event_id, user_id, CASE WHEN bad THEN 'bad' WHEN auto THEN 'auto' WHEN seen = 1 THEN 'duplicate' ELSE 'insert' END AS outcome FROM s""")
def first_wins(t):
    return sequences.classify_first_wins(t.events, "user_id", "event_id", F.col("value") < 0.1, F.col("event_id") % 7 == 0).select("event_id", "user_id", "outcome")


@query("last_wins", """SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def last_wins(t):
    return sequences.last_wins(t.events.select("user_id", "event_id", "event_type"), "user_id", ["event_id"])


@query("last_by_key", """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def last_by_key(t):
    return aggregates.last_by_key(t.events.select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("page_offset", """SELECT doc_id, source, lang FROM documents ORDER BY source, doc_id LIMIT 25 OFFSET 50""")
def page_offset(t):
    return sequences.page(t.documents.select("doc_id", "source", "lang"), ["source", "doc_id"], 3)


@query("class_samples", """SELECT doc_id, source, lang AS class FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) = 1""")
def class_samples(t):
    rows = t.documents.withColumn("cell", F.concat("lang", F.lit("|x")))
    return sequences.sample_per_class(rows, "cell", "doc_id").select("doc_id", "source", "class")


@query(
    "top10_tags",
    """WITH w AS (SELECT p_brand AS family, p_partkey AS p, unnest(string_split(p_name, ' ')) AS he, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS i FROM part),
f AS (SELECT family, p, he, min(i) AS i FROM w GROUP BY family, p, he),
k AS (SELECT family, he, row_number() OVER (PARTITION BY family ORDER BY p, i) AS place FROM f WHERE length(he) > 2 AND length(he) < 50)
SELECT family, place, he, CASE WHEN he = 'red' THEN 'rouge' ELSE he END AS en FROM k WHERE place <= 10""",
)
def top10_tags(t):
    translations = t.spark.range(1).select(F.lit("red").alias("he"), F.lit("rouge").alias("en"), F.lit("rot").alias("de"))
    tags = sequences.family_tags(t.part, "p_brand", "p_partkey", F.split("p_name", " "), translations)
    return tags.select("family", F.posexplode("tags").alias("place", "tag")).select("family", (F.col("place") + 1).cast("bigint").alias("place"), "tag.he", "tag.en")


# --- reconciling ------------------------------------------------------------------


@query("missing_semi", """SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def missing_semi(t):
    return reconcile.only_listed(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("resume_anti", """SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def resume_anti(t):
    return reconcile.not_done(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("still_missing", """SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels""")
def still_missing(t):
    return reconcile.still_missing(t.documents, t.labels, "doc_id")


@query("in_both", """SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels""")
def in_both(t):
    return reconcile.in_both(t.documents.select("doc_id"), t.labels.select("doc_id"))


def _with_general(t, documents: DataFrame) -> DataFrame:
    said = t.conversations.where("role = 'user'").select(F.col("conv_id").alias("k"), F.struct("turn", "role", "text").alias("at"), "text")
    general = aggregates.join_texts(said, ["k"], "text", "at").select("k", F.md5("text").alias("general"))
    return reconcile.outer(documents.select(F.col("doc_id").alias("k"), "source"), general, "k")


@query(
    "outer_general",
    """WITH g AS (SELECT conv_id AS k, md5(string_agg(text, ' ' ORDER BY turn, role, text)) AS general FROM conversations WHERE role = 'user' GROUP BY conv_id),
i AS (SELECT doc_id AS k, source FROM documents)
SELECT coalesce(i.k, g.k) AS k, source, general FROM i FULL JOIN g ON i.k = g.k""",
)
def outer_general(t):
    return _with_general(t, t.documents)


@query("checkpoint_left", """SELECT d.doc_id, quality AS quality_processed, quality IS NULL AS todo FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def checkpoint_left(t):
    rows = reconcile.with_previous(t.documents.select("doc_id"), t.labels.select("doc_id", "quality"), "doc_id")
    return rows.withColumn("todo", predicates.needs_work(F.col("quality_processed").cast("string")))


@query(
    "resolve_identifiers",
    """WITH m AS (SELECT l_orderkey, arg_max(l_partkey, l_linenumber * 1000000 + l_suppkey) AS resource_id FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber, l_suppkey) l_orderkey, l_linenumber, l_suppkey, max(l_partkey) OVER (PARTITION BY l_orderkey, l_linenumber, l_suppkey) AS l_partkey FROM lineitem) GROUP BY l_orderkey)
SELECT o_orderkey, resource_id FROM orders JOIN m ON o_orderkey = l_orderkey WHERE resource_id <> 0""",
)
def resolve_identifiers(t):
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") * 1000000 + F.col("l_suppkey")).alias("pos")).agg(F.max("l_partkey").alias("resource_id"))
    return reconcile.resolve(t.orders.select("o_orderkey"), lines, "o_orderkey")[0]


@query("value_lookup", """SELECT n_name AS value, min(c_custkey) AS resource_id FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name""")
def value_lookup(t):
    held = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("resource_id"), F.lit("country").alias("term"), F.col("n_name").alias("value"))
    return reconcile.find_by_value(held, t.nation.select(F.col("n_name").alias("value")), "country")


@query(
    "derived_parent",
    """WITH r AS (SELECT DISTINCT printf('AB-001-G-F-%04d-%03d-R%04d', l_orderkey, l_suppkey % 1000, l_linenumber) AS id FROM lineitem),
k AS (SELECT printf('AB-001-G-F-%04d', o_orderkey) AS id FROM orders)
SELECT r.id AS identifier, k.id AS collection FROM r LEFT JOIN k ON regexp_replace(r.id, '-[0-9]{3}-R[0-9]+$', '') = k.id""",
)
def derived_parent(t):
    """Every order with its own id, of four digits or more."""
    records = t.lineitem.select(F.format_string("AB-001-G-F-%04d-%03d-R%04d", "l_orderkey", F.col("l_suppkey") % 1000, "l_linenumber").alias("identifier")).distinct()
    known = t.orders.select(F.format_string("AB-001-G-F-%04d", "o_orderkey").alias("id"))
    return reconcile.with_parents(records, known, "identifier").select("identifier", "collection")


@query(
    "prefix_children",
    """WITH c AS (SELECT DISTINCT printf('F%d-R%04d', l_orderkey, l_linenumber) AS child FROM lineitem), p AS (SELECT printf('F%d', o_orderkey) AS parent FROM orders)
SELECT parent, child FROM p JOIN c ON regexp_replace(child, '-R[0-9]+$', '') = parent AND starts_with(child, parent || '-R')""",
)
def prefix_children(t):
    records = t.lineitem.select(F.format_string("F%d-R%04d", "l_orderkey", "l_linenumber").alias("child")).distinct()
    return reconcile.children(t.orders.select(F.format_string("F%d", "o_orderkey").alias("parent")), records, "parent", "child")


_PREFIXES = "SELECT DISTINCT left(p_name, (p_partkey % 14)::INT) AS prefix FROM part"


def _prefixes(t) -> DataFrame:
    """Beginnings of part names, from none to thirteen characters long."""
    return t.part.select(F.expr("left(p_name, int(p_partkey % 14))").alias("prefix"))


@query("prefix_search", f"WITH w AS ({_PREFIXES}) SELECT prefix, p_partkey FROM w JOIN part ON starts_with(p_name, prefix)")
def prefix_search(t):
    return reconcile.starting_with(t.part.select("p_partkey", "p_name"), "p_name", _prefixes(t), "prefix").select("prefix", "p_partkey")


@query(
    "prefix_first",
    f"""WITH w AS ({_PREFIXES}), v AS (SELECT p_name || ' ' || p_partkey AS name FROM part)
SELECT prefix, name FROM w JOIN v ON starts_with(name, prefix) QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY name) <= 200""",
)
def prefix_first(t):
    """At most 200 for each prefix, as the catalogue lists them."""
    names = t.part.select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"))
    return reconcile.starting_with(names, "name", _prefixes(t), "prefix", 200).select("prefix", "name")


@query(
    "prefix_sections",
    r"""WITH w AS (SELECT DISTINCT regexp_extract(url, '^([^/]*//[^/]*/)', 1) AS section FROM pages UNION SELECT regexp_extract(url, '^(.*/)', 1) FROM pages)
SELECT section, page_id FROM w JOIN pages ON starts_with(url, section)""",
)
def prefix_sections(t):
    """The pages below each host and each folder of an address."""
    sections = F.array(F.regexp_extract("url", "^([^/]*//[^/]*/)", 1), F.regexp_extract("url", "^(.*/)", 1))
    wanted = t.pages.select(F.explode(sections).alias("section"))
    return reconcile.starting_with(t.pages.select("page_id", "url"), "url", wanted, "section").select("section", "page_id")


@query("items_lacking", """SELECT c_custkey AS id FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%')""")
def items_lacking(t):
    held = t.orders.select(F.col("o_custkey").alias("resource_id"), F.lit("id").alias("term"), F.when(F.col("o_orderpriority").startswith("1"), F.col("o_orderpriority")).alias("value"))
    return reconcile.lacking(t.customer.select(F.col("c_custkey").alias("id")), held, "id")


@query(
    "gap_fill",
    """WITH c AS (SELECT doc_id % 50 AS resource_id, lang, source AS value, doc_id AS pos FROM documents), p AS (SELECT DISTINCT d.doc_id % 50 AS resource_id, lang FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0)
SELECT resource_id, lang, value, pos FROM c WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.resource_id = c.resource_id AND p.lang = c.lang) QUALIFY row_number() OVER (PARTITION BY resource_id, lang ORDER BY pos) = 1""",
)
def gap_fill(t):
    rows = t.documents.select((F.col("doc_id") % 50).alias("resource_id"), "lang", F.col("source").alias("value"), F.col("doc_id").alias("pos"))
    have = rows.join(t.labels.where("quality = 0").select(F.col("doc_id").alias("pos")), "pos").select("resource_id", "lang")
    return reconcile.fill_gaps(rows, have).select("resource_id", "lang", "value", "pos")


@query(
    "link_rewrite",
    r"""WITH v AS (SELECT page_id AS resource_id, CASE WHEN page_id % 2 = 0 THEN page_id END AS value_resource_id, CASE WHEN page_id % 2 = 1 THEN 'http://h/items/' || page_id || CASE WHEN page_id % 3 = 0 THEN '?x=1' WHEN page_id % 3 = 1 THEN '/' ELSE '' END END AS uri FROM pages),
k AS (SELECT *, coalesce(value_resource_id, try_cast(rtrim(split_part(substr(uri, 16), '?', 1), '/') AS BIGINT)) AS target FROM v)
SELECT resource_id, CASE WHEN value_resource_id IS NOT NULL AND target % 5 = 0 THEN target + 100000 ELSE value_resource_id END AS value_resource_id,
  CASE WHEN uri IS NOT NULL AND target % 5 = 0 THEN 'http://h/items/' || (target + 100000) ELSE uri END AS uri, target % 5 = 0 AS changed FROM k""",
)
def link_rewrite(t):
    even, rest = F.col("page_id") % 2 == 0, F.col("page_id") % 3
    tail = F.when(rest == 0, "?x=1").when(rest == 1, "/").otherwise("")
    links = t.pages.select(
        F.col("page_id").alias("resource_id"),
        F.when(even, F.col("page_id")).alias("value_resource_id"),
        F.when(~even, F.concat(F.lit("http://h/items/"), F.col("page_id").cast("string"), tail)).alias("uri"),
        F.lit(None).cast("string").alias("label"),
    )
    moved = t.pages.where("page_id % 5 = 0").select(F.col("page_id").alias("old"), (F.col("page_id") + 100000).alias("new"))
    return reconcile.redirect(links, moved, "http://h").select("resource_id", "value_resource_id", "uri", "changed")


@query(
    "first_child_parent",
    """SELECT o_custkey AS resource_id, arg_min('P' || (l_partkey % 100), l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS parent
FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey % 3 = 0 GROUP BY o_custkey""",
)
def first_child_parent(t):
    links = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_custkey").alias("resource_id"), (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("pos"), F.col("l_partkey").alias("child")
    )
    known = t.part.select(F.col("p_partkey").alias("child"), F.concat(F.when(F.col("p_partkey") % 3 == 0, "G").otherwise("x"), (F.col("p_partkey") % 100).cast("string")).alias("identifier"))
    code = F.regexp_extract("identifier", "^G([0-9]+)$", 1)
    return reconcile.first_parent(links, known, F.when(code != "", F.concat(F.lit("P"), code)))


@query(
    "open_closed",
    """WITH r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)
SELECT printf('F%d-R%04d', l_orderkey, l_linenumber) AS identifier, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'O') AS is_open FROM r""",
)
def open_closed(t):
    records = t.lineitem.select(F.format_string("F%d-R%04d", "l_orderkey", "l_linenumber").alias("identifier")).distinct()
    folders = t.orders.where("o_orderstatus = 'O'").select(F.format_string("F%d", "o_orderkey").alias("folder"))
    return reconcile.open_and_closed(records, folders, "identifier")


@query(
    "collection_themes",
    """SELECT printf('X-G-F-%d', n_nationkey) AS id, r_name AS theme FROM nation LEFT JOIN region ON n_nationkey = r_regionkey""",
)
def collection_themes(t):
    themes = t.region.select(F.format_string("G-F-%d", "r_regionkey").alias("family"), F.col("r_name").alias("theme"))
    return reconcile.with_themes(t.nation.select(F.format_string("X-G-F-%d", "n_nationkey").alias("id")), themes, "id")


@query("counters", """SELECT count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS high, count(*) FILTER (user_id IS NULL) AS anonymous FROM events""")
def counters(t):
    return reconcile.counters(t.events, clicks=F.col("event_type") == "click", high=F.col("value") > 50, anonymous=F.col("user_id").isNull())


@query("append_tables", """SELECT n_nationkey::BIGINT AS id, n_name AS name, NULL::VARCHAR AS mark FROM nation UNION ALL SELECT r_regionkey::BIGINT, NULL, r_name FROM region""")
def append_tables(t):
    return reconcile.append(t.nation.select(big("n_nationkey", "id"), F.col("n_name").alias("name")), t.region.select(big("r_regionkey", "id"), F.col("r_name").alias("mark")))


@query("first_of_each", """SELECT l_orderkey, min(l_partkey * 100000 + l_suppkey) AS pos FROM lineitem GROUP BY l_orderkey""")
def first_of_each(t):
    return reconcile.first_of_each(t.lineitem.select("l_orderkey", (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("pos")), "l_orderkey", "pos")


# --- duplicates --------------------------------------------------------------------


@query("dup_groups", """SELECT md5(text) AS k, count(DISTINCT doc_id) AS n, min(doc_id) AS oldest, max(doc_id) AS newest FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) > 1""")
def dup_groups(t):
    return aggregates.duplicates(t.documents.select(F.md5("text").alias("k"), "doc_id"), "k", "doc_id")


@query("dup_ids", """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS ids FROM lineitem GROUP BY l_orderkey""")
def dup_ids(t):
    return aggregates.ids_by_key(t.lineitem, "l_orderkey", "l_suppkey").select("l_orderkey", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("exact_pairs", """SELECT md5(text) AS k, min(doc_id) AS old, max(doc_id) AS new FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) = 2""")
def exact_pairs(t):
    return aggregates.exact_pairs(t.documents.select(F.md5("text").alias("k"), "doc_id"), "k", "doc_id")


_BUCKET = "CASE WHEN {0} < 5000 THEN '<5000' WHEN {0} < 6000 THEN '5000s' WHEN {0} < 7000 THEN '6000s' WHEN {0} < 7630 THEN 'early-7000s' ELSE 'session-7000s' END"


@query(
    "dup_patterns",
    f"""WITH d AS (SELECT min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(DISTINCT l_orderkey) > 1)
SELECT {_BUCKET.format('a')} AS older, {_BUCKET.format('b')} AS newer, count(*) AS n FROM d GROUP BY 1, 2""",
)
def dup_patterns(t):
    pairs = aggregates.duplicates(t.lineitem.select(F.concat_ws(".", "l_partkey", "l_suppkey").alias("k"), "l_orderkey"), "k", "l_orderkey")
    return aggregates.pattern_counts(pairs, predicates.id_bucket(F.col("oldest")), predicates.id_bucket(F.col("newest")))


@query(
    "dup_classes",
    """WITH d AS (SELECT l_partkey, min(l_orderkey) AS a, max(l_orderkey) AS b FROM lineitem GROUP BY l_partkey)
SELECT CASE WHEN a >= 7630 THEN 'session' WHEN a < 5000 AND b >= 6000 AND b < 7630 THEN 'old_vs_2025' WHEN b < 5000 THEN 'legacy' ELSE 'other' END AS kind, count(*) AS n FROM d GROUP BY 1""",
)
def dup_classes(t):
    pairs = t.lineitem.groupBy("l_partkey").agg(F.min("l_orderkey").alias("a"), F.max("l_orderkey").alias("b"))
    return pairs.groupBy(predicates.pair_class(F.col("a"), F.col("b")).alias("kind")).agg(F.count("*").alias("n"))


@query("keep_newest", """SELECT md5(text) AS k, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id DESC) > 1""")
def keep_newest(t):
    return sequences.older_than_newest(t.documents.select(F.md5("text").alias("k"), "doc_id"), "k", "doc_id")


@query("dup_samples", """SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents QUALIFY place <= 3""")
def dup_samples(t):
    return sequences.top_per_key(t.documents.select("source", "doc_id"), "source", ["doc_id"], 3).withColumn("place", big("place", "place"))


_VALUES = """v AS (SELECT DISTINCT l_orderkey AS resource_id, 'ex:part' AS term, 'p' || (l_partkey % 40) AS value, CASE WHEN l_suppkey % 3 > 0 THEN 'l' || l_suppkey % 3 END AS lang FROM lineitem)"""


def _line_values(t) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("resource_id"),
        F.concat(F.lit("p"), (F.col("l_partkey") % 40).cast("string")).alias("value"),
        F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("l"), (F.col("l_suppkey") % 3).cast("string"))).alias("lang"),
    )
    # Copies stand together in the order of places, so one sort serves to drop them and to number the others.
    copy = F.row_number().over(Window.partitionBy("resource_id", "value", "lang").orderBy("value", "lang"))
    place = F.dense_rank().over(Window.partitionBy("resource_id").orderBy("value", "lang")) - 1
    parts = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "resource_id").withColumn("_copy", copy).withColumn("pos", place).where("_copy = 1")
    return changes.change(rows.withColumns({"term": F.lit("ex:part"), "type": F.lit("literal")}), "insert").drop("op")


@query(
    "merge_values",
    f"""WITH {_VALUES}, n AS (SELECT resource_id AS pair, value, lang FROM v WHERE resource_id % 2 = 0), o AS (SELECT resource_id + 1 AS pair, value, lang FROM v WHERE resource_id % 2 = 1)
SELECT pair, value, lang, false AS added FROM n UNION ALL SELECT pair, value, lang, true FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.pair = o.pair AND n.value = o.value AND n.lang IS NOT DISTINCT FROM o.lang)""",
)
def merge_values(t):
    """All orders: the values of each even one, and what the odd one before it has alone."""
    rows = _line_values(t)
    newer = rows.where("resource_id % 2 = 0").withColumn("pair", F.col("resource_id"))
    older = rows.where("resource_id % 2 = 1").withColumn("pair", F.col("resource_id") + 1)
    return values.union_values(newer, older).select("pair", "value", "lang", "added")


@query(
    "merge_pairs",
    f"""WITH {_VALUES}, k AS (SELECT DISTINCT resource_id AS id FROM v), p AS (SELECT a.id AS old, b.id AS new FROM k a JOIN k b ON b.id = a.id + 1 WHERE a.id % 2 = 1),
n AS (SELECT resource_id, value, lang FROM v WHERE NOT EXISTS (SELECT 1 FROM p WHERE old = resource_id)), o AS (SELECT new AS resource_id, value, lang FROM v JOIN p ON old = resource_id)
SELECT resource_id, value, lang FROM n UNION ALL SELECT resource_id, value, lang FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.resource_id = o.resource_id AND n.value = o.value AND n.lang IS NOT DISTINCT FROM o.lang)""",
)
def merge_pairs(t):
    """All orders: each odd one merged into the even one after it, where both are present."""
    rows = stored(_line_values(t))
    ids = rows.select("resource_id").distinct()
    new = ids.select(F.col("resource_id").alias("new"), (F.col("resource_id") - 1).alias("old"))
    pairs = ids.where("resource_id % 2 = 1").withColumnRenamed("resource_id", "old").join(new, "old")
    return changes.apply(rows, stored(changes.merge_pairs(rows, pairs))).select("resource_id", "value", "lang")


@query("union_sets", """SELECT o_custkey, array_to_string(list_concat(n, list_filter(o, lambda x: NOT list_contains(n, x))), ',') AS sets FROM (
  SELECT o_custkey, coalesce(list_sort(list(o_orderkey % 7) FILTER (o_orderkey % 2 = 0)), []) AS n, coalesce(list_sort(list(o_orderkey % 7) FILTER (o_orderkey % 2 = 1)), []) AS o FROM orders GROUP BY o_custkey)""")
def union_sets(t):
    bit = F.col("o_orderkey") % 7
    rows = t.orders.groupBy("o_custkey").agg(
        F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 2 == 0, bit))).alias("n"), F.sort_array(F.collect_list(F.when(F.col("o_orderkey") % 2 == 1, bit))).alias("o")
    )
    return rows.select("o_custkey", F.array_join(F.transform(values.union_sets(F.col("n"), F.col("o")), lambda x: x.cast("string")), ",").alias("sets"))


# --- vocabularies and classes ----------------------------------------------------------

_ROUTE = """c AS (SELECT DISTINCT p_type AS class FROM part WHERE p_size < 25 AND p_partkey % 2 = 0), r AS (SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' WHEN p_size % 4 = 1 THEN p_type || '|' || p_brand WHEN p_size % 4 = 2 THEN '|' || p_brand || ' | ' || p_type ELSE p_type || '|' || p_type END AS raw FROM part),
s AS (SELECT p_partkey, raw, list_filter(list_transform(string_split(raw, '|'), lambda x: trim(x)), lambda x: x <> '' AND list_contains(known, x)) AS v FROM r, (SELECT list(class) AS known FROM c))"""


def _classes(t) -> DataFrame:
    return t.part.where("p_size < 25 and p_partkey % 2 = 0").select(F.col("p_type").alias("class")).distinct()


def _routed(t) -> DataFrame:
    k = F.col("p_size") % 4
    cell = (
        F.when(k == 0, "").when(k == 1, F.concat("p_type", F.lit("|"), "p_brand")).when(k == 2, F.concat(F.lit("|"), "p_brand", F.lit(" | "), "p_type"))
        .otherwise(F.concat("p_type", F.lit("|"), "p_type"))
    )
    return vocab.route_classes(t.part.select("p_partkey", cell.alias("cell")), "p_partkey", "cell", _classes(t))


@query("class_route", f"""WITH {_ROUTE} SELECT p_partkey, raw, coalesce(v[1], 'MISC') AS "primary", len(v) = 0 AS unmapped FROM s""")
def class_route(t):
    return _routed(t).select("p_partkey", "raw", "primary", "unmapped")


@query(
    "class_manifest",
    f"""WITH {_ROUTE} SELECT coalesce(v[1], 'MISC') AS class, count(*) AS rows, trim(regexp_replace(lower(coalesce(v[1], 'MISC')), '[^a-z0-9]+', '_', 'g'), '_') || '.csv' AS file FROM s GROUP BY 1, 3""",
)
def class_manifest(t):
    return vocab.manifest(_routed(t), _classes(t))


@query("composite_extras", f"""WITH {_ROUTE} SELECT p_partkey, v[1] AS primary_class, unnest(v[2:]) AS extra_class FROM s""")
def composite_extras(t):
    return vocab.composite_extras(_routed(t), "p_partkey")


@query("unmapped", f"""WITH {_ROUTE} SELECT p_partkey, raw AS raw_item_class FROM s WHERE len(v) = 0""")
def unmapped(t):
    return vocab.unmapped(_routed(t), "p_partkey")


@query("vocabulary_extend", """SELECT DISTINCT p_brand AS entry FROM part UNION SELECT DISTINCT c_mktsegment FROM customer""")
def vocabulary_extend(t):
    brands = t.part.select(F.col("p_brand").alias("entry")).distinct()
    return vocab.extend(brands, t.customer.select(F.concat(F.lit(" "), "c_mktsegment").alias("entry")))


@query("lookup_default", """SELECT r_regionkey::BIGINT AS id, CASE r_name WHEN 'ASIA' THEN 'Asien' WHEN 'EUROPE' THEN 'Europa' ELSE r_name END AS name FROM region""")
def lookup_default(t):
    return t.region.select(big("r_regionkey", "id"), vocab.lookup(F.col("r_name"), {"ASIA": "Asien", "EUROPE": "Europa"}).alias("name"))


@query("ensure_templates", """SELECT DISTINCT p_type AS label FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_partkey < 5)""")
def ensure_templates(t):
    have = t.part.where("p_partkey < 5").select(F.col("p_type").alias("label")).distinct()
    return vocab.ensure(have, t.part.select(F.col("p_type").alias("label")))


# --- values and locales ------------------------------------------------------------------


@query(
    "wide_to_eav",
    """SELECT c_custkey, term, lang, value FROM (
  SELECT c_custkey, 'dcterms:title' AS term, NULL::VARCHAR AS lang, c_name AS value FROM customer
  UNION ALL SELECT c_custkey, 'ric-o:generalDescription', 'he', c_mktsegment FROM customer
  UNION ALL SELECT c_custkey, 'ric-o:generalDescription', 'en', CASE WHEN c_nationkey % 2 = 0 THEN 'n' || c_nationkey END FROM customer) WHERE value IS NOT NULL""",
)
def wide_to_eav(t):
    items = t.customer.select(
        "c_custkey", F.col("c_name").alias("title"), F.concat(F.lit("  "), "c_mktsegment").alias("item_description"),
        F.when(F.col("c_nationkey") % 2 == 0, F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))).otherwise("  ").alias("english_translation"),
    )
    return values.wide_to_values(items, "c_custkey", english="en").select("c_custkey", "term", "lang", "value")


@query("nonempty_props", """SELECT s_suppkey AS resource_id, (1 + (s_acctbal > 0)::INT)::BIGINT AS n_properties FROM supplier""")
def nonempty_props(t):
    name = t.supplier.select(F.col("s_suppkey").alias("resource_id"), F.lit("a:name").alias("term"), F.col("s_name").alias("value"), F.lit(None).cast("string").alias("uri"))
    other = t.supplier.select(F.col("s_suppkey").alias("resource_id"), F.lit("a:url").alias("term"), F.lit("").alias("value"), F.when(F.col("s_acctbal") > 0, "u").alias("uri"))
    return values.count_properties(name.unionByName(other))


def _spoken(t) -> DataFrame:
    return t.documents.select((F.col("doc_id") % 97).alias("k"), F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(F.col("lang")).alias("lang"), F.col("source").alias("value"), F.col("doc_id").alias("pos"))


_SPOKEN = "v AS (SELECT doc_id % 97 AS k, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE lang END AS lang, source AS value, doc_id AS pos FROM documents)"


@query(
    "locale_pick",
    f"""WITH {_SPOKEN} SELECT k, coalesce(arg_min(value, pos) FILTER (lang = 'de'), arg_min(value, pos) FILTER (lang IS NULL), CASE WHEN bool_or(coalesce(lang, '') NOT IN ('', 'de')) THEN '[de TBA]' END) AS picked FROM v GROUP BY k""",
)
def locale_pick(t):
    return localise.pick_local(_spoken(t), "de", ["k"], "[de TBA]")


@query(
    "locale_render",
    f"""WITH {_SPOKEN}, s AS (SELECT k, value, row_number() OVER (PARTITION BY k ORDER BY (lang IS NOT NULL)::INT, pos) AS n FROM v WHERE lang IS NULL OR lang = 'de')
SELECT k, n, value FROM s UNION ALL SELECT DISTINCT k, 1, '[TBA]' FROM v WHERE k NOT IN (SELECT k FROM s)""",
)
def locale_render(t):
    return localise.render_list(_spoken(t), "de", ["k"], "[TBA]").withColumn("n", big("n", "n"))


@query("translation_gaps", f"""WITH {_SPOKEN}, e AS (SELECT DISTINCT k, unnest(['en', 'de', 'es', 'fr']) AS lang FROM v) SELECT k, lang FROM e WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.k = e.k AND v.lang = e.lang)""")
def translation_gaps(t):
    return localise.translation_gaps(_spoken(t), ["en", "de", "es", "fr"], ["k"])


@query("label_fallback", """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'de-' || n_name WHEN n_nationkey % 3 = 1 THEN 'en-' || n_name ELSE 'he-' || n_name END AS label FROM nation""")
def label_fallback(t):
    k = F.col("n_nationkey") % 3
    label = F.struct(
        F.when(k == 0, F.concat(F.lit("de-"), "n_name")).alias("de"), F.when(k <= 1, F.concat(F.lit("en-"), "n_name")).alias("en"), F.concat(F.lit("he-"), "n_name").alias("he")
    )
    return t.nation.select(big("n_nationkey", "id"), localise.label_fallback(label, "de").alias("label"))


@query("reverse_links", """SELECT 'part' AS term, l_orderkey AS resource_id FROM lineitem WHERE l_partkey = 7 ORDER BY 1, 2 LIMIT 10""")
def reverse_links(t):
    links = t.lineitem.select(F.lit("part").alias("term"), F.col("l_orderkey").alias("resource_id"), F.lit("resource:item").alias("type"), F.col("l_partkey").alias("value_resource_id"))
    return localise.reverse_links(links, F.lit(7), 1, 10)


@query("ui_texts", """SELECT n_name AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'de ' || n_name WHEN n_nationkey % 5 = 0 THEN 'en ' || n_name ELSE n_name END AS text FROM nation""")
def ui_texts(t):
    n = F.col("n_nationkey")
    words = t.nation.where(n % 2 == 0).select(F.lit("de").alias("lang"), F.col("n_name").alias("key"), F.concat(F.lit("de "), "n_name").alias("text"))
    words = words.unionByName(t.nation.where(n % 5 == 0).select(F.lit("en").alias("lang"), F.col("n_name").alias("key"), F.concat(F.lit("en "), "n_name").alias("text")))
    return localise.translate_ui(t.nation.select(F.col("n_name").alias("key")), words, "de")


@query("template_kinds", """SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'letter' WHEN 2 THEN 'doc_other' ELSE 'document' END AS kind FROM nation""")
def template_kinds(t):
    k = F.col("n_nationkey") % 4
    return t.nation.select(big("n_nationkey", "id"), predicates.template_kind(F.when(k == 0, "Images").when(k == 1, "EgoDocuments").when(k == 3, "Reports")).alias("kind"))


# --- aggregates ----------------------------------------------------------------------------


@query(
    "mode_name",
    """WITH c AS (SELECT p_brand, p_name, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1, 2) SELECT p_brand, p_name, n FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1""",
)
def mode_name(t):
    return aggregates.mode(t.part, "p_brand", "p_name", "p_partkey")


@query("status_breakdown", """SELECT user_id, event_type AS status, count(*) AS n FROM events GROUP BY 1, 2""")
def status_breakdown(t):
    return aggregates.status_breakdown(t.events, "user_id", "event_type").select("user_id", F.explode("statuses").alias("status", "n"))


@query("folder_ranking", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1""")
def folder_ranking(t):
    return aggregates.ranking(t.orders, "o_custkey")


@query("languages_of", """SELECT source AS resource_id, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY 1""")
def languages_of(t):
    return aggregates.languages(t.documents.select(F.col("source").alias("resource_id"), "lang")).select("resource_id", F.array_join("langs", ",").alias("langs"))


@query("running_tokens", """SELECT user_id, event_id, sum(event_id % 10) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used_so_far FROM events""")
def running_tokens(t):
    rows = t.events.select("user_id", "event_id", (F.col("event_id") % 10).alias("used"))
    return aggregates.running_totals(rows, "event_id", ["used"], ["user_id"]).drop("used")


@query("cached_share", """SELECT sum(event_id % 3)::BIGINT AS cached, sum(event_id % 10)::BIGINT AS total, 100 * sum(event_id % 3)::DOUBLE / greatest(1, sum(event_id % 10)) AS percent FROM events""")
def cached_share(t):
    return aggregates.cached_share(t.events.select((F.col("event_id") % 3).alias("a"), (F.col("event_id") % 10).alias("b")), "a", "b")


@query("per_class", """SELECT c_nationkey::BIGINT AS class_id, count(*) AS n, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 3""")
def per_class(t):
    return aggregates.per_class(t.customer.select(big("c_nationkey", "class_id")), t.nation.select(big("n_nationkey", "class_id"), F.col("n_name").alias("label")))


@query("first_filled", """SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) AS value FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1""")
def first_filled(t):
    rows = t.orders.select("o_custkey", F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("").alias("value"))
    return aggregates.first_filled(rows, ["o_custkey"])


@query("subject_list", """SELECT p_partkey, array_to_string(CASE WHEN p_brand = p_type THEN [p_brand] ELSE [p_brand, p_type] END, ';') AS subjects FROM part""")
def subject_list(t):
    lists = F.array(F.array("p_brand", F.lit("")), F.array("p_type", "p_brand"))
    return t.part.select("p_partkey", F.array_join(aggregates.distinct_in_order(lists), ";").alias("subjects"))


@query("average_tags", """SELECT avg(len(string_split(p_name, ' '))) AS average FROM part""")
def average_tags(t):
    return aggregates.average_size(t.part.select(F.split("p_name", " ").alias("tags")), "tags")


# --- texts, filters, dates, JSON ----------------------------------------------------------------


@query("meaningful", """SELECT doc_id, length(trim(s)) >= 3 AND lower(trim(s)) NOT IN ('n/a', 'na', 'none', 'null', 'tbd', 'pending', '-') AS ok FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ' Pending ' WHEN 1 THEN 'ab' WHEN 2 THEN source ELSE '  ' END AS s FROM documents)""")
def meaningful(t):
    k = F.col("doc_id") % 4
    cell = F.when(k == 0, " Pending ").when(k == 1, "ab").when(k == 2, F.col("source")).otherwise("  ")
    return t.documents.select("doc_id", predicates.is_meaningful(cell).alias("ok"))


@query("placeholder", """SELECT p_partkey, p_size % 3 = 0 AS bad, p_size % 3 = 1 AS auto FROM part""")
def placeholder(t):
    k = F.col("p_size") % 3
    cell = F.when(k == 0, " TBA").when(k == 1, F.concat("p_name", F.lit("_12"))).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", predicates.is_placeholder(cell).alias("bad"), predicates.is_auto_number(cell).alias("auto"))


@query("contains_any", """SELECT doc_id, contains(text, 'License') OR contains(text, 'reserved') AS hit FROM documents""")
def contains_any(t):
    return t.documents.select("doc_id", text.contains_any(F.col("text"), ["License", "reserved"]).alias("hit"))


@query("length_band", """SELECT p_partkey, p_name FROM part WHERE length(p_name) > 2 AND length(p_name) < 12 AND NOT contains(p_name, 'red')""")
def length_band(t):
    return t.part.where(predicates.in_length_band(F.col("p_name"), "red", 2, 12)).select("p_partkey", "p_name")


@query(
    "title_split",
    r"""WITH s AS (SELECT p_partkey, p_size % 6 AS k, p_name FROM part)
SELECT p_partkey, CASE WHEN k IN (0, 1) THEN p_name WHEN k = 4 THEN '-' || p_name WHEN k = 5 THEN ',' || p_name || '.' END AS latin,
CASE WHEN k IN (0, 2) THEN 'שלום ' || p_partkey WHEN k = 4 THEN 'שלום:' WHEN k = 5 THEN 'שלום;-' END AS hebrew FROM s""",
)
def title_split(t):
    """Mixed, Latin, Hebrew and other titles; those of the last two kinds begin and end with edge characters, which stay."""
    k, he = F.col("p_size") % 6, F.concat(F.lit("שלום "), F.col("p_partkey").cast("string"))
    title = F.when(k == 0, F.concat("p_name", F.lit(" - "), he)).when(k == 1, F.col("p_name")).when(k == 2, he)
    title = title.when(k == 4, F.concat(F.lit("-"), "p_name", F.lit(" - שלום:"))).when(k == 5, F.concat(F.lit(","), "p_name", F.lit(".;, שלום;-")))
    title = title.otherwise(F.col("p_partkey").cast("string"))
    return t.part.select("p_partkey", text.split_bilingual_title(title).alias("s")).select("p_partkey", "s.latin", "s.hebrew")


@query("route_ids", """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'collection' WHEN o_orderkey % 3 = 1 THEN 'folder' ELSE 'edge' END AS kind FROM orders""")
def route_ids(t):
    k = F.col("o_orderkey") % 3
    cell = F.when(k == 0, F.format_string("G-F-%04d", F.col("o_orderkey") % 10000)).when(k == 1, F.format_string("G-F-%04d-001", F.col("o_orderkey") % 10000))
    return t.orders.select("o_orderkey", predicates.route(cell, [("^G-F-[0-9]{4}$", "collection"), ("^G-F-[0-9]{4}-[0-9]{3}$", "folder")], "edge").alias("kind"))


@query("property_summary", """SELECT s_suppkey AS id, (s_acctbal > 0)::BIGINT + 1 AS n_properties, substring(s_name, 1, 60) AS title FROM supplier""")
def property_summary(t):
    resources = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit(None).cast("timestamp").alias("created"), F.array().cast("array<int>").alias("media"), F.array().cast("array<int>").alias("item_sets"), F.lit(1).alias("template_id"), F.lit(2).alias("class_id"))
    base = t.supplier.select(F.col("s_suppkey").alias("resource_id"), F.lit("dcterms:title").alias("term"), F.lit(0).alias("pos"), F.col("s_name").alias("value"), F.lit(None).cast("string").alias("uri"))
    more = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("resource_id"), F.lit("a:balance").alias("term"), F.lit(0).alias("pos"), F.col("s_acctbal").cast("string").alias("value"), F.lit(None).cast("string").alias("uri"))
    return values.summarise(resources, base.unionByName(more)).select("id", "n_properties", "title")


@query("slug", """SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part""")
def slug(t):
    return t.part.select("p_type").distinct().withColumn("slug", text.slug(F.col("p_type")))


@query("snippet", """SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS snippet FROM documents""")
def snippet(t):
    return t.documents.select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("url_host", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages""")
def url_host(t):
    return t.pages.select("page_id", text.url_host(F.col("url")).alias("host"))


@query(
    "url_language",
    """WITH u AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || '#part?x=1' ELSE url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'lang=he&xlang=1#lang=fr' END AS url FROM pages),
p AS (SELECT page_id, split_part(url, '#', 1) AS base, CASE WHEN contains(url, '#') THEN '#' || substring(url, position('#' IN url) + 1) ELSE '' END AS part FROM u)
SELECT page_id, CASE WHEN contains(base, 'lang=he') THEN replace(base, 'lang=he', 'lang=de') ELSE base || CASE WHEN contains(base, '?') THEN '&' ELSE '?' END || 'lang=de' END || part AS url FROM p""",
)
def url_language(t):
    """Every page; a third of the URLs get a fragment, another third the parameter and a fragment."""
    url, k = F.col("url"), F.col("page_id") % 3
    more = F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), F.lit("lang=he&xlang=1#lang=fr"))
    given = F.when(k == 0, url).when(k == 1, F.concat(url, F.lit("#part?x=1"))).otherwise(more)
    return t.pages.select("page_id", text.set_query_parameter(given, "lang", "de").alias("url"))


@query("partial_dates", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN date_trunc('year', o_orderdate)::DATE WHEN 1 THEN date_trunc('month', o_orderdate)::DATE ELSE o_orderdate::DATE END AS date_from,
  CASE o_orderkey % 3 WHEN 0 THEN (date_trunc('year', o_orderdate) + INTERVAL 1 YEAR - INTERVAL 1 DAY)::DATE WHEN 1 THEN last_day(o_orderdate::DATE) ELSE o_orderdate::DATE END AS date_to,
  CASE o_orderkey % 3 WHEN 0 THEN 'year' WHEN 1 THEN 'month' ELSE 'day' END AS precision FROM orders""")
def partial_dates(t):
    k = F.col("o_orderkey") % 3
    written = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", dates.partial_date(written).alias("d")).select("o_orderkey", "d.*")


@query("json_validate", """SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE event_id % 3 < 2""")
def json_validate(t):
    k = F.col("event_id") % 3
    reply = F.when(k == 0, F.concat(F.lit("```json\n[2, "), "props", F.lit("]\n```"))).when(k == 1, F.col("props")).otherwise("garbage")
    rows = t.events.select("event_id", reply.alias("reply"))
    return jsonf.valid_elements(rows, "reply", {"k": "bigint"}).select("event_id", "k")


_KINDS_SQL = "'click', 'view', 'purchase'"
_SCHEMA = {
    "type": "object",
    "properties": {"kind": {"type": "string", "enum": ["click", "view", "purchase"]}, "k": {"type": "integer"}, "note": {"type": ["string", "null"]}},
    "required": ["kind", "k", "note"],
    "additionalProperties": False,
}


@query(
    "replies_held",
    f"""WITH e AS (SELECT event_id, event_id % 6 AS m, event_type IN ({_KINDS_SQL}) AS listed, event_type AS kind, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, CASE WHEN m = 1 THEN ':object' WHEN m = 2 THEN 'k:missing' WHEN m = 3 THEN 'k:type' WHEN m = 4 THEN 'more:unknown' ELSE '' END
  || CASE WHEN m <> 1 AND NOT listed THEN ',kind:enum' ELSE '' END AS faults,
  m IN (0, 5) AND listed AS ok, CASE WHEN m IN (0, 4, 5) THEN k END AS k, CASE WHEN m <> 1 AND listed THEN kind END AS kind FROM e""",
)
def replies_held(t):
    """Replies under a schema; of six, one is cut, one lacks a property, one has a text for a number and one a property too many."""
    m, k = F.col("event_id") % 6, F.get_json_object("props", "$.k")
    number = F.when(m == 2, "").when(m == 3, F.concat(F.lit('"k": "'), k, F.lit('", '))).otherwise(F.concat(F.lit('"k": '), k, F.lit(", ")))
    whole = F.concat(F.lit('{"kind": "'), "event_type", F.lit('", '), number, F.when(m == 4, '"more": [1], ').otherwise(""), F.lit('"note": '), F.when(m == 5, '"x"}').otherwise("null}"))
    rows = t.events.select("event_id", F.when(m == 1, F.expr("left('{\"kind\": \"click\", \"k\": 1}', 12)")).otherwise(whole).alias("reply"))
    held = jsonf.held_to(rows, "reply", _SCHEMA)
    faults = F.transform("checked.errors", lambda e: F.concat(F.coalesce(e["field"], F.lit("")), F.lit(":"), e["error"]))
    own = F.filter(faults, lambda f: f != "kind:enum")
    shown = F.concat(F.array_join(own, ","), F.when(F.array_contains(faults, "kind:enum"), ",kind:enum").otherwise(""))
    return held.select("event_id", shown.alias("faults"), "checked.ok", "checked.value.k", "checked.value.kind")


def answer(messages: list[str]) -> list[str]:
    """A stand-in for a model: the message's lines as JSON, with a text for a number where that is over 90."""
    out = []
    for message in messages:
        kind, k = (line.split(": ")[1] for line in message.split("\n"))
        out.append('{"kind": "%s", "k": %s, "note": null}' % (kind, k if int(k) <= 90 else f'"{k}"'))
    return out


@query(
    "replies_once",
    f"""WITH e AS (SELECT event_id, event_type IN ({_KINDS_SQL}) AS listed, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, listed AND k <= 90 AS ok, CASE WHEN k <= 90 THEN k END AS k, (SELECT count(DISTINCT event_type || ' ' || json_extract_string(props, '$.k')) FROM events) AS asked, 1 AS runs FROM e""",
)
def replies_once(t):
    """Each different message is asked once, and a second run asks nothing."""
    rows = t.events.select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    message = parse.labelled_message([("kind: ", "event_type"), ("k: ", "k")])
    cache = f"{scratch(t.spark)}/replies-{uuid.uuid4().hex}"
    parse.ask_once(rows, message, answer, "rules", cache, _SCHEMA)
    found = parse.ask_once(rows, message, answer, "rules", cache, _SCHEMA)
    kept = parse.cached_replies(rows, cache).agg(F.count("*").alias("asked"), F.count_distinct("run").alias("runs")).first()
    return found.select("event_id", "reply.ok", "reply.value.k", F.lit(kept["asked"]).cast("bigint").alias("asked"), F.lit(kept["runs"]).cast("int").alias("runs"))


def read_letters(messages: list[str]) -> list[str]:
    """A stand-in for a model: notes of a letter's length; of a long one the relevance comes as a text."""
    fields = {f: "null" for f in parse.LETTER_FIELDS}
    out = []
    for message in messages:
        relevant = '"yes"' if len(message) > 5000 else "true" if "a" in message else "false"
        out.append("{%s}" % ", ".join(f'"{f}": {v}' for f, v in (fields | {"is_heimat_relevant": relevant, "notes": f'"{len(message)}"'}).items()))
    return out


@query(
    "letters_once",
    """SELECT doc_id, text IS NOT NULL AND length(text) <= 5000 AS ok, CASE WHEN length(text) <= 5000 THEN contains(text, 'a') END AS relevant, length(text)::VARCHAR AS notes,
  (SELECT count(DISTINCT text) FROM documents) AS asked, 1 AS runs FROM documents""",
)
def letters_once(t):
    """letters' fields under their schema; equal texts are asked once, and a second run asks nothing."""
    rows, cache = t.documents.select("doc_id", "text"), f"{scratch(t.spark)}/letters-{uuid.uuid4().hex}"
    for _ in range(2):
        found = parse.ask_once(rows, F.col("text"), read_letters, "rules", cache)
    kept = parse.cached_replies(rows, cache).agg(F.count("*").alias("asked"), F.count_distinct("run").alias("runs")).first()
    value = F.col("reply.value")
    return found.select("doc_id", "reply.ok", value["is_heimat_relevant"].alias("relevant"), value["notes"].alias("notes"), F.lit(kept["asked"]).cast("bigint").alias("asked"), F.lit(kept["runs"]).cast("int").alias("runs"))


@query("status_cells", """SELECT o_orderkey, 'F' AS status, (o_orderkey % 5)::BIGINT AS n FROM orders UNION ALL SELECT o_orderkey, 'GT', NULL FROM orders""")
def status_cells(t):
    cell = F.concat(F.lit("F:9,F:"), (F.col("o_orderkey") % 5).cast("string"), F.lit(",GT:x"))
    return t.orders.select("o_orderkey", F.explode(jsonf.status_map(cell)).alias("status", "n")).withColumn("n", big("n", "n"))


@query("truth_values", """SELECT n_nationkey::BIGINT AS id, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS v FROM nation""")
def truth_values(t):
    k = F.col("n_nationkey") % 3
    return t.nation.select(big("n_nationkey", "id"), jsonf.truth(F.when(k == 0, "True").when(k == 1, " false").otherwise("?")).alias("v"))


@query("rect_select", """SELECT vec_id FROM embeddings WHERE embedding[1]::DOUBLE BETWEEN -0.1 AND 0.2 AND embedding[2]::DOUBLE BETWEEN -0.2 AND 0.1""")
def rect_select(t):
    points = t.embeddings.select("vec_id", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    return features.select_rectangle(points, 0.2, -0.1, -0.2, 0.1).select("vec_id")


@query("pca_rect")
def pca_rect(t):
    return features.select_rectangle(features.project(t.embeddings, "embedding"), -1, 1, -1, 1).select("vec_id", "x", "y")


@query("neighbour_embedding")
def neighbour_embedding(t):
    """Every embedding in two coordinates."""
    return neighbours.embed(t.embeddings, "embedding").select("vec_id", "x", "y")


@query("nearest_neighbours")
def nearest_neighbours(t):
    """The fifteen nearest other vectors of every embedding, as the graph finds them."""
    return neighbours.nearest(t.embeddings, "vec_id", 15, "embedding")


@query("parse_stub", """WITH s AS (SELECT p_partkey, unnest([p_name || '.', 'General: ' || p_type]) AS item_description, unnest([0, 1]) AS item_pos FROM part) SELECT p_partkey, item_pos::BIGINT AS item_pos, item_description, starts_with(item_description, 'General') AS is_general FROM s""")
def parse_stub(t):
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(". General: "), "p_type").alias("d"))
    return parse.parse_items(rows, "d").select("p_partkey", big("item_pos", "item_pos"), "item_description", "is_general")


_COMPARED = r"""p AS (SELECT doc_id, unnest(l) AS txt, unnest(range(len(l))) AS pos FROM (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '([.;])\s+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_matches(x, '\S')) AS l FROM documents)),
k AS (SELECT *, (doc_id * 7 + pos) % 25 AS k FROM p),
i AS (SELECT doc_id, unnest(CASE k WHEN 3 THEN [] WHEN 7 THEN [txt || ' added at review'] WHEN 15 THEN [txt, txt] WHEN 11 THEN [txt, 'no such passage ' || doc_id || ' ' || pos] ELSE [txt] END) AS txt, pos FROM k),
b AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(txt), '[\p{L}\p{N}]+'), ' ') AS words, d, i, CASE d WHEN 1 THEN pos END AS pos_d, CASE i WHEN 1 THEN pos END AS pos_i FROM (SELECT *, 1 AS d, 0 AS i FROM p UNION ALL SELECT *, 0, 1 FROM i)),
u AS (SELECT doc_id, words, sum(d)::BIGINT AS n_d, sum(i)::BIGINT AS n_i, min(pos_d) AS pos_d, min(pos_i) AS pos_i, string_split(words, ' ') AS w FROM b WHERE words <> '' GROUP BY doc_id, words),
g AS (SELECT doc_id, words, n_d > 0 AS told, f, list_slice(w, f, f + 2) AS run FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS f FROM u WHERE n_d = 0 OR n_i = 0)),
h AS (SELECT doc_id, run FROM g GROUP BY doc_id, run HAVING bool_or(told) AND bool_or(NOT told)),
c AS (SELECT doc_id, words, count(DISTINCT f + o) AS covered FROM (SELECT g.*, unnest(range(len(g.run))) AS o FROM g SEMI JOIN h ON g.doc_id = h.doc_id AND g.run = h.run) GROUP BY doc_id, words),
r AS (SELECT u.doc_id AS collection, CASE WHEN n_d > n_i THEN 'description' ELSE 'items' END AS side, CASE WHEN n_d > n_i THEN pos_d ELSE pos_i END AS pos, abs(n_d - n_i)::BIGINT AS times, len(w)::BIGINT AS n_words, coalesce(covered, 0)::BIGINT AS covered,
  CASE WHEN n_d > 0 AND n_i > 0 THEN CASE WHEN n_d > n_i THEN 'fewer' ELSE 'repeated' END WHEN 100 * coalesce(covered, 0) >= 50 * len(w) THEN 'altered' WHEN n_d > n_i THEN 'lost' ELSE 'invented' END AS status, u.words
  FROM u LEFT JOIN c ON u.doc_id = c.doc_id AND u.words = c.words WHERE n_d <> n_i)"""


def _reviewed(t: Tables) -> DataFrame:
    """Items of all documents, of 25 in a row one lost, one altered, one repeated and one invented after it."""
    item, k = F.col("item_description"), F.pmod(F.col("doc_id") * 7 + F.col("item_pos"), F.lit(25))
    invented = F.concat(F.lit("no such passage "), "doc_id", F.lit(" "), "item_pos")
    found = F.when(k == 3, F.array().cast("array<string>")).when(k == 7, F.array(F.concat(item, F.lit(" added at review")))).when(k == 15, F.array(item, item))
    return parse.parse_items(t.documents.select("doc_id", "text"), "text").select("doc_id", "item_pos", F.explode(found.when(k == 11, F.array(item, invented)).otherwise(F.array(item))).alias("item_description"))


@query("item_differences", f"WITH {_COMPARED} SELECT * FROM r")
def item_differences(t):
    """U8: documents against the items parsed from them, with planted losses, changes, copies and inventions."""
    return compare.differences(t.documents, _reviewed(t), "doc_id", "text")


@query(
    "item_coverage",
    f"""WITH {_COMPARED},
a AS (SELECT doc_id AS collection, sum(n_d)::BIGINT AS n_passages, sum(n_i)::BIGINT AS n_items, sum(least(n_d, n_i))::BIGINT AS n_kept, sum(n_d * len(w))::BIGINT AS n_words, sum(least(n_d, n_i) * len(w))::BIGINT AS s FROM u GROUP BY doc_id),
e AS (SELECT collection, sum(times) FILTER (status IN ('lost', 'fewer')) AS l, sum(times) FILTER (status = 'altered' AND side = 'description') AS x, sum(times) FILTER (status = 'invented') AS v, sum(times) FILTER (status = 'repeated') AS y, sum(times * covered) FILTER (side = 'description') AS q FROM r GROUP BY collection)
SELECT a.collection, n_passages, n_items, n_kept, coalesce(l, 0)::BIGINT AS n_lost, coalesce(x, 0)::BIGINT AS n_altered, coalesce(v, 0)::BIGINT AS n_invented, coalesce(y, 0)::BIGINT AS n_repeated, n_words, (s + coalesce(q, 0))::BIGINT AS n_covered, (s + coalesce(q, 0))::DOUBLE / nullif(n_words, 0) AS share FROM a LEFT JOIN e ON a.collection = e.collection""",
)
def item_coverage(t):
    """U8: how much of each document its items hold."""
    return compare.coverage(t.documents, _reviewed(t), "doc_id", "text")


@query("classify_stub", """SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'legal' WHEN contains(lower(text), '@') THEN 'contact' ELSE '' END AS class FROM documents""")
def classify_stub(t):
    return t.documents.select("doc_id", parse.classify(F.col("text"), [("license", "legal"), ("@", "contact")]).alias("class"))


@query("letter_message", """SELECT p_partkey, 'item_id: ' || p_partkey || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'title: ' || p_name ELSE '' END AS message FROM part""")
def letter_message(t):
    rows = t.part.select("p_partkey", F.col("p_partkey").cast("string").alias("item_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("").alias("title"))
    return rows.select("p_partkey", parse.labelled_message([("item_id: ", "item_id"), ("title: ", "title")]).alias("message"))


# --- changes ------------------------------------------------------------------------------------


@query("reclass", """SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 1026 ELSE 23 END::BIGINT AS class_id FROM orders""")
def reclass(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), "o_orderstatus", F.lit(23).alias("class_id"))
    return changes.reclass(rows, F.col("o_orderstatus") == "F", 1026).select("id", big("class_id", "class_id"))


@query("add_set", """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '5' WHEN o_orderkey % 2 = 0 THEN '1,5' ELSE '1' END AS sets FROM orders""")
def add_set(t):
    k = F.col("o_orderkey")
    rows = t.orders.select(k.alias("id"), F.when(k % 3 == 0, F.array(F.lit(5))).otherwise(F.array(F.lit(1))).alias("item_sets"))
    done = changes.add_set(rows, F.col("id") % 2 == 0, 5)
    return done.select("id", F.array_join(F.transform("item_sets", lambda x: x.cast("string")), ",").alias("sets"))


@query("enrich_idempotent", """SELECT DISTINCT user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id < 20 AND f.user_id = e.user_id AND f.event_type = e.event_type)""")
def enrich_idempotent(t):
    rows = t.events.select("user_id", "event_type")
    return batches.upsert_new(rows, t.events.where("event_id < 20").select("user_id", "event_type"), ["user_id", "event_type"])


@query("apply_inserts", f"""WITH {_VALUES} SELECT resource_id, value, lang FROM v UNION SELECT DISTINCT o_orderkey, 'p' || (o_custkey % 40), NULL FROM orders""")
def apply_inserts(t):
    return _inserted(stored(_line_values(t)), t.orders)


def _inserted(rows: DataFrame, orders: DataFrame) -> DataFrame:
    new = orders.select(
        F.col("o_orderkey").alias("resource_id"), F.lit("ex:part").alias("term"), F.lit(0).alias("pos"), F.lit("literal").alias("type"), F.concat(F.lit("p"), (F.col("o_custkey") % 40).cast("string")).alias("value")
    )
    new = changes.change(new, "insert")
    once = stored(changes.apply(rows, new))
    return changes.apply(once, new).select("resource_id", "value", "lang")


@query("apply_updates", f"""WITH {_VALUES} SELECT resource_id, CASE WHEN resource_id % 10 = 1 THEN 'X' ELSE value END AS value, lang FROM v WHERE resource_id % 10 > 0""")
def apply_updates(t):
    return _updated(stored(_line_values(t)))


def _updated(rows: DataFrame) -> DataFrame:
    updates = changes.change(rows.where("resource_id % 10 = 1").withColumn("value", F.lit("X")), "update")
    drops = changes.change(rows.where("resource_id % 10 = 0").select("resource_id").distinct(), "drop")
    return changes.apply(rows, updates.unionByName(drops)).select("resource_id", "value", "lang")


@query("updates_in_order", f"""WITH {_VALUES} SELECT resource_id, CASE resource_id % 3 WHEN 1 THEN 'bbb' WHEN 2 THEN 'zzz' ELSE value END AS value, lang FROM v""")
def updates_in_order(t):
    """Two updates of each value of two resources in three, zzz and bbb in one order or the other; the last one holds."""
    rows = stored(_line_values(t))
    first, second = (changes.change(rows.where("resource_id % 3 > 0").withColumn("value", F.when((F.col("resource_id") % 3 == 1) == one, "zzz").otherwise("bbb")), "update") for one in (True, False))
    return changes.apply(rows, changes.in_order(first, second)).select("resource_id", "value", "lang")


@query(
    "redirect_chains",
    """WITH RECURSIVE m AS (SELECT DISTINCT doc_id AS old, CASE WHEN doc_id % 8 < 7 THEN doc_id + 1 ELSE doc_id - 7 END AS new FROM documents WHERE doc_id % 8 < 7 OR (doc_id // 8) % 10 = 0),
w AS (SELECT old, new AS last, 1 AS hops FROM m UNION ALL SELECT w.old, m.new, hops + 1 FROM w JOIN m ON w.last = m.old WHERE hops < 30),
r AS (SELECT old, last, hops FROM w WHERE last NOT IN (SELECT old FROM m))
SELECT m.old, r.last, r.hops::BIGINT AS hops, CASE WHEN r.old IS NULL THEN 'cycle' ELSE 'resolved' END AS status FROM m LEFT JOIN r ON m.old = r.old""",
)
def redirect_chains(t):
    """Documents redirected to the next one, in chains of up to seven, every tenth chain closed to a cycle."""
    place = F.col("doc_id") % 8
    moved = t.documents.where((place < 7) | (F.call_function("div", F.col("doc_id"), F.lit(8)) % 10 == 0))
    return reconcile.resolve_chains(moved.select(F.col("doc_id").alias("old"), F.when(place < 7, F.col("doc_id") + 1).otherwise(F.col("doc_id") - 7).alias("new")))


@query("delete_targets", """SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 25 = 0)""")
def delete_targets(t):
    return changes.delete(t.customer.select(F.col("c_custkey").alias("id")), t.orders.where("o_orderkey % 25 = 0").select(F.col("o_custkey").alias("id")))


@query("restore_ids", """SELECT n_nationkey::BIGINT AS resource_id, 'N' || n_nationkey AS value FROM nation WHERE n_nationkey % 2 = 1""")
def restore_ids(t):
    parents = t.nation.select(big("n_nationkey", "resource_id"), F.format_string("N%d", "n_nationkey").alias("parent"))
    have = t.nation.where("n_nationkey % 2 = 0").select(big("n_nationkey", "resource_id"), F.lit("dcterms:identifier").alias("term"), F.col("n_name").alias("value"))
    return changes.restore_identifiers(parents, have).select("resource_id", "value")


@query(
    "title_relabel",
    """SELECT 'insert' AS op, p_partkey AS resource_id, NULL::BIGINT AS value_id, 'en' AS lang, p_name AS value FROM part WHERE p_partkey % 4 <> 1
UNION ALL SELECT CASE WHEN p_partkey % 4 = 0 THEN 'update' ELSE 'insert' END, p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_partkey * 10 END, 'he', 'שם' FROM part WHERE p_partkey % 4 <> 2""",
)
def title_relabel(t):
    both = F.concat("p_name", F.lit(" - שם"))
    half = text.split_bilingual_title(both)
    rows = t.part.select(F.col("p_partkey").alias("resource_id"), both.alias("bilingual"), half["latin"].alias("latin"), half["hebrew"].alias("hebrew"), F.lit(0).alias("pos"))
    k = F.col("p_partkey") % 4
    tag = F.when(k == 0, "").when(k == 1, "en").when(k == 2, "he").otherwise("fr")
    titles = t.part.select((F.col("p_partkey") * 10).alias("value_id"), F.col("p_partkey").alias("resource_id"), tag.alias("lang"), both.alias("value"))
    return changes.relabel_titles(rows, titles)


@query("recatalogue", """SELECT c_custkey AS doc_id, CASE WHEN c_nationkey = 0 THEN 'mint'
  WHEN c_nationkey < 10 AND (c_nationkey < 5 AND c_mktsegment = 'BUILDING' OR row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) > 1) THEN 'already'
  WHEN c_nationkey < 10 THEN 'enrich' WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1 THEN 'create' ELSE 'enrich_created' END AS action,
  CASE WHEN c_nationkey = 0 THEN 100 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) END AS number FROM customer""")
def recatalogue(t):
    mapping = t.customer.select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_nationkey") == 0, "NEW").otherwise(F.col("c_nationkey").cast("string")).alias("legacy_id"), F.col("c_custkey").alias("pos"), F.col("c_mktsegment").alias("uri"))
    known = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").cast("string").alias("identifier"), big("n_nationkey", "resource_id"))
    held = t.nation.where("n_nationkey < 5").select(big("n_nationkey", "resource_id"), F.lit("BUILDING").alias("uri"), F.lit("x").alias("label"))
    return changes.enrich(mapping, known, 100, F.lit("x"), held, spread=8).select("doc_id", "action", big("number", "number"))


@query("edit_log", """SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey % 3 = 1 THEN 'changed' ELSE n_name END AS name FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL SELECT 100, 'new'""")
def edit_log(t):
    rows = t.nation.select(big("n_nationkey", "id"), F.col("n_name").alias("name"))
    k = F.col("n_nationkey") % 3
    log = t.nation.where(k < 2).select(big("n_nationkey", "id"), F.when(k == 0, "delete").otherwise("modify").alias("op"), F.lit("changed").alias("name"), F.lit(1).alias("pos"))
    log = log.unionByName(t.spark.range(1).select(F.lit(100).cast("bigint").alias("id"), F.lit("add").alias("op"), F.lit("new").alias("name"), F.lit(2).alias("pos")))
    return changes.edit(rows, log, "id")


@query("sql_lines", """SELECT 0::BIGINT AS n, 'START TRANSACTION;' AS line UNION ALL SELECT 3, 'COMMIT;' UNION ALL
SELECT 2, 'INSERT INTO value (resource_id, property_id, type, lang, value, is_public) VALUES (' || r_regionkey || ', 1, ''literal'', ''en'', ''it''''s ' || r_name || ''', 1);' FROM region""")
def sql_lines(t):
    rows = t.region.select(F.lit("insert").alias("op"), big("r_regionkey", "resource_id"), F.lit(None).cast("bigint").alias("value_id"), F.lit("en").alias("lang"), F.concat(F.lit("it's "), "r_name").alias("value"))
    return changes.sql_script(rows, F.lit(1)).withColumn("n", big("n", "n"))


@query("stream_resume", """SELECT event_id, user_id, length(props)::BIGINT AS size FROM events""")
def stream_resume(t):
    """The events as a stream of what is new, run until nothing is left, appended once per event."""
    root = f"{scratch(t.spark)}/stream-{uuid.uuid4().hex}"
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    step = lambda b: b.select("event_id", "user_id", F.length("props").cast("bigint").alias("size"))
    batches.run_available(source, step, "event_id", f"{root}/out", f"{root}/state").awaitTermination()
    return batches.read_output(t.spark, f"{root}/out")


@query("outcome_counts", """SELECT count(*) FILTER (value > 10) AS done, count(*) FILTER (NOT value > 10) AS failed FROM events""")
def outcome_counts(t):
    return batches.outcome_counts(t.events, F.col("value") > 10)


# --- extensions -----------------------------------------------------------------------------------


@query("tumbling_events", """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_events(t):
    return batches.tumbling(t.events).drop("total")


@query(
    "session_events",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new, event_id FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_events(t):
    return batches.sessions(t.events)


@query("distinct_events", """SELECT event_id, user_id, event_type FROM events""")
def distinct_events(t):
    """Extension: a stream in which each event comes twice, each kept once."""
    root = f"{scratch(t.spark)}/distinct-{uuid.uuid4().hex}"
    source = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/events*.parquet")
    once = batches.distinct_events(source.unionByName(source)).select("event_id", "user_id", "event_type")
    once.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(once.schema).parquet(f"{root}/out")


@query("cube_sales", """SELECT l_returnflag, l_linestatus, count(*) AS n, grouping_id(l_returnflag, l_linestatus)::BIGINT AS gid FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def cube_sales(t):
    return aggregates.cube_counts(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("approx_users")
def approx_users(t):
    """Extension: approximate distinct users per event type."""
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


# --- written and read back; these need what is above ------------------------------------

from catalith.plans import roundtrips  # noqa: E402, F401
