"""Queries of this subpackage and their SQL for DuckDB.

No SQL is given where it can't express the query (op3, op4, op6, op7, op11,
the pipeline); tests hold those against brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalith.llm.chat import op5_chat
from catalith.llm.classifier import op11_quality
from catalith.llm.common import table
from catalith.llm.decontaminate import links
from catalith.llm.divergence import op12_divergence
from catalith.llm.licences import op3_licenses
from catalith.llm.mixing import op2_mix
from catalith.llm.near_dup import op1_minhash
from catalith.llm.pages import op7_html
from catalith.llm.pii import op4_pii
from catalith.llm.quality import op8_quality
from catalith.llm.search import op13_search
from catalith.llm.substrings import op10_words
from catalith.llm.suffixes import op9_bytes

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": lambda s, d: op1_minhash(table(s, d, "documents")),
        "op2_mixing": lambda s, d: op2_mix(table(s, d, "documents")),
        "op3_licenses": lambda s, d: op3_licenses(table(s, d, "documents")),
        "op4_pii": lambda s, d: op4_pii(table(s, d, "documents")),
        "op5_chat": lambda s, d: op5_chat(table(s, d, "conversations")),
        "op6_decontaminate": lambda s, d: links(table(s, d, "documents"), table(s, d, "benchmark")),
        "op7_html": lambda s, d: op7_html(table(s, d, "pages")),
        "op8_quality": lambda s, d: op8_quality(table(s, d, "documents")),
        "op9_suffixes": lambda s, d: op9_bytes(table(s, d, "documents")),
        "op10_substrings": lambda s, d: op10_words(table(s, d, "documents")),
        "op11_classifier": lambda s, d: op11_quality(table(s, d, "documents"), table(s, d, "labels")),
        "op12_divergence": lambda s, d: op12_divergence(table(s, d, "documents")),
        "op13_search": lambda s, d: op13_search(table(s, d, "documents"), table(s, d, "benchmark")),
    }


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT r, doc_id, {_WORDS} AS w FROM d),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS sh FROM w),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON x = a.r JOIN n b ON y = b.r WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
c AS (SELECT r, r AS m FROM d UNION SELECT e.y, c.m FROM c JOIN e ON c.r = e.x),
o AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON c.m = d.r GROUP BY c.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, o.component_id, d.doc_id = o.component_id AS kept FROM d JOIN o USING (r) LEFT JOIN n USING (r)""",
        "op9_suffixes": """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT r, doc_id, i, substring(h, 2 * i - 1, 100) AS s FROM (SELECT *, unnest(range(1, length(h) // 2 - 48)) AS i FROM d)),
f AS (SELECT r, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
k AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM f),
q AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM k),
u AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY r, span),
v AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 1) AS z FROM u),
o AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(h, 2 * z - 1, 2 * (a - z)), '' ORDER BY a) AS kept FROM v JOIN d USING (r) GROUP BY r)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substring(h, 2 * coalesce(last, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN o USING (r)""",
        "op2_mixing": rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size, md5('17:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum(weight) OVER (ORDER BY cap / weight, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
  row_number() OVER (ORDER BY cap / weight, source NULLS FIRST) AS rank FROM w),
l AS (SELECT *, (total - before) / free AS level FROM o),
f AS (SELECT *, cap > level * weight AS open FROM l),
v AS (SELECT arg_min(level, rank) AS level FROM f WHERE open),
t AS (SELECT source, source_size, CASE WHEN open THEN least(cap, (SELECT level FROM v) * weight) ELSE cap END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
q AS (SELECT *, greatest(0, round(target)::BIGINT - whole * source_size) AS rest FROM p),
c AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far FROM d)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - so_far)))::BIGINT AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source""",
        "op5_chat": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(24 + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id""",
        "op8_quality": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
n AS (SELECT r, doc_id, t, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS up, (length(t) - length(regexp_replace(t, '\p{{Ll}}', '', 'g')))::BIGINT AS low,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS stutter,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d)),
h AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, s) > 1),
k AS (SELECT r, count(DISTINCT j)::BIGINT AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM h) GROUP BY r),
a AS (SELECT n.*, coalesce(k.n, 0) AS n_repeat_words, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines FROM n LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * stutter > 30 * n_words OR 10 * n_symbols > n_words OR 100 * n_dup_lines > 40 * n_lines OR word_chars < 3 * n_words OR word_chars > 12 * n_words OR 10 * up > 4 * (up + low)) AS kept
FROM b""",
        "op10_substrings": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
h AS (SELECT r, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY s) < doc_id),
k AS (SELECT DISTINCT r, unnest(range(i, i + 13)) AS j FROM h),
p AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
o AS (SELECT p.r, count(k.j)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY p.j) FILTER (k.j IS NULL) AS kept FROM p LEFT JOIN k ON p.r = k.r AND p.j = k.j GROUP BY p.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN o USING (r)""",
        "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT DISTINCT lang, source FROM d),
g AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, k.n AS lang_n FROM s JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
z AS (SELECT lang, source, sum(n) AS total FROM g GROUP BY ALL),
p AS (SELECT g.*, 1 + (1000000000::HUGEINT * (g.n + 5)) // (z.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (g.lang_n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN z USING (lang, source) JOIN l USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, b.source AS item FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source),
u AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM e LEFT JOIN f USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
o AS (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50""",
        "op13_search": r"""
WITH i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
c AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
x AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w)::BIGINT * docs) // total AS m FROM d, c WHERE len(w) > 0),
s AS (SELECT item_id, r, sum(x.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM i JOIN t USING (term) JOIN x USING (term) JOIN m USING (r) GROUP BY ALL),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""",
    }
