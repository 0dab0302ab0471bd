"""String functions (X1-X21, P8, P13). All are built-in expressions."""

from __future__ import annotations

import re
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

HEBREW = r"֐-׿"
#: Characters around the halves of a bilingual title (fixed value, X2).
TITLE_EDGES = " ,-:;\t"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def blank_to_null(c: Column, markers: tuple[str, ...] = ("NULL",)) -> Column:
    """Null for blank cells and null markers; else the stripped text."""
    s = strip(c)
    return F.when((s != "") & ~s.isin(*markers), s)


def or_blank(c: Column) -> Column:
    """Stripped text, blank for null."""
    return F.coalesce(strip(c), F.lit(""))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters to one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def snippet(c: Column, n: int = 200) -> Column:
    """The first ``n`` code points, with an ellipsis if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def concat_columns(columns: list[Column], strict_nan: bool = False) -> Column:
    """Columns joined by a space; ``strict_nan`` keeps the text nan for nulls (Q1)."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("nan")) if strict_nan else c for c in columns])


def edge_trim(c: Column, characters: str = TITLE_EDGES, side: str = "both") -> Column:
    """Trim a set of characters on both sides, or on the left or right."""
    f = {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side]
    return f(c, F.lit(characters))


def split_bilingual_title(c: Column, script: str = HEBREW) -> Column:
    """struct(latin, hebrew); mixed titles are cut at the first Hebrew character, and trimmed at the cut alone."""
    s = strip(c)
    has_hebrew, has_latin = s.rlike(f"[{script}]"), s.rlike("[A-Za-z]")
    cut = F.regexp_extract(s, f"^([^{script}]*)", 1)
    left, right = edge_trim(cut, side="right"), edge_trim(s.substr(F.length(cut) + 1, F.length(s)), side="left")
    null = F.lit(None).cast("string")
    latin = F.when(has_hebrew & has_latin, F.nullif(left, F.lit(""))).when(has_latin & ~has_hebrew, s).otherwise(null)
    hebrew = F.when(has_hebrew & has_latin, F.nullif(right, F.lit(""))).when(has_hebrew & ~has_latin, s).otherwise(null)
    return F.struct(latin.alias("latin"), hebrew.alias("hebrew"))


def normalise_tag(c: Column) -> Column:
    """No dots at the ends, no leading number or asterisk, no tail from an asterisk on."""
    s = strip(F.btrim(strip(c), F.lit(".")))
    s = F.regexp_replace(s, r"(?U)^[0-9]+\.?\s+", "")
    s = strip(F.regexp_replace(s, r"^\*+", ""))
    return strip(F.regexp_replace(s, r"(?sU)\s*\*.*$", ""))


def category_tags(c: Column, marker: str) -> Column:
    """Raw tags of the section after ``marker``, which needs at least one bar; else none."""
    section = F.regexp_extract(c, rf"(?U){marker}[:\s]*([^|]*?\|.+)", 1)
    return F.when(section != "", F.split(section, r"\|")).otherwise(F.array().cast("array<string>"))


def unfence(c: Column, anywhere: bool = True) -> Column:
    """Without code fences, anywhere or as the first and last line."""
    s = strip(c)
    if anywhere:
        return strip(F.regexp_replace(s, "```(?:json)?", ""))
    return F.when(s.startswith("```"), strip(F.regexp_replace(s, r"(?s)^[^\n]*\n(.*)\n[^\n]*$", "$1"))).otherwise(s)


def paragraphs(c: Column) -> Column:
    """X11: split at blank lines."""
    return F.split(c, r"\n\s*\n")


def sql_literal(c: Column) -> Column:
    """Escape backslashes and quotes for an SQL string."""
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))


def zero_pad(n: Column, width: int = 4) -> Column:
    """At least ``width`` digits, more where needed (lpad would cut)."""
    return F.format_string(f"%0{width}d", n)


def contains_any(c: Column, needles: list[str]) -> Column:
    """whether the text, null as blank, contains one of the needles."""
    out = F.lit(False)
    for needle in needles:
        out = out | F.coalesce(c, F.lit("")).contains(needle)
    return out


def url_host(c: Column) -> Column:
    """The host of a URL, null where there is none."""
    return F.try_parse_url(c, F.lit("HOST"))


def url_id(c: Column, prefix: str) -> Column:
    """The numeric id after ``prefix``, without query and trailing slashes; else null."""
    rest = F.substring_index(c.substr(F.lit(len(prefix) + 1), F.length(c)), "?", 1)
    return F.when(c.startswith(prefix), F.rtrim(rest, F.lit("/")).try_cast("bigint"))


def language_key(c: Column) -> Column:
    """The first two characters of a language tag, lower case; blank for null."""
    return F.lower(F.substring(F.coalesce(c, F.lit("")), 1, 2))


def set_query_parameter(url: Column, name: str, value: str) -> Column:
    """The URL with one query parameter replaced or added; a fragment stays at the end."""
    pair = f"{quote(name, safe='')}={quote(value, safe='')}"
    before = rf"(^|&){re.escape(quote(name, safe=''))}="
    fragment, rest = F.regexp_extract(url, r"(?s)(#.*)$", 1), F.substring_index(url, "#", 1)
    base, query = F.substring_index(rest, "?", 1), F.when(rest.contains("?"), F.regexp_replace(rest, r"^[^?]*\?", "")).otherwise(F.lit(""))
    changed = F.when(query.rlike(before), F.regexp_replace(query, rf"{before}[^&]*", rf"$1{pair}")).otherwise(
        F.concat_ws("&", F.nullif(query, F.lit("")), F.lit(pair))
    )
    return F.concat(base, F.lit("?"), changed, fragment)


def first_filled(*columns: Column) -> Column:
    """The first column that is neither null nor blank nor "0" (date fallback)."""
    return F.coalesce(*[F.when(~c.isin("", "0"), c) for c in columns])
