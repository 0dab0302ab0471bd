"""Filters (F1-F17) and routing conditions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalith.functions.text import strip

# Cells that say nothing (F2), and titles that are no titles.
EMPTY_WORDS = ("n/a", "na", "none", "null", "tbd", "pending", "-")
PLACEHOLDERS = ("tba", "n/a", "na", "none", "null", "-")
#: Properties that are shown elsewhere.
HIDDEN_PROPERTIES = (33, 1674, 809, 3368)


def is_meaningful(c: Column) -> Column:
    """at least three characters and not a word for nothing."""
    s = F.coalesce(strip(c), F.lit(""))
    return (F.length(s) >= 3) & ~F.lower(s).isin(*EMPTY_WORDS)


def is_placeholder(c: Column) -> Column:
    """blank or a placeholder."""
    s = F.coalesce(strip(c), F.lit(""))
    return (s == "") | F.lower(s).isin(*PLACEHOLDERS)


def is_auto_number(c: Column) -> Column:
    """ends with an underscore and digits."""
    return F.coalesce(strip(c), F.lit("")).rlike(r"_[0-9]+$")


def in_length_band(c: Column, marker: str | None = None, low: int = 2, high: int = 50) -> Column:
    """longer than ``low``, shorter than ``high``, without the marker word."""
    inside = (F.length(c) > low) & (F.length(c) < high)
    return inside if marker is None else inside & ~c.contains(marker)


def in_rectangle(x: Column, y: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """inside or on the border, whichever corner comes first."""
    return x.between(min(x0, x1), max(x0, x1)) & y.between(min(y0, y1), max(y0, y1))


def needs_work(c: Column) -> Column:
    """null or blank."""
    return c.isNull() | (c == "")


def is_filled(c: Column) -> Column:
    """not blank."""
    return F.coalesce(strip(c), F.lit("")) != ""


def not_listed(c: Column, excluded: list[str]) -> Column:
    """F8: outside the exclusion list; nulls are outside."""
    return F.coalesce(~c.isin(*excluded), F.lit(True)) if excluded else F.lit(True)


def route(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """the name of the first (pattern, name) that matches."""
    out = None
    for pattern, name in rules:
        hit = F.coalesce(c, F.lit("")).rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))


def pair_class(low: Column, high: Column, session: int = 7630, legacy: int = 5000, middle: int = 6000) -> Column:
    """what kind of duplicate a pair of ids is."""
    return (
        F.when(low >= session, F.lit("session"))
        .when((low < legacy) & (high >= middle) & (high < session), F.lit("old_vs_2025"))
        .when(high < legacy, F.lit("legacy"))
        .otherwise(F.lit("other"))
    )


def id_bucket(c: Column, edges: tuple[int, ...] = (5000, 6000, 7000, 7630), names: tuple[str, ...] = ("<5000", "5000s", "6000s", "early-7000s", "session-7000s")) -> Column:
    """the name of the range that holds the id."""
    out = F.when(c < edges[0], F.lit(names[0]))
    for edge, name in zip(edges[1:], names[1:], strict=False):
        out = out.when(c < edge, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def is_property_key(c: Column) -> Column:
    """a vocabulary term, not an administrative or JSON-LD key."""
    return c.rlike("^(?!o:|@).*:")


def is_shown_property(property_id: Column, hidden: tuple[int, ...] = HIDDEN_PROPERTIES) -> Column:
    """not one of the hidden properties."""
    return ~property_id.isin(*hidden)


def is_uri_value(kind: Column, uri: Column) -> Column:
    """a URI value with an address."""
    return (kind == "uri") & F.coalesce(uri != "", F.lit(False))


def is_key(c: Column) -> Column:
    """F16: neither blank nor the text NULL."""
    return ~F.coalesce(strip(c), F.lit("")).isin("", "NULL")


def is_link(kind: Column) -> Column:
    """a value that points at a resource."""
    return kind.contains("resource")


def page_kind(template_id: Column, collection: int = 5, folder: int = 2) -> Column:
    """Which page shows a resource."""
    return F.when(template_id == collection, "collection").when(template_id == folder, "folder").otherwise("item")


def template_kind(label: Column) -> Column:
    """Visual kind of a template label."""
    return (
        F.when(label.isNull(), "doc_other")
        .when(label == "Images", "image")
        .when(label.isin("Communication Document", "EgoDocuments"), "letter")
        .when(label == "Objects", "object")
        .otherwise("document")
    )
