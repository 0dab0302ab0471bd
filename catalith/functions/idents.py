"""Hierarchical identifiers collection-folder-record.

A collection is ``<prefix>NNNN``, a folder adds ``-NNN`` and a record ``-Rn``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def folder_of(c: Column) -> Column:
    """The id without its record suffix, null if it has none."""
    up = F.regexp_replace(c, r"-R[0-9]+$", "")
    return F.when(up != c, up)


def collection_of(c: Column) -> Column:
    """The collection of a record, null if the id is no record."""
    up = F.regexp_replace(c, r"-[0-9]{3}-R[0-9]+$", "")
    return F.when(up != c, up)


def collection_of_folder(c: Column) -> Column:
    """The collection of a folder, null if the id is no folder."""
    up = F.regexp_replace(c, r"-[0-9]{3}$", "")
    return F.when(up != c, up)


def record_number(c: Column) -> Column:
    """The number of the record suffix, null where there is none."""
    return F.regexp_extract(c, r"-R([0-9]+)$", 1).try_cast("bigint")


def family_id(c: Column) -> Column:
    """The first three parts of an accession id, null if it has fewer."""
    return F.when(F.size(F.split(c, "-")) >= 3, F.substring_index(c, "-", 3))


def family_number(c: Column) -> Column:
    """The number of a trailing G-F-n."""
    return _found(F.regexp_extract(c, r"G-F-([0-9]+)$", 1))


def parent_of_child(c: Column, prefix: str) -> Column:
    """The collection of any id below it, the id itself included; null for other forms."""
    return _found(F.regexp_extract(c, rf"^(\Q{prefix}\E[0-9]{{4}})(?:-[0-9]+(?:-R[0-9]+)?)?$", 1))


def short_reference(c: Column) -> Column:
    """What follows G-F-."""
    return _found(F.regexp_extract(c, r"G-F-(.+)$", 1))


def record_tag(c: Column) -> Column:
    """The record suffix with its R."""
    return _found(F.regexp_extract(c, r"(R[0-9]+)$", 1))


def before_record(c: Column) -> Column:
    """What stands before the first -R."""
    return F.substring_index(c, "-R", 1)


def label_key(c: Column) -> Column:
    """The last part in round brackets of a label, without closing characters."""
    return F.rtrim(F.substring_index(c, "(", -1), F.lit("):"))


def without_prefix(c: Column, prefix: str) -> Column:
    """The identifier without the constant prefix."""
    return F.when(c.startswith(prefix), c.substr(F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def record_id(collection: Column, number: Column) -> Column:
    """Mint the id of a record."""
    return F.format_string("%s-R%04d", collection, number)
