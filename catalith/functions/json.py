"""Replies of language models as JSON (D15, F12, and the JSON rows of SURVEY 2.9)."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.text import unfence


def valid_elements(df: DataFrame, reply: str, fields: dict[str, str], position: str = "pos") -> DataFrame:
    """One row for each element of a JSON array (or of a lone object) that has all fields.

    Elements that are no objects or lack a field are left out; others of the
    same array stay. Garbage and nulls give no row.
    """
    parsed = df.withColumn("_v", F.try_parse_json(unfence(F.col(reply))))
    wrapped = parsed.withColumn(
        "_v", F.when(F.schema_of_variant("_v").startswith("ARRAY"), F.col("_v")).when(
            F.col("_v").isNotNull(), F.try_parse_json(F.concat(F.lit("["), F.to_json("_v"), F.lit("]")))
        )
    )
    elements = df.sparkSession.tvf.variant_explode(F.col("_v").outer())
    rows = wrapped.lateralJoin(elements).select(*df.columns, F.col("pos").alias(position), F.col("value").alias("_e"))
    for name, kind in fields.items():
        rows = rows.withColumn(name, F.try_variant_get("_e", f"$.{name}", kind))
    whole = F.schema_of_variant("_e").startswith("OBJECT")
    for name in fields:
        whole = whole & F.col(name).isNotNull()
    return rows.where(whole).drop("_e")


def parse_object(reply: Column, fields: list[str]) -> Column:
    """struct(ok, fields): a flat object with blanks for absent fields; ok is false for garbage (T4)."""
    v = F.try_parse_json(unfence(reply))
    ok = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.struct(
        ok.alias("ok"),
        *[F.when(ok, F.coalesce(F.try_variant_get(v, f"$.{f}", "string"), F.lit(""))).otherwise(F.lit("")).alias(f) for f in fields],
    )


#: What a JSON type is in Spark: the start of its variant type, and the type that a value is read as.
_KINDS = {
    "string": ("STRING", "string"),
    "boolean": ("BOOLEAN", "boolean"),
    "integer": ("BIGINT", "bigint"),
    "number": ("BIGINT|DECIMAL|DOUBLE", "double"),
    "array": ("ARRAY", "variant"),
    "object": ("OBJECT", "variant"),
    "null": ("VOID", None),
}


def _property(name: str, rule: dict, required: bool) -> tuple[Column, Column]:
    """(value, error or null) of a property of the object in ``_v``."""
    if "'" in name or "\\" in name:
        raise ValueError(f"no quotes or backslashes in property names: {name}")
    kinds = rule.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else list(kinds)
    if unknown := [k for k in kinds if k not in _KINDS] + [k for k in rule if k not in ("type", "enum", "description", "title")]:
        raise ValueError(f"not supported in the schema of {name}: {', '.join(unknown)}")
    at = f"$['{name}']"
    part = F.try_variant_get("_v", at, "variant")
    found = F.schema_of_variant(part)
    fits = F.lit(not kinds)
    for kind in kinds:
        fits = fits | found.rlike(f"^(?:{_KINDS[kind][0]})")
        if kind == "integer":
            real = F.try_variant_get("_v", at, "double")
            fits = fits | (found.rlike("^(?:DECIMAL|DOUBLE)") & F.coalesce(real == F.floor(real), F.lit(False)))
    error = F.when(part.isNull(), F.lit("missing") if required else F.lit(None).cast("string")).when(~fits, "type")
    if "enum" in rule:
        words = [v for v in rule["enum"] if isinstance(v, str)]
        others = [json.dumps(v) for v in rule["enum"] if not isinstance(v, str)]
        is_word = found == "STRING"
        listed = (is_word & F.try_variant_get("_v", at, "string").isin(words)) | (~is_word & F.to_json(part).isin(others))
        error = error.when(~listed, "enum")
    read = {_KINDS[k][1] for k in kinds} - {None}
    kind = read.pop() if len(read) == 1 else "variant"
    value = F.when(found != "VOID", F.to_json(part)) if kind == "variant" else F.try_variant_get("_v", at, kind)
    return F.when(error.isNull(), value), error


def held_to(df: DataFrame, reply: str, schema: dict, to: str = "checked") -> DataFrame:
    """Rows with ``to``: struct(ok, errors, value) of the object in ``reply`` under a JSON schema.

    Of the schema count the top object's ``properties`` (``type``, one or a list, and
    ``enum``), ``required`` and ``additionalProperties: false``; anything else in a
    property raises, so that nothing is taken for checked that isn't. ``errors`` has
    a struct(field, error) for each fault: missing, type, enum, or unknown for a
    property that isn't in the schema; a null field and ``object`` for what is no JSON
    object (null, garbage, a name twice). A value with an error is null, the others of
    the same reply stay; arrays, objects and mixed types come as JSON texts.
    """
    properties, required = schema.get("properties", {}), set(schema.get("required", ()))
    if absent := sorted(required - set(properties)):
        properties = properties | {name: {} for name in absent}
    parts = {name: _property(name, rule, name in required) for name, rule in properties.items()}
    is_object = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))

    def fault(field: Column, error: Column) -> Column:
        return F.struct(field.cast("string").alias("field"), error.alias("error"))

    known = F.array(*[F.lit(name) for name in properties]).cast("array<string>")
    errors = F.filter(F.array(*[fault(F.lit(name), error) for name, (_, error) in parts.items()]).cast("array<struct<field:string,error:string>>"), lambda e: e["error"].isNotNull())
    if schema.get("additionalProperties") is False:
        extra = F.array_sort(F.array_except(F.json_object_keys(F.to_json("_v")), known))
        errors = F.concat(errors, F.transform(extra, lambda name: fault(name, F.lit("unknown"))))
    errors = F.when(is_object, errors).otherwise(F.array(fault(F.lit(None), F.lit("object"))))
    values = F.struct(*[F.when(is_object, value).alias(name) for name, (value, _) in parts.items()])
    rows = df.withColumn("_v", F.try_parse_json(unfence(F.col(reply)))).withColumn("_e", errors).withColumn("_o", values)
    return rows.withColumn(to, F.struct((F.size("_e") == 0).alias("ok"), F.col("_e").alias("errors"), F.col("_o").alias("value"))).drop("_v", "_e", "_o")


def truth(c: Column) -> Column:
    """Booleans written in any case (Q20); null for other text."""
    s = F.lower(F.trim(c))
    return F.when(s.isin("true", "1", "yes"), F.lit(True)).when(s.isin("false", "0", "no"), F.lit(False))


def split_cell(c: Column, separator: str = r"\|") -> Column:
    """The trimmed, non-blank parts of a multi-valued cell; empty for null."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separator), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")


def status_map(c: Column) -> Column:
    """FINAL:195,GT:2 as a map; of a repeated key the last count stays, bad counts are null."""
    pairs = F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda p: p.contains(":"))
    entries = F.transform(
        pairs,
        lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.substring_index(p, ":", -1)).try_cast("int").alias("value")),
    )
    last = F.filter(entries, lambda e, i: F.size(F.filter(entries, lambda x, j: (x["key"] == e["key"]) & (j > i))) == 0)
    return F.map_from_entries(last)
