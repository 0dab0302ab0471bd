"""Parsers and classifiers of texts.

A language model is a plug-in: any function from texts to replies. The defaults
are rules made of expressions, so that plans run without a network.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.json import held_to, parse_object
from catalith.functions.text import strip
from catalith.sources.files import read_checkpoint

# The fields of a classification reply (U2) and of a letter reply.
FIELDS = (
    "german_translation", "english_translation", "item_class", "document_type", "format", "language", "creation_place",
    "creation_date", "publication_date", "number_of_pages", "documentary_form_type", "production_technique_type",
    "main_subject", "record_state", "title",
)
LETTER_FIELDS = (
    "from_person", "to_person", "from_place", "to_place", "send_date", "mentioned_places", "mentioned_persons",
    "is_heimat_relevant", "notes",
)
#: Fixed value: the schema of a letter reply.
LETTER_SCHEMA = {
    "type": "object",
    "properties": {f: {"type": "boolean"} if f == "is_heimat_relevant" else {"type": ["string", "null"]} for f in LETTER_FIELDS},
    "required": list(LETTER_FIELDS),
    "additionalProperties": False,
}
#: Fixed order in which tasks are put to the model (P14); the place is asked for too (Q5).
TASKS = (
    "german_translation", "english_translation", "format", "language", "creation_place", "creation_date", "publication_date",
    "number_of_pages", "documentary_form_type", "production_technique_type", "main_subject", "record_state", "title",
    "item_class", "document_type",
)


def require_columns(df: DataFrame, *columns: str) -> None:
    """Columns that exist and differ from each other."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    if len(set(columns)) < len(columns):
        raise ValueError("the columns have to differ")


def requested(flags: dict[str, bool]) -> list[str]:
    """The keys that the flags ask for, in the fixed order."""
    return [t for t in TASKS if flags.get(t)]


def labelled_message(sections: Sequence[tuple[str, str]]) -> Column:
    """Labels and texts of the filled columns, a line each."""
    return F.concat_ws("\n", *[F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c))) for label, c in sections])


def split_description(c: Column, general: str = r"^(?i:the collection|general)") -> Column:
    """U1 by rule: sentences as (item_description, is_general)."""
    sentences = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?<=[.;])\s+|\n+"), strip), lambda s: s != "")
    return F.transform(sentences, lambda s: F.struct(s.alias("item_description"), s.rlike(general).alias("is_general")))


def parse_items(rows: DataFrame, text: str, general: str | None = None) -> DataFrame:
    """One row per item of each description; ``item_pos`` counts from 0; no item, no row."""
    items = split_description(F.col(text)) if general is None else split_description(F.col(text), general)
    return rows.select(*rows.columns, F.posexplode(items).alias("item_pos", "_i")).select(*rows.columns, "item_pos", "_i.*")


def classify(c: Column, keywords: Sequence[tuple[str, str]], default: str = "") -> Column:
    """U2 by rule: the name of the first keyword that the text holds."""
    out = F.lit(default)
    for word, name in reversed(list(keywords)):
        out = F.when(F.lower(F.coalesce(c, F.lit(""))).contains(word), F.lit(name)).otherwise(out)
    return out


Model = Callable[[list[str]], list[str | None]]


def _call(model: Model):
    """The model as a column function; a batch that raises gives nulls.

    It counts as nondeterministic, so no plan asks twice, once for a filter and once for a column.
    """

    @F.pandas_udf("string")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            try:
                yield pd.Series(model(batch.tolist()), index=batch.index, dtype="object")
            except Exception:
                yield pd.Series([None] * len(batch), index=batch.index, dtype="object")

    return call.asNondeterministic()


def ask(rows: DataFrame, message: Column, model: Model, fields: Sequence[str] = FIELDS) -> DataFrame:
    """Rows with ``reply``: struct(ok, fields) from a model that answers batches of messages.

    A batch that raises gives ok = false for its rows; the job goes on.
    """
    return rows.withColumn("_raw", _call(model)(message)).withColumn("reply", parse_object(F.col("_raw"), list(fields))).drop("_raw")


def cached_replies(rows: DataFrame, cache: str) -> DataFrame:
    """What ``ask_once`` keeps: (digest, reply, model, run)."""
    return read_checkpoint(rows.sparkSession, cache, "digest string, reply string, model string, run string")


def ask_once(rows: DataFrame, message: Column, model: Model, name: str, cache: str, schema: dict = LETTER_SCHEMA) -> DataFrame:
    """Rows with ``reply``: struct(ok, errors, value) held to a schema; a message is put to the model ``name`` once.

    ``cache`` is a shared folder of replies by the digest of their message. What it
    lacks is asked, each different message once, and written before anything is
    returned, so a second run over the same rows asks nothing. A reply that breaks the schema is
    kept, too, with its errors; a message without a reply (its batch raised) isn't and
    is asked again by the next run. A null message is not asked; its reply is no object.
    A run writes a folder of its own, so runs may overlap; of two replies the lesser counts.
    A task that is repeated asks its messages again but leaves one reply.
    """
    told = rows.withColumn("_m", message).withColumn("_d", F.sha2("_m", 256))
    have = cached_replies(rows, cache).where(F.col("model") == name).select(F.col("digest").alias("_d"))
    wanted = told.where("_m is not null").groupBy("_d").agg(F.min("_m").alias("_m"))  # copies meet before they are sent
    new = wanted.join(have, "_d", "left_anti")
    replies = new.select(F.col("_d").alias("digest"), _call(model)("_m").alias("reply"), F.lit(name).alias("model")).where("reply is not null")
    replies.write.partitionBy("model").parquet(f"{cache}/run={uuid.uuid4().hex}")
    kept = cached_replies(rows, cache).where(F.col("model") == name).groupBy(F.col("digest").alias("_d")).agg(F.min("reply").alias("_r"))
    return held_to(told.drop("_m").join(kept, "_d", "left"), "_r", schema, "reply").select(*[c for c in rows.columns if c != "reply"], "reply")
