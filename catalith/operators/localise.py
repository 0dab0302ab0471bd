"""Values by locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.functions.text import language_key

LOCALES = ("en", "de", "he")


def resolve_locale(parameter: str | None, cookie: str | None = None, empty_is_absent: bool = False) -> str:
    """L1: query parameter, else cookie, else en; first two letters; en outside the known locales."""
    given = None if empty_is_absent and parameter == "" else parameter
    found = (given if given is not None else cookie or "en")[:2].lower()
    return found if found in LOCALES else "en"


def text_direction(locale: str) -> str:
    """L10."""
    return "rtl" if locale == "he" else "ltr"


def _ranks(lang: Column, locale: str) -> tuple[Column, Column, Column]:
    key = language_key(lang)
    untagged, current = key == "", key == locale
    return untagged, current, ~untagged & ~current


def pick_local(values: DataFrame, locale: str, keys: list[str], placeholder: str | None = None) -> DataFrame:
    """L2: the first value of the locale, else the first untagged one, else the placeholder.

    Columns lang, value and pos are needed; ``picked`` is null where only other
    languages exist and no placeholder is given. Never another language's value.
    """
    untagged, current, other = _ranks(F.col("lang"), locale)
    found = values.groupBy(*keys).agg(
        F.min_by("value", F.when(current, F.col("pos"))).alias("_current"),
        F.min_by("value", F.when(untagged, F.col("pos"))).alias("_untagged"),
        F.bool_or(other).alias("_other"),
    )
    tba = F.when(F.col("_other"), F.lit(placeholder)) if placeholder is not None else F.lit(None).cast("string")
    return found.select(*keys, F.coalesce("_current", "_untagged", tba).alias("picked"))


def render_list(values: DataFrame, locale: str, keys: list[str], placeholder: str) -> DataFrame:
    """L3: all untagged values, then all of the locale; the placeholder where only others exist.

    Keys without any value don't appear. ``n`` counts from 1.
    """
    untagged, current, other = _ranks(F.col("lang"), locale)
    shown = F.when(untagged, F.lit(0)).when(current, F.lit(1))
    lists = values.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(~other, F.struct(shown.alias("rank"), F.col("pos"), F.col("value"))))).alias("_v")
    )
    shown_values = F.when(F.size("_v") > 0, F.transform("_v", lambda x: x["value"])).otherwise(F.array(F.lit(placeholder)))
    return lists.select(*keys, F.posexplode(shown_values).alias("n", "value")).withColumn("n", F.col("n") + 1)


def label_fallback(label: Column, locale: str) -> Column:
    """The label in the locale, else in English, else in Hebrew."""
    return F.coalesce(label[locale], label["en"], label["he"])


def translation_gaps(values: DataFrame, locales: list[str], keys: list[str]) -> DataFrame:
    """(keys, lang) that no value covers."""
    expected = values.select(*keys).distinct().withColumn("lang", F.explode(F.array(*[F.lit(x) for x in locales])))
    actual = values.select(*keys, language_key(F.col("lang")).alias("lang")).distinct()
    return expected.join(actual, [*keys, "lang"], "left_anti")


def reverse_links(values: DataFrame, target: Column, page: int = 1, per_page: int = 25, term: str | None = None) -> DataFrame:
    """Who points at the target, by property, one page of them."""
    rows = values.where(F.col("type").contains("resource") & (F.col("value_resource_id") == target))
    if term is not None:
        rows = rows.where(F.col("term") == term)
    return rows.select("term", "resource_id").orderBy("term", "resource_id").offset((page - 1) * per_page).limit(per_page)


def translate_ui(keys: DataFrame, dictionary: DataFrame, locale: str) -> DataFrame:
    """(key) to (key, text): the locale's text, else the English one, else the key."""
    texts = dictionary.groupBy("key").agg(
        F.max(F.when(F.col("lang") == locale, F.col("text"))).alias("_own"), F.max(F.when(F.col("lang") == "en", F.col("text"))).alias("_en")
    )
    return keys.join(texts, "key", "left").select("key", F.coalesce("_own", "_en", "key").alias("text"))
