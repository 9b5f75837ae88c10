"""Strict JSON in columns: a whole text or nothing, the last of repeated keys, no text that raises."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.sql.variant.allowDuplicateKeys"


@contextmanager
def repeated_keys(spark: SparkSession) -> Iterator[None]:
    """Frames that are made inside let keys repeat; the session's own setting is as before afterwards.

    The setting is read when a column is bound to its frame, not when it runs.
    """
    before = spark.conf.get(_SETTING, None)
    spark.conf.set(_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.unset(_SETTING) if before is None else spark.conf.set(_SETTING, before)


def json_object(text: Column) -> Column:
    """The members of a text that is one JSON object and nothing else, as map<string,variant>; null for any other.

    The parser stops behind the first value.  What follows it would have to pass
    both as the rest of an array and as that of an object, which nothing does.  A
    text without a bracket cannot end the array itself, so its second reading is
    left out: it is alone if there is no second value.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    only = lambda a: F.when(F.contains(text, F.lit("]")), member.isNotNull()).otherwise(F.try_variant_get(a, "$[1]", "variant").isNull())
    return F.element_at(F.transform(F.array(alone), lambda a: F.when(only(a), F.try_variant_get(a, "$[0]", "map<string,variant>"))), 1)


def is_text(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value) == "STRING", F.lit(False))


def is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return F.coalesce(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.lit(False))


def shown(value: Column) -> Column:
    """A member as a string: texts as they are, null as empty, others as compact JSON."""
    double = F.try_variant_get(value, "$", "double")
    whole = (double == F.floor(double)) & (F.abs(double) < 1e15)
    number = F.when(whole, double.cast("long").cast("string")).otherwise(double.cast("string"))
    return F.when(value.isNull() | F.is_variant_null(value), "").when(is_text(value), F.try_variant_get(value, "$", "string")).when(F.schema_of_variant(value) == "DOUBLE", number).otherwise(F.to_json(value))


def shown_members(members: Column) -> Column:
    return F.transform_values(members, lambda _, v: shown(v))
