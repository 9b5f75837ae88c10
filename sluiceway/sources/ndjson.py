"""Messages given as JSON objects, one a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.functions.jsontext import is_number, is_text, json_object, repeated_keys, shown_members

_FIELDS = ("fromhost", "fromhost_ip", "hostname", "programname", "syslogtag", "rawmsg", "msg", "inputname", "myhostname")
# Keys of the input that are named otherwise here.
_KEYS = {"fromhost_ip": "fromhostIp", "sim_time": "simTime"}


def read_ndjson(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages, and the rows that are no JSON object; other columns are kept in both.

    transport is tcp or else udp, port 514 if it is no number, simTime is in
    milliseconds; of repeated keys the last counts; blank lines are left out.
    fault names the first field of a message that should be a text and is none
    (null counts as missing); such a field is null.
    """
    kept = lines.filter(F.length(F.trim(column)) > 0)
    with repeated_keys(lines.sparkSession):
        whole = F.element_at(F.transform(F.array(json_object(F.col(column))), _message), 1)
        # A generator of one row: the filters below are not written out before it, so a line is read once.
        read = kept.select(*(f"`{c}`" for c in lines.columns), F.inline(F.array(F.struct(whole.alias("_m")))))
    names = [c for c in lines.columns if c != column]
    messages = read.filter(F.col("_m").isNotNull()).select(*(f"`{c}`" for c in names), "_m.*")
    return messages, read.filter(F.col("_m").isNull()).select(*(f"`{c}`" for c in lines.columns), F.lit("not a JSON object").alias("message"))


def _message(members: Column) -> Column:
    """A message as a struct; all of it is one expression, so the text is read once, and what a member is is asked once."""
    return F.when(members.isNotNull(), F.element_at(F.transform(F.array(F.transform_values(members, lambda _, v: _seen(v))), lambda seen: _fields(members, seen)), 1))


def _seen(value: Column) -> Column:
    """text: a member that is one, else null; odd: whether it is neither a text nor null."""
    read = lambda known: F.struct(F.when(known, F.try_variant_get(value, "$", "string")).alias("text"), (~known & value.isNotNull() & ~F.is_variant_null(value)).alias("odd"))
    return F.element_at(F.transform(F.array(is_text(value)), read), 1)


def _fields(members: Column, seen: Column) -> Column:
    key = lambda k: F.lit(_KEYS.get(k, k))
    at = lambda k: F.try_element_at(members, key(k))
    text = lambda k: F.try_element_at(seen, key(k))["text"]
    odd = lambda k: F.when(F.try_element_at(seen, key(k))["odd"], F.lit(f"{_KEYS.get(k, k)} is not a string"))
    structured = shown_members(F.try_variant_get(at("structured"), "$", "map<string,variant>"))
    fields = {
        "transport": F.when(text("transport") == "tcp", "tcp").otherwise("udp"), "port": F.coalesce(F.when(is_number(at("port")), F.try_variant_get(at("port"), "$", "int")), F.lit(514)), **{f: text(f) for f in _FIELDS},
        "sim_time": F.when(is_number(at("sim_time")), F.timestamp_millis(F.try_variant_get(at("sim_time"), "$", "double").try_cast("long"))),
        "structured": F.coalesce(structured, F.create_map().cast("map<string,string>")), "fault": F.coalesce(*(odd(f) for f in _FIELDS)),
    }
    return F.struct(*(c.alias(k) for k, c in fields.items()))


def read_line_array(bodies: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines of JSON arrays of strings, and what in them is no string.

    Both with the other columns and `row`, the place in the array from 1; the
    first with `value`.  A body that is no array has no lines.
    """
    names = [c for c in bodies.columns if c != column]
    items = bodies.select(*names, F.posexplode(F.from_json(column, "array<variant>")).alias("row", "_v")).withColumn("row", F.col("row") + 1)
    is_text = F.coalesce(F.schema_of_variant("_v") == "STRING", F.lit(False))
    lines = items.filter(is_text).select(*names, "row", F.variant_get("_v", "$", "string").alias("value"))
    return lines, items.filter(~is_text).select(*names, "row", F.lit("not a string").alias("message"))
