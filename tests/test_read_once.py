"""JSON lines are read once, however their messages are filtered."""

import io
from contextlib import redirect_stdout

from pyspark.sql import functions as F

from sluiceway.functions.jsontext import json_object
from sluiceway.sources.ndjson import read_ndjson

def plan(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("extended")
    return out.getvalue().split("== Optimized Logical Plan ==")[1]


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "idx long, value string")


def test_a_line_is_read_once(spark):
    messages, others = read_ndjson(lines(spark, '{"msg":"x","hostname":1}', '{"msg":null}', "[1]", '{"a":1},{"b":2}'))
    shown = plan(messages)
    assert not any("Filter" in x and "parseJson" in x for x in shown.splitlines())
    assert sorted((r.idx, r.msg, r.hostname, r.fault) for r in messages.collect()) == [(0, "x", None, "hostname is not a string"), (1, None, None, None)]
    assert sorted(r.idx for r in others.collect()) == [2, 3]


def test_what_follows_an_object_is_none_with_and_without_a_bracket(spark):
    texts = ['{"a":1}', ' {"a":"]"} ', '{"a":[1]}', '{"a":1}]', '{"a":1} , 2', '{"a":1} , null', '{"a":1},', '{"a":1}}', '{"a":1}],[{"a":1}', "", "1", None]
    got = {r.idx for r in lines(spark, *texts).select("idx", json_object(F.col("value")).isNotNull().alias("is")).filter("is").collect()}
    assert got == {0, 1, 2}
