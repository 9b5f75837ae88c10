"""Tests of a configuration: what is expected of messages, joined with what became of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One row a test; what is null is not asked.  An output is matched by all its members that are not null.
EXPECTED = (
    "test string, idx long, ruleset string, stopped boolean, dropped boolean, "
    "outputs array<struct<kind:string,path_contains:string,target:string,port:int,protocol:string>>, structured map<string,string>, locals map<string,string>"
)


def _check(name: Column, passed: Column) -> Column:
    return F.struct(name.cast("string").alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))


def _equal(name: str) -> Column:
    """An array of one check, or of none if the test does not ask."""
    want = F.col(f"want.{name}")
    return F.when(want.isNull(), F.array().cast("array<struct<name:string,passed:boolean>>")).otherwise(F.array(_check(F.lit(name), F.col(f"got.{name}").eqNullSafe(want))))


def _members(label: str, want: str, got: str) -> Column:
    entries = F.map_entries(F.coalesce(F.col(f"want.{want}"), F.create_map().cast("map<string,string>")))
    return F.transform(entries, lambda e: _check(F.concat(F.lit(label + "."), e["key"]), F.try_element_at(F.col(f"got.{got}"), e["key"]).eqNullSafe(e["value"])))


def _outputs() -> Column:
    def fits(o: Column, w: Column) -> Column:
        same = lambda k: w[k].isNull() | o[k].eqNullSafe(w[k])
        path = w["path_contains"].isNull() | F.contains(F.coalesce(o["path"], F.lit("")), w["path_contains"])
        return same("kind") & path & same("target") & same("port") & same("protocol")

    wanted = F.filter(F.coalesce(F.col("want.outputs"), F.array()), lambda w: w.isNotNull())
    return F.transform(wanted, lambda w: _check(F.lit("outputsContains"), F.exists(F.coalesce(F.col("got.outputs"), F.array()), lambda o: fits(o, w))))


def checks(evaluated: DataFrame, expected: DataFrame) -> DataFrame:
    """test, name, passed of each thing that a test asks.

    evaluated: see plans.routing.evaluate; expected: see EXPECTED.  A test of a
    message that is not there fails by a check named message; its others fail too.
    """
    got = evaluated.select("idx", F.struct("ruleset", "stopped", "dropped", "outputs", "fields", "vars").alias("got"))
    want = expected.select("idx", F.struct(*(c for c in expected.columns if c != "idx")).alias("want"))
    both = want.join(got, "idx", "left")
    absent = F.when(F.col("got").isNull(), F.array(_check(F.lit("message"), F.lit(False)))).otherwise(F.array().cast("array<struct<name:string,passed:boolean>>"))
    asked = F.concat(absent, _equal("ruleset"), _equal("stopped"), _equal("dropped"), _outputs(), _members("structured", "structured", "fields"), _members("localVars", "locals", "vars"))
    return both.select("want.test", F.inline_outer(asked))


def results(checked: DataFrame) -> DataFrame:
    """test, passed, failures: a test passes if all its checks do; one that asks nothing passes."""
    failed = F.when(~F.col("passed"), F.col("name"))
    return checked.groupBy("test").agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("passed"), F.array_sort(F.collect_list(failed)).alias("failures"))


def summary(results: DataFrame) -> DataFrame:
    """total, passed, failed."""
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
