"""Reports over evaluated messages: outcomes, counts, samples, and the difference of two configurations.

Counts are partial aggregates on the map side; only their few groups are ranked.
Ties go to the group seen first, by the least idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.model import Config
from sluiceway.plans.routing import evaluate


def outcomes(evaluated: DataFrame) -> DataFrame:
    """Counts by what became of the messages; a ruleset that is not defined has no output, a message that failed counts as an error only."""
    delivered, failed = (F.size("outputs") > 0) & ~F.col("dropped"), F.col("error").isNotNull()
    return evaluated.agg(
        F.count("*").alias("total"), F.count("*").alias("processed"), F.count_if(delivered).alias("delivered"), F.count_if(F.col("dropped")).alias("no_input_match"), F.count_if(~delivered & ~F.col("dropped") & ~failed).alias("no_output"), F.count_if(failed).alias("errors")
    )


def _settled(rows: DataFrame, **values: Column) -> DataFrame:
    """rows with values that later filters do not go behind.

    A filter on a value that stands for a whole configuration would be written
    out once more, before the chain of its projections; behind a generator it is not.
    """
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(k) for k, c in values.items())))))


def _ranked(counts: DataFrame, top: int | None) -> DataFrame:
    if top is None:
        return counts.drop("first_idx")
    return counts.orderBy(F.desc("n"), "first_idx").limit(top).drop("first_idx")


def top_values(evaluated: DataFrame, value: Column, top: int | None = 10) -> DataFrame:
    """key, n, pct of the values that come most; empty and missing ones are <none>.

    The total is one row, the sum of partial counts; it joins the values that are left.
    """
    key = F.when(F.length(value) > 0, value).otherwise("<none>")
    counts = evaluated.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    ranked = _ranked(counts, top).join(F.broadcast(evaluated.agg(F.count("*").alias("total"))))
    return ranked.select("key", "n", (F.floor(F.col("n") * 1000.0 / F.col("total") + 0.5) / 10).alias("pct"))


def per_output(evaluated: DataFrame, top: int | None = 10, outputs: str = "outputs") -> DataFrame:
    """kind, target, n: outputs by what they are; a message with two equal outputs counts twice."""
    rows = evaluated.select("idx", F.explode(outputs).alias("o"))
    counts = rows.groupBy(F.col("o.kind").alias("kind"), F.col("o.label").alias("target")).agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    return _ranked(counts, top)


def per_ruleset(evaluated: DataFrame, top: int | None = 10) -> DataFrame:
    counts = evaluated.filter("ruleset IS NOT NULL").groupBy("ruleset").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"))
    return _ranked(counts, top)


# Why a message is in a bucket.
REASONS = {"unmatched": "no input matched", "no_output": "ruleset ran but no outputs"}
#: How many messages of a batch are run.
MOST_MESSAGES = 50_000


def samples(evaluated: DataFrame, k: int = 5) -> DataFrame:
    """The first k messages of each bucket (error, unmatched, no_output), by idx, with the reason."""
    bucket = F.when(F.col("error").isNotNull(), "error").when(F.col("dropped"), "unmatched").when(F.size("outputs") == 0, "no_output")
    rows = _settled(evaluated, bucket=bucket).filter("bucket IS NOT NULL").select("bucket", "idx", "programname", "hostname", F.substring("msg", 1, 200).alias("msg"), "error")
    first = rows.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("idx"))).filter(F.col("k") <= k).drop("k")
    reason = F.coalesce("error", F.when(F.col("bucket") == "unmatched", REASONS["unmatched"]).otherwise(REASONS["no_output"]))
    return first.withColumn("reason", reason).drop("error")


def _signature(suffix: str) -> Column:
    labels = F.array_sort(F.transform(f"outputs{suffix}", lambda o: F.concat_ws(":", o["kind"], o["label"])))
    return F.when(F.col(f"error{suffix}").isNotNull(), "error").when(F.col(f"dropped{suffix}"), "unmatched").otherwise(F.concat(F.lit("rs="), F.col(f"ruleset{suffix}"), F.lit("|"), F.concat_ws(",", labels)))


def compare(messages: DataFrame, baseline: Config, overlay: Config) -> DataFrame:
    """Both configurations in one projection: each message with its two signatures."""
    both = evaluate(evaluate(messages, baseline, "_a"), overlay, "_b")
    return _settled(both, baseline=_signature("_a"), overlay=_signature("_b"))


def route_changes(compared: DataFrame) -> DataFrame:
    return compared.filter(F.col("baseline") != F.col("overlay")).select("idx", "baseline", "overlay")


def route_change_samples(compared: DataFrame, k: int = 10) -> DataFrame:
    """The first k messages, by idx, whose route changes, with the outputs of both sides in order."""
    shown = lambda s: F.concat_ws(",", F.array_sort(F.transform(f"outputs_{s}", lambda o: F.concat_ws(":", o["kind"], o["label"]))))
    rows = compared.filter(F.col("baseline") != F.col("overlay")).select("idx", "programname", "hostname", F.substring("msg", 1, 200).alias("msg"), shown("a").alias("baseline_outputs"), shown("b").alias("overlay_outputs"))
    return rows.orderBy("idx").limit(k)


def _deltas(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of both sides by key, from rows with a and b; the largest change first is an orderBy of the few result rows."""
    sums = rows.groupBy(*keys).agg(F.sum("a").alias("baseline"), F.sum("b").alias("overlay"))
    return sums.withColumn("delta", F.col("overlay") - F.col("baseline")).orderBy(F.desc(F.abs("delta")), *keys)


def output_deltas(compared: DataFrame) -> DataFrame:
    """kind, target, baseline, overlay, delta over all outputs of either side, the largest change first.

    Both sides' outputs are one array, so the messages are evaluated once.
    """
    side = lambda s: F.transform(f"outputs_{s}", lambda o: F.struct(o["kind"].alias("kind"), o["label"].alias("target"), F.lit(int(s == "a")).alias("a"), F.lit(int(s == "b")).alias("b")))
    return _deltas(compared.select(F.inline(F.concat(side("a"), side("b")))), "kind", "target")


def ruleset_deltas(compared: DataFrame) -> DataFrame:
    """ruleset, baseline, overlay, delta over the rulesets that either side selects, the largest change first."""
    side = lambda s: F.struct(F.col(f"ruleset_{s}").alias("ruleset"), F.lit(int(s == "a")).alias("a"), F.lit(int(s == "b")).alias("b"))
    return _deltas(compared.select(F.inline(F.array(side("a"), side("b")))).filter("ruleset IS NOT NULL"), "ruleset")


def moves(compared: DataFrame) -> DataFrame:
    there = lambda s: (F.size(f"outputs_{s}") > 0) & ~F.col(f"dropped_{s}")  # noqa: E731  none if it failed
    changed = F.col("baseline") != F.col("overlay")
    return compared.agg(
        F.count_if(changed).alias("changed"), F.count_if(changed & ~there("a") & there("b")).alias("moved_to_delivered"), F.count_if(changed & there("a") & ~there("b")).alias("moved_to_unmatched")
    )


def route_gate(compared: DataFrame, most: int | None = None, most_pct: float | None = None) -> DataFrame:
    """changed, processed, pct, passed: whether no more routes change than allowed."""
    found = compared.agg(F.count_if(F.col("baseline") != F.col("overlay")).alias("changed"), F.count("*").alias("processed"))
    pct = F.when(F.col("processed") > 0, F.col("changed") * 100.0 / F.col("processed")).otherwise(0.0)
    passed = (F.lit(True) if most is None else F.col("changed") <= most) & (F.lit(True) if most_pct is None else F.col("pct") <= most_pct)
    return found.withColumn("pct", pct).withColumn("passed", passed)


def trace_events(evaluated: DataFrame) -> DataFrame:
    """idx, step, type, message: what happened to each message, from an evaluation with trace."""
    return evaluated.select("idx", F.inline("trace"))
