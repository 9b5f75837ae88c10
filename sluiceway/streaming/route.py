"""Routing of a stream: the compiled projection holds no state, so it applies as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluiceway.model import Config
from sluiceway.plans.routing import evaluate
from sluiceway.sources.messages import read_lines, with_properties


def route_lines(lines: DataFrame, config: Config, column: str = "value") -> DataFrame:
    """Messages of a stream (or table) of lines with ruleset, outputs and vars."""
    return evaluate(with_properties(read_lines(lines, column)), config)


def deliveries(routed: DataFrame) -> DataFrame:
    """kind, target, msg: one row an output of a routed message."""
    return routed.select("msg", F.explode("outputs").alias("o")).select("o.kind", F.col("o.label").alias("target"), "msg")
