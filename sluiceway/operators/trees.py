"""Nested statements of many configurations as one table of intervals.

A statement's interval is its number in the order of reading (pre) and the last
number below it (last): what is nested in it lies between.  Sizes and whether a
statement ends handling on all its paths go up from the deepest level, numbers
go down from the top; a round is a join of one level with the next, and meets no
rows of other levels.  Configurations are few, so they come last in the keys:
rows are sorted by the first bytes of the first key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.staging import written

#: One row a statement.  parent is null at the top of a ruleset, else the `if` whose branch (then, else) it stands in; ord is its place there.
STATEMENTS = "config string, ruleset string, id long, parent long, branch string, ord long, kind string"
# Kinds of statements that end the handling of a message, or hand it on.
TERMINAL = ("Action", "Stop", "Call")


def leveled(statements: DataFrame) -> list[DataFrame]:
    """The statements by depth, from the top; those that hang below themselves, or below none, are left out.  A round meets only what no round before has placed."""
    rows = written(statements.select("config", "ruleset", "id", "parent", "branch", "ord", "kind"))
    levels, rest = [rows.filter("parent IS NULL")], rows.filter("parent IS NOT NULL")
    while not rest.isEmpty():
        above = levels[-1].select("config", F.col("id").alias("parent"), F.lit(True).alias("placed"))
        met = written(rest.join(above, ["parent", "config"], "left").select(*rows.columns, "placed"))
        level, rest = met.filter("placed").drop("placed"), met.filter("placed IS NULL").drop("placed")
        if level.isEmpty():
            break
        levels.append(level)
    return levels


def intervals(statements: DataFrame) -> DataFrame:
    """config, ruleset, id, parent, branch, ord, kind, depth, pre, last, terminal.

    pre counts from 1 in each ruleset; `then` comes before `else`; statements of
    one place go by id.  An `if` is terminal if the last statements of both its
    branches are; a missing branch is not.  Ids belong to one configuration and
    are not repeated there.
    """
    levels = leveled(statements)
    simple = F.col("kind").isin(*TERMINAL)
    both = F.coalesce(F.col("t") & F.col("e"), F.lit(False))
    sized: list[DataFrame] = []
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        if sized:
            under = sized[0].filter("under IS NOT NULL").select("config", F.col("parent").alias("id"), "under", F.col("t.terminal").alias("t"), F.col("e.terminal").alias("e"))
            size, terminal = 1 + F.coalesce("under", F.lit(0)), F.when(F.col("kind") == "If", both).otherwise(simple)
            level = level.join(under, ["id", "config"], "left").select(*level.columns, size.alias("size"), terminal.alias("terminal"))
        else:
            level = level.withColumns({"size": F.lit(1).cast("long"), "terminal": simple})
        place = Window.partitionBy("parent" if depth else "ruleset", "config").orderBy(F.struct((F.col("branch") == "else").alias("b"), "ord", "id"))
        before = F.coalesce(F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        if depth:
            # The last of a place has what its parent needs, so children are dealt once for their own places and for their parent.
            done = F.lead(F.lit(True)).over(place).isNull()
            tail = lambda b: F.last(F.when(F.col("branch") == b, F.struct("terminal")), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, 0))  # noqa: E731, B023
            level = level.select("*", before.alias("before"), done.alias("done"), tail("then").alias("t"), tail("else").alias("e"))
            level = level.withColumn("under", F.when(F.col("done"), F.col("before") + F.col("size"))).drop("done")
        else:
            level = level.withColumn("pre", before + 1)
        sized.insert(0, written(level))
    out = sized[:1]
    for level in sized[1:]:
        above = out[-1].filter("size > 1").select("config", F.col("id").alias("parent"), F.col("pre").alias("up"))
        out.append(written(level.join(above, ["parent", "config"]).withColumn("pre", F.col("before") + 1 + F.col("up")).drop("before", "t", "e", "under", "up")))
    whole = reduce(DataFrame.unionByName, (level.withColumn("depth", F.lit(depth).cast("long")) for depth, level in enumerate(out)))
    return whole.select("config", "ruleset", "id", "parent", "branch", "ord", "kind", "depth", "pre", (F.col("pre") + F.col("size") - 1).alias("last"), "terminal")


def silent_drops(rulesets: DataFrame, numbered: DataFrame, called: DataFrame) -> DataFrame:
    """config, code, ruleset, id, branch: paths that end without an action, a stop or a call.

    rulesets: config, ruleset of all that are defined, empty ones too; called:
    config, ruleset of those that others call, whose own ends are their callers'
    concern.  V_SILENT_DROP is a ruleset whose last statement is not terminal
    (id is null if it has none), V_SILENT_DROP_BRANCH a branch of an `if`.
    """
    tail = F.max_by(F.struct("id", "terminal"), F.struct("ord", "id"))
    tops = numbered.filter("parent IS NULL").groupBy("config", "ruleset").agg(tail.alias("t"))
    ends = rulesets.select("config", "ruleset").distinct().filter("ruleset <> '_default_legacy'").join(called.select("config", "ruleset").distinct(), ["config", "ruleset"], "left_anti")
    whole = ends.join(tops, ["config", "ruleset"], "left").filter("NOT coalesce(t.terminal, false)")
    whole = whole.select("config", F.lit("V_SILENT_DROP").alias("code"), "ruleset", "t.id", F.lit(None).cast("string").alias("branch"))
    parts = numbered.filter("parent IS NOT NULL").groupBy("config", "ruleset", "parent", "branch").agg(tail.alias("t")).filter("NOT t.terminal")
    return whole.unionByName(parts.select("config", F.lit("V_SILENT_DROP_BRANCH").alias("code"), "ruleset", "t.id", "branch"))
