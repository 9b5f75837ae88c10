"""Mixing sources to target weights by nested hash-threshold histograms.

Each document has a hash; a source takes its documents in the order of their
hashes until its words reach the target.  No sort finds the place where it
stops: words are summed by source and leading bits of the hash, the bucket that
crosses the budget is refined by the next bits, and what lies below is a filter.
Everything is DataFrame work on the JVM; per source only histograms of at most
2**BITS rows exist, so no group of rows comes together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluiceway.llm.common import materialize, quoted, whole_row

WEIGHTS = (5, 2, 1)
TOTAL_PERCENT, MOST_REPEATS = 150, 2
BITS, LEVELS = 12, 3
#: Tables by source are broadcast up to so many sources; beyond, joins are dealt by source and hot ones split.
FEW_SOURCES = 20_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(doc_id: Column) -> Column:
    """15 hexadecimal digits of the id's MD5 as a number: the order in which documents are taken."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, repeats: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target from source, source_size (one row a source).

    Sources by code point, null last, weigh `weights` in turn and share `percent`
    of all sizes; a target above `repeats` times its source's size stops there,
    and the excess is shared by weight among the others until none is above.  In
    the order of size by weight, a source is capped if its share of what the
    sources before it have left is more than its cap.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    rank = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = rank.rowsBetween(Window.unboundedPreceding, -1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = (
        sizes.withColumn("w", w.cast("long")).withColumn("cap", F.col("source_size") * repeats)
        .withColumn("budget", F.sum("source_size").over(everything) * percent / 100)
        .withColumn("left", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("left") * F.col("w") / F.col("left_w") >= F.col("cap"))
    )
    capped = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0))
    level = (F.col("budget") - capped("cap")) * F.col("w") / F.nullif(F.sum("w").over(everything) - capped("w"), F.lit(0))
    return ranked.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(level.cast("double")).alias("target"))


def _boundary(rows: DataFrame, budgets: DataFrame, level: int) -> DataFrame:
    """Per source the bucket that crosses its budget, and the budget left in it.

    rows: key, h, size; budgets: key, lo, hi (bounds of h still open), budget.
    Returns key, lo, hi, budget of the bucket.  A source whose budget no bucket
    crosses takes all it has.
    """
    width = 1 << (60 - BITS * (level + 1))
    inside = rows.join(budgets, "key").filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi")))
    sums = inside.groupBy("key", F.shiftright("h", 60 - BITS * (level + 1)).alias("bucket"), "budget").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("bucket"))
    crossed = sums.withColumn("upto", upto).filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
    return crossed.select("key", (F.col("bucket") * width).alias("lo"), ((F.col("bucket") + 1) * width).alias("hi"), (F.col("budget") - F.col("upto") + F.col("n")).alias("budget"))


def _key() -> Column:
    """The source as a key without null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source").cast("string")))


def _planned(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, repeats: int = MOST_REPEATS) -> tuple[DataFrame, DataFrame]:
    """The documents' sizes and places (one row each), and the plan of each source, broadcast if there are few."""
    rows = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("h")).withColumn("key", _key()), "sizes")
    totals = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    aims = materialize(
        targets(totals.select("source", "source_size"), weights, percent, repeats)
        .withColumn("key", _key())
        .withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(F.lit(0)).cast("long"))
        .withColumn("budget", F.floor("target") - F.col("whole") * F.col("source_size"))
        .withColumn("whole", F.when(F.col("budget") < 0, F.col("whole") - 1).otherwise(F.col("whole")))
        .withColumn("budget", F.floor("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    sent = F.broadcast if aims.count() <= FEW_SOURCES else lambda df: df
    edge = aims.filter("budget > 0").select("key", F.lit(0).cast("long").alias("lo"), F.lit(1 << 60).cast("long").alias("hi"), "budget")
    for level in range(LEVELS):
        edge = materialize(_boundary(rows, sent(edge), level), f"level{level}")
    # Below the last level single hashes are left: their number a source does not grow with the table by more than 2**-36.
    last = rows.join(sent(edge), "key").filter((F.col("h") >= F.col("lo")) & (F.col("h") < F.col("hi"))).groupBy("key", "h", "budget").agg(F.sum("size").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("key").orderBy("h"))
    stop = (
        last.withColumn("upto", upto).filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("n") <= F.col("budget")))
        .select("key", F.col("h").alias("stop"), F.col("n").alias("stop_n"), (F.col("budget") - F.col("upto") + F.col("n")).alias("rest"))
    )
    plan = aims.join(stop, "key", "left").select("key", F.struct("source_size", "target", "whole", "budget", "stop", "stop_n", "rest").alias("plan"))
    return rows, sent(plan)


def _taken() -> Column:
    """The words that the mix takes of a document, from its columns h and size and its source's plan."""
    p, h, size = F.col("plan"), F.col("h"), F.col("size")
    more = (
        F.when(p["budget"] <= 0, 0).when(p["stop"].isNull() | (h < p["stop"]), size)
        .when(h == p["stop"], F.expr("size * plan.rest div plan.stop_n")).otherwise(0)
    )
    return (size * p["whole"] + more).cast("long").alias("taken")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TOTAL_PERCENT, repeats: int = MOST_REPEATS) -> DataFrame:
    """doc_id, size, source_size, target, taken, source of every document.

    size: words of the text (null text: 0).  taken: words the mix takes, repeats
    counted, at most `repeats` times the size.  Every document is taken target
    div source_size times whole; for what is left of the target, once more in the
    order of a hash of doc_id until the words are used up.  The document on the
    boundary is taken in part, so a source's taken words are the whole part of
    its target; rows that share their hash there (repeated ids) share what is
    left by size, rounded down.  Null is a source of its own, the last.  Empty
    texts have size 0 and take 0.  The result depends only on the rows.
    """
    rows, plan = _planned(docs, weights, percent, repeats)
    return rows.join(plan, "key").select("doc_id", "size", "plan.source_size", "plan.target", _taken(), "source")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """Each document with the words the mix takes of it: the columns of docs, then size, target and taken.

    See mix_sources for nulls, empty texts, repeated rows and ties.  Columns of
    docs that are named like the new ones are left out.  Whole rows do not move:
    what is taken follows from the row and its source's plan.
    """
    _, plan = _planned(docs, **how)
    rows = docs.select(whole_row(docs).alias("_row"), word_count(F.col("text")).alias("size"), place(F.col("doc_id")).alias("h"), _key().alias("key"))
    kept = [f"_row.{quoted(c)}" for c in docs.columns if c.lower() not in ("size", "target", "taken")]
    return rows.join(plan, "key").select(*kept, "size", "plan.target", _taken())


def oracle() -> str:
    """DuckDB SQL of op5: the same order of documents, by a sort."""
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * {MOST_REPEATS} AS cap,
        CAST([{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % {len(WEIGHTS)} + 1 AS INT)] AS BIGINT) AS w FROM s),
r AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) * {TOTAL_PERCENT} / 100 AS budget,
        CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS before_cap, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS before_w,
        CAST(sum(w) OVER () AS BIGINT) AS all_w FROM w
      WINDOW b AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, (budget - before_cap) * w / (all_w - before_w) >= cap AS capped FROM r),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
        (budget - CAST(coalesce(sum(CASE WHEN capped THEN cap END) OVER (), 0) AS BIGINT)) * w
        / nullif(all_w - CAST(coalesce(sum(CASE WHEN capped THEN w END) OVER (), 0) AS BIGINT), 0) END AS target FROM c),
p AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), {MOST_REPEATS}) ELSE 0 END AS whole FROM t),
q AS (SELECT d.doc_id, d.size, p.source_size, p.target, p.whole, d.source,
        CAST(floor(p.target) AS BIGINT) - p.whole * p.source_size AS budget,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * whole + greatest(0, least(size, budget - before)) AS BIGINT) AS taken, source FROM q
"""
