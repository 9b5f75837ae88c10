"""Chat formatting with collapse of cumulative snapshots.

A logged conversation that another continues is a prefix of it, turn by turn.
Each turn gets a rolling hash of its conversation up to there: an exclusive-or
over hashes of (place, role, text), in two words of 64 bits, so it is a window
aggregate.  An anti-join drops conversations whose last hash is an inner hash of
a longer one; of equal conversations the least id stays.  The rest is rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The text around a turn.
BEFORE, BETWEEN, AFTER = "<|im_start|>", "\n", "<|im_end|>\n"


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, place, role, text, h1, h2: each turn with the hash of its conversation up to it.

    Turns stand in the order of turn, role, text, nulls first; a row equal in all
    of them to another counts once.  Rows without conv_id belong to none.
    """
    rows = turns.select("conv_id", "turn", "role", "text").filter(F.col("conv_id").isNotNull()).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    content = [F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    placed = rows.withColumn("place", F.row_number().over(order))
    for k in (1, 2):
        placed = placed.withColumn(f"x{k}", F.xxhash64(F.lit(k), "place", *content))
    return placed.select("conv_id", "place", "role", "text", *(F.bit_xor(f"x{k}").over(upto).alias(f"h{k}") for k in (1, 2)))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same of the conversations that are no prefix of another.

    n_same: how many conversations have the same turns; the least conv_id stays
    for them.
    """
    hashed = prefix_hashes(turns).drop("role", "text")
    ends = hashed.groupBy("conv_id").agg(F.max_by(F.struct("h1", "h2"), "place").alias("h"), F.max("place").alias("n_turns"))
    ends = ends.select("conv_id", "n_turns", "h.h1", "h.h2")
    whole = ends.groupBy("h1", "h2", "n_turns").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_same"))
    # A hash at a place before a conversation's last; equal prefixes of many conversations become one row before the join.
    last = Window.partitionBy("conv_id")
    inner = hashed.withColumn("n", F.max("place").over(last)).filter("place < n").select("h1", "h2", F.col("place").alias("n_turns")).distinct()
    kept = whole.join(inner, ["h1", "h2", "n_turns"], "left_anti")
    return kept.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_same")


def render_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same, text of each maximal conversation.

    text: the turns in order, each as {BEFORE}role newline text{AFTER}; a null
    role is `unknown`, a null text empty.  Repeated rows count once; other
    columns are ignored; an empty table gives no row.
    """
    kept = maximal_conversations(turns)
    one = F.concat(F.lit(BEFORE), F.coalesce("role", F.lit("unknown")), F.lit(BETWEEN), F.coalesce("text", F.lit("")), F.lit(AFTER))
    rows = prefix_hashes(turns).join(kept.select("conv_id"), "conv_id", "left_semi").select("conv_id", F.struct("place", one.alias("s")).alias("t"))
    texts = rows.groupBy("conv_id").agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("t")), lambda t: t["s"])).alias("text"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_same", "text")


def oracle() -> str:
    """DuckDB SQL of op3: prefixes compared as whole strings."""
    return r"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM r),
s AS (SELECT conv_id, place, '<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS t,
        coalesce(role, chr(0)) || chr(1) || coalesce(text, chr(0)) || chr(2) AS k FROM p),
u AS (SELECT *, string_agg(k, '') OVER w AS upto, max(place) OVER (PARTITION BY conv_id) AS n FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
e AS (SELECT upto, n, min(conv_id) AS conv_id, count(*) AS n_same FROM u WHERE place = n GROUP BY upto, n),
m AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.place < u.n AND u.place = e.n AND u.upto = e.upto))
SELECT m.conv_id, CAST(m.n AS BIGINT) AS n_turns, CAST(m.n_same AS BIGINT) AS n_same, string_agg(s.t, '' ORDER BY s.place) AS text
FROM m JOIN s ON s.conv_id = m.conv_id GROUP BY m.conv_id, m.n, m.n_same
"""
