"""Routing by tag patterns: an index of the patterns' beginnings in place of comparing each with each.

A pattern asks for a whole tag or for a beginning.  A tag looks up itself and its
beginnings of the lengths that patterns have, by an equi-join; what is found so
matches, nothing else is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns up to which they are sent to all tasks.
BROADCAST_BYTES = 16 << 20
_WHOLE = -1


def _asks(pattern: Column, dotted: bool) -> Column:
    """What a pattern looks for: structs of size (-1: the whole tag) and start."""
    ask = lambda size, start: F.struct(F.lit(size).cast("int").alias("size") if isinstance(size, int) else size.cast("int").alias("size"), start.alias("start"))
    begin = lambda s: ask(F.length(s), s)
    cut = lambda n: F.substr(pattern, F.lit(1), F.length(pattern) - n)
    if dotted:
        part = cut(3)
        whole = F.array(ask(_WHOLE, pattern))
        return F.when(pattern.isin("*", "**"), F.array(begin(F.lit("")))).when(pattern.endswith(".**"), F.array(ask(_WHOLE, part), begin(F.concat(part, F.lit("."))), ask(_WHOLE, pattern))).otherwise(whole)
    return F.when(pattern == "", F.array(begin(pattern))).when(pattern.endswith("*"), F.array(begin(cut(1)))).otherwise(F.array(ask(_WHOLE, pattern)))


def matched_tags(tags: DataFrame, patterns: DataFrame, dotted: bool = False) -> DataFrame:
    """The columns of tags and of patterns, one row for each pattern that a tag matches.

    A pattern that ends in * stands for all tags that begin with what is before
    it, an empty or null one for all.  dotted: `a.**` stands for a and all that
    begins with `a.`, `*` and `**` for all; a null pattern is empty.  Any other is
    the tag itself.  tags have a column tag, patterns a column pattern; their
    other names differ.  A null tag matches none; rows that repeat match each.
    """
    pattern = F.coalesce("pattern", F.lit(""))
    index = patterns.withColumn("_asks", F.explode(F.array_distinct(_asks(pattern, dotted)))).select(*(f"`{c}`" for c in patterns.columns), "_asks.size", "_asks.start")
    found = index.agg(F.collect_set("size").alias("sizes"), F.sum(F.octet_length("start") + 64).alias("bytes")).first()  # a size for each length of a pattern
    tag = F.col("tag")
    begins = [F.struct(F.lit(n).alias("size"), (tag if n == _WHOLE else F.substring(tag, 1, n)).alias("start")) for n in sorted(found["sizes"])]
    if not begins:
        return tags.join(patterns.limit(0), F.lit(False))
    fits = F.filter(F.array(*begins), lambda x: x["size"] <= F.length(tag))
    rows = tags.filter(tag.isNotNull()).select(*(f"`{c}`" for c in tags.columns), F.inline(fits))
    index = F.broadcast(index) if (found["bytes"] or 0) <= BROADCAST_BYTES else index
    pairs = rows.join(index, ["size", "start"])
    return pairs.select(*(f"`{c}`" for c in tags.columns), *(f"`{c}`" for c in patterns.columns))


def counted_tags(tags: DataFrame, patterns: DataFrame, dotted: bool = False) -> DataFrame:
    """patterns with n: how many rows of tags each matches; patterns that match none are left out.

    Each distinct tag meets each distinct pattern once, however many rows repeat
    them, so the work grows with these and not with the pairs of rows.
    """
    counts = tags.groupBy("tag").agg(F.count("*").alias("rows"))
    n = matched_tags(counts, patterns.select("pattern").distinct(), dotted).groupBy("pattern").agg(F.sum("rows").alias("n"))
    n = n.withColumnRenamed("pattern", "counted")
    return patterns.join(n, F.col("pattern").eqNullSafe(F.col("counted"))).drop("counted")


def routed_tags(tags: DataFrame, routes: DataFrame, dotted: bool = False) -> DataFrame:
    """tags with routes: the routes (pattern, ord, route) that each tag matches, in the order of ord; null if none.

    Each distinct tag is looked up once.
    """
    pairs = matched_tags(tags.select("tag").distinct(), routes.select("pattern", "ord", "route"), dotted)
    lists = pairs.groupBy("tag").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "route"))), lambda x: x["route"]).alias("routes"))
    return tags.join(lists, "tag", "left")
