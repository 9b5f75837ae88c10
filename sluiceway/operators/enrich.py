"""Enrichment of messages by lookup tables of any size.

A table is a frame of keys and values; of a repeated key the first entry counts.
A table of at most BROADCAST_BYTES, by its own count, is sent to all tasks.  A
larger one is dealt by key with the messages; keys that many messages have are
split: their messages go to as many places as there are partitions, and each of
these places gets a copy of the few entries.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluiceway.model import Config, Lookup

#: Bytes of keys and values up to which a table is sent to all tasks.
BROADCAST_BYTES = 32 << 20
#: A key is hot if more than one message in so many has it; so there are fewer hot keys than this.
HOT_SHARE = 200


@dataclass
class Table:
    """entries: key, value, one row a key; limit: bytes up to which they are broadcast."""

    entries: DataFrame
    limit: int = BROADCAST_BYTES
    _bytes: list[int] = field(default_factory=list)

    def small(self) -> bool:
        """Whether the entries are within the limit, by their own count, made once."""
        if not self._bytes:
            size = self.entries.agg(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) + 16)).first()[0]
            self._bytes.append(int(size or 0))
        return self._bytes[0] <= self.limit


def lookup_table(rows: DataFrame, key: str, value: str, order: str, nomatch: str | None = None, limit: int = BROADCAST_BYTES) -> Lookup:
    """A lookup table of a frame: the first entry by `order` counts for a key; null keys are none, a null value is empty.

    Entries that are equal in key and order differ by value only; the least counts.
    """
    first = F.min(F.struct(F.col(order).isNull().alias("last"), F.col(order).alias("at"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value")))
    entries = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(first.alias("e")).select("key", "e.value")
    return Lookup(nomatch=nomatch, rows=Table(entries, limit))


def bound(config: Config, **tables: Lookup) -> Config:
    """The configuration with lookup tables that are frames."""
    return replace(config, lookups=config.lookups | tables)


def attach(messages: DataFrame, table: Table, on: str, into: str) -> DataFrame:
    """messages with the column `into`: the value of the key `on`, or null on a miss.

    Null keys miss.  Order and number of the messages stay as they are.
    """
    key, salt = f"{into}_key", f"{into}_salt"
    entries = table.entries.select(F.col("key").alias(key), F.col("value").alias(into))
    if table.small():
        return messages.join(F.broadcast(entries), F.col(on) == F.col(key), "left").drop(key)
    if messages.isStreaming:
        return messages.join(entries, F.col(on) == F.col(key), "left").drop(key)
    hot = hot_keys(messages, on)
    places = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    is_hot = lambda c: F.col(c).isin(hot) if hot else F.lit(False)
    spread = F.pmod(F.xxhash64("idx"), F.lit(places)).cast("int") if "idx" in messages.columns else F.floor(F.rand(7) * places).cast("int")
    salted = messages.withColumn(salt, F.when(F.coalesce(is_hot(on), F.lit(False)), spread).otherwise(F.lit(0)))
    copies = entries.withColumn(salt, F.explode(F.when(is_hot(key), F.sequence(F.lit(0), F.lit(places - 1))).otherwise(F.array(F.lit(0)))))
    match: Column = (salted[on] == copies[key]) & (salted[salt] == copies[salt])
    return salted.join(copies.hint("shuffle_merge"), match, "left").select(*(salted[f"`{c}`"] for c in messages.columns), copies[into])


def hot_keys(messages: DataFrame, on: str) -> list[str]:
    """Keys that more than one in HOT_SHARE messages has: fewer than HOT_SHARE; counted whole, by partial sums."""
    counts = messages.groupBy(on).agg(F.count("*").alias("n"))
    total = messages.agg(F.count("*").alias("total"))
    return [r[0] for r in counts.join(F.broadcast(total)).filter((F.col("n") * HOT_SHARE > F.col("total")) & F.col(on).isNotNull()).select(on).collect()]
