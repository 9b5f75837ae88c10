"""Lines of files in their order, without a sort.

Spark reads a file in stretches and numbers the rows of each task as they come.
So a line's place is the number of lines in the stretches before its own, one row
a stretch, plus its place in the stretch, the distance to the stretch's first
row.  Lines do not move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of the table of stretches up to which it is sent to all tasks.
BROADCAST_BYTES = 32 << 20


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """idx, file, value: the lines of text files, by file name and place, idx from 1.

    Empty lines count and stay; files of one name in different folders go by folder.
    """
    place = F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seen")
    rows = spark.read.text(path, recursiveFileLookup=True).select(*place, "value")
    stretches = rows.groupBy("file", "start").agg(F.min("seen").alias("first"), F.count("*").alias("n"))
    # One row a stretch, dealt by nothing: some hundred bytes for each 128 MB of text.
    before = Window.orderBy("file", "start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stretches.select("file", "start", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    size = stretches.agg(F.sum(F.octet_length("file") + 32)).first()[0] or 0
    joined = rows.join(F.broadcast(offsets) if size <= BROADCAST_BYTES else offsets, ["file", "start"])
    return joined.select((F.col("before") + F.col("seen") - F.col("first") + 1).alias("idx"), "file", "value")


def first_messages(messages: DataFrame, most: int) -> DataFrame:
    """The messages a batch runs: those of the least idx, as far as `most` reaches where idx counts from 1."""
    return messages.filter(F.col("idx") <= most)
