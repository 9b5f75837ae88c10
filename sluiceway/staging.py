"""Tables that end a lineage: written to the folder that all machines share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """This application's folder in the one that spark.checkpoint.dir names; it goes when the driver ends.  Only a local session may leave the setting out."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = tempfile.mkdtemp(prefix="sluiceway-")
        spark.conf.set("spark.checkpoint.dir", named)
    root = f"{named.rstrip('/')}/sluiceway-steps/{spark.sparkContext.applicationId}"
    if root not in _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _made.add(root)
    return root


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: what is lost later is read, not computed, again."""
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
