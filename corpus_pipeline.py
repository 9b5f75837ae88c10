"""A corpus pipeline: five stages, each one of the corpus operators on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import materialize
from sluiceway.llm.decontam import drop_leaks
from sluiceway.llm.mixing import mixed_documents
from sluiceway.llm.near_dup import drop_near_duplicates
from sluiceway.llm.pii import DEMO_KEY, SETTING, replaced_text
from sluiceway.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; it learns from the labels of those given.

    Null and empty texts get the bias's score; repeated rows are judged each.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least doc_id.

    Texts without words and rows without doc_id stay; equal rows come down to one.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item.

    Null and empty texts and rows without doc_id stay; rows of one doc_id go together.
    """
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal values replaced under the session's key; n_chars follows the text.

    Null texts stay null (and get a null n_chars), rows that repeat an id or a
    text are treated alike, and columns of any other name pass through.
    """
    out = replaced_text(docs, spark.conf.get(SETTING, DEMO_KEY))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes words, with size, target and taken.

    Texts without words have no words to take, so they go.  Null is a source of
    its own; rows that repeat a doc_id count each.
    """
    return mixed_documents(docs).filter("taken > 0")


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pseudonyms", pseudonyms), ("mixture", mixture)]

#: No SQL: the classifier and the sketches are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the documents of sf_dir; each stage is written as Parquet and reread.

    Columns of documents named size, target or taken give way to the mixture's.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
