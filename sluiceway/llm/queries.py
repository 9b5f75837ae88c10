"""The registered queries of the corpus operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sluiceway.llm.ann import nearest
from sluiceway.llm.chat import oracle as chat_sql
from sluiceway.llm.chat import render_conversations
from sluiceway.llm.collocations import collocations
from sluiceway.llm.collocations import oracle as collocations_sql
from sluiceway.llm.decontam import find_leaks
from sluiceway.llm.hard_negatives import mine_hard_negatives
from sluiceway.llm.hard_negatives import oracle as hard_negatives_sql
from sluiceway.llm.langid import identify
from sluiceway.llm.lm_score import score_documents
from sluiceway.llm.mixing import mix_sources
from sluiceway.llm.mixing import oracle as mixing_sql
from sluiceway.llm.near_dup import near_duplicates
from sluiceway.llm.packing import pack_documents
from sluiceway.llm.pii import DEMO_KEY, SETTING, pseudonymise
from sluiceway.llm.suffix_dedup import remove_repeats
from sluiceway.llm.toxicity import score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the bytes of 100-byte strings that start earlier; see remove_repeats for nulls, ties and repeated rows."""
    return remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents; see score_documents."""
    return score_documents(_table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal conversations, rendered; see render_conversations."""
    return render_conversations(_table(spark, sf_dir, "conversations"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document; see near_duplicates."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; see mix_sources."""
    return mix_sources(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of each document; see score_toxicity."""
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found for each query; see nearest."""
    return nearest(_table(spark, sf_dir, "embeddings"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test items that documents hold; see find_leaks."""
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with personal values replaced, under the session's key (DEMO_KEY if it names none)."""
    return pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(SETTING, DEMO_KEY))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of each document; see identify."""
    return identify(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language; see collocations."""
    return collocations(_table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives beside each anchor's positives; see mine_hard_negatives."""
    return mine_hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in sequences of 4,096 ids; see pack_documents."""
    import public_tokenizers

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")).drop("ids")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_lm_score, op3_chat, op4_near_duplicates, op5_mixing, op6_toxicity, op7_ann, op8_decontamination, op9_pii, op10_language, op11_collocations, op12_hard_negatives, op13_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op3_chat": chat_sql(), "op5_mixing": mixing_sql(), "op11_collocations": collocations_sql(), "op12_hard_negatives": hard_negatives_sql()}
