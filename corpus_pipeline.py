"""From raw documents to packed training sequences: quality, toxicity, near-duplicates, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trellis.llm import dedup, mixing, packing, quality, toxicity
from trellis.llm.queries import quality_model, tokenizer, toxicity_model
from trellis.llm.shared import bound_batches, cut, ship


def ready(spark: SparkSession) -> None:
    """What each stage needs: the package on the executors, and batches that leave their memory to the five stages' buffers
    and tables, which add up when one application runs them all."""
    ship(spark)
    bound_batches(spark)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality score is at least 0.7, by a model fitted on labelled documents outside the held-out
    quarter."""
    ready(spark)
    return quality.keep_good(docs, quality_model(spark, docs, sf_dir), 0.7)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity score is below 0.5, by a model fitted on labelled documents outside the held-out
    fifth."""
    ready(spark)
    return toxicity.keep_clean(docs, toxicity_model(spark, docs, sf_dir), 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (similarity 0.8 or more), that with the smallest doc_id."""
    ready(spark)
    return dedup.drop_near_duplicates(docs, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with mix_slot and mix_place: their order by the Pfair schedule of their sources (weights: square
    roots of the sources' sizes)."""
    ready(spark)
    return mixing.in_order(docs, places=True)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids in sequences of 4096: one row per piece, with its sequence and offset. Sequences are
    numbered by the schedule of the stage before."""
    ready(spark)
    return packing.pack_documents(docs, tokenizer(), capacity=4096, end_id=1, order=["mix_slot", "mix_place"])


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_clean),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifiers can't be expressed in SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the documents table, each on what its predecessor has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
