"""The stages of the corpus pipeline.

Each takes (spark, docs, sf_dir) and returns a DataFrame; between two stages the
documents are a Parquet table in the shared folder, so that a lost executor costs
tasks of one stage only. A stage's table is deleted once the next one's is written,
the last at the driver's end.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm import mixing, packing, pii, simhash, toxicity
from fieldspan.llm.common import drop, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents below the toxicity threshold; learned from the labels of this corpus."""
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, scorer).filter(F.col("score") < toxicity.THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component the row of the least (doc_id, fingerprint), a null id last; of repeated rows one."""
    return simhash.representatives(docs).select(*docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, personal data replaced by its kind; n_chars follows the text.

    Twice, as a replaced span may free a number that it was joined to.
    """
    clean = pii.redact(pii.redact(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]


def run_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        if k:
            drop(spark, f"{out}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
