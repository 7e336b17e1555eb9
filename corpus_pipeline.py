"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldspan.llm.stages import STAGES, run_stages

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences of ``documents`` after every stage."""
    return run_stages(spark, sf_dir)


__all__ = ["ORACLE_SQL", "STAGES", "run"]
