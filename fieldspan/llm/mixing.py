"""Mixing sources to target weights.

Tokens (words) are summed by source, the shares of the mix give each source a
target, target / size is its repetition rate, and every document is emitted
floor(rate) times plus one copy drawn by a hash-seeded Bernoulli trial whose
probability is the rate's fraction.

Plan: one aggregation by source (map-side partial sums, so that a source with a
third of all rows sends one row a task), windows over one row a source, written
once to the shared folder, and a join of the documents with that table: a broadcast while there are at most
``BROADCAST_SOURCES`` sources, else a join of which the hot keys are split by
adaptive execution. The documents themselves are never shuffled then.

Defined cases: a null text counts 0 words; a null source is a source of its own,
last in order; repeated rows and ids each count, and equal ids draw alike; a null
id draws as the empty string; a source without words has rate 0; an empty table
gives an empty mix. Columns of the operator replace input columns of their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.llm.common import cut, free, table

WORD = r"[^\x20\x09-\x0D]+"
MAX_RATE = 3.0
BROADCAST_SOURCES = 100_000
SEED = "mix"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(documents: DataFrame, max_rate: float = MAX_RATE) -> DataFrame:
    """One row a source: source, source_size, target.

    With the ratios max_rate * size / weight in order, the first k sources stop at
    their cap and the others share the rest by weight, for the least k at which
    none of those is above its own cap.
    """
    sizes = documents.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = (F.lit(max_rate) * F.col("source_size")) / F.col("weight")
    ranked = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("ratio", ratio)
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    levels = ranked.select(
        "*",
        F.row_number().over(order).alias("position"),
        (
            (F.sum("source_size").over(everything) - F.lit(max_rate) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        ).alias("level"),
    )
    fits = F.col("level") <= F.col("ratio")
    chosen = levels.select(
        "*",
        F.min(F.when(fits, F.col("position"))).over(everything).alias("first_free"),
        F.min_by("level", F.when(fits, F.col("position"))).over(everything).alias("chosen_level"),
    )
    target = F.when(F.col("position") < F.col("first_free"), F.lit(max_rate) * F.col("source_size")).otherwise(F.col("weight") * F.col("chosen_level"))
    return chosen.select("source", "source_size", target.cast("double").alias("target"))


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 48 bits of an MD5 of the seed and the id."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def _planned(documents: DataFrame, max_rate: float, seed: str) -> tuple[DataFrame, str]:
    """The documents with struct<source_size, target, copies> behind their columns, and its name."""
    named, plan = free(documents.columns, "__source"), free(documents.columns, "__plan")
    planned = source_targets(documents.select("source", "text"), max_rate)
    targets = cut(planned.select(F.col("source").alias(named), F.struct("source_size", "target").alias(plan)))
    if targets.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    size, target = F.col(plan)["source_size"], F.col(plan)["target"]
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    extra = (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    joined = documents.join(targets, documents["source"].eqNullSafe(F.col(named)), "left")
    taken = F.struct(size.alias("source_size"), target.alias("target"), (F.floor(rate) + extra).alias("copies"))
    return joined.withColumn(plan, taken).drop(named), plan


def mix(documents: DataFrame, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The documents with source_size, target and copies, the times each is emitted; these replace columns of their names."""
    planned, plan = _planned(documents, max_rate, seed)
    return planned.withColumns({c: F.col(plan)[c] for c in ("source_size", "target", "copies")}).drop(plan)


def emit(documents: DataFrame, max_rate: float = MAX_RATE, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with all of the input's columns."""
    planned, plan = _planned(documents, max_rate, seed)
    kept = planned.filter(F.col(plan)["copies"] > 0)
    return kept.withColumn(plan, F.explode(F.sequence(F.lit(1), F.col(plan)["copies"]))).select(*documents.columns)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    size = words(F.col("text"))
    return mix(documents).select("doc_id", size.alias("size"), "source_size", "target", (F.col("copies") * size).alias("taken"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM sources
), ratios AS (
  SELECT *, (CAST(3.0 AS DOUBLE) * source_size) / weight AS ratio FROM weighted
), levels AS (
  SELECT *, row_number() OVER o AS position,
    (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(3.0 AS DOUBLE) * CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE))
      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM ratios
  WINDOW o AS (ORDER BY ratio, source ASC NULLS LAST),
         b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT position AS first_free, level AS chosen_level FROM levels WHERE level <= ratio ORDER BY position LIMIT 1
), targets AS (
  SELECT source, source_size,
    CASE WHEN position < first_free THEN CAST(3.0 AS DOUBLE) * source_size ELSE weight * chosen_level END AS target
  FROM levels, chosen
), rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE CAST(0 AS DOUBLE) END AS rate,
    CAST(CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656 AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
