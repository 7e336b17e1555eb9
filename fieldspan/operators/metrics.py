"""Metrics over operational rows: curves, shares, spend, windows, statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.operators.storage import cut


def buckets(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The rows with bucket, from 1: at most ``most`` consecutive ranges of equal size, of which the last may be smaller."""
    size = F.ceil(F.col("total") / most)
    return ranked(rows, order).withColumn("bucket", F.floor((F.col("place") - 1) / size).cast("long") + 1)


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with place (from 1) in a total order and total, without a single-partition window.

    Rows are range-partitioned and sorted by the order, and numbered where they
    lie; that numbering is written once, to the shared folder. Both the sizes of
    the partitions and the rows come from there, so that they agree whatever
    bounds were sampled and however partitions were coalesced. Two places of one
    order value may change between runs. One shuffle, and one row a partition is
    broadcast.
    """
    numbered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33).alias("__part")
    counts = numbered.groupBy(part).agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("total", F.sum("__n").over(Window.partitionBy(F.lit(1)))).drop("__n")
    own = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.select("*", part).join(F.broadcast(before), "__part").withColumn("place", own + F.col("__before")).drop("__part", "__id", "__before")


def learning_curve(rows: DataFrame, order: str, measures: dict[str, Column], most: int = 60) -> DataFrame:
    """A row for each bucket of the documents in order: first, last, size and the measures."""
    found = buckets(rows, order, most)
    return found.groupBy("bucket").agg(F.min("place").alias("first"), F.max("place").alias("last"), F.count("*").alias("size"), *[m.alias(k) for k, m in measures.items()])


def weighted(measure: str, size: str = "size") -> Column:
    """The mean of a measure over points of several documents each; 0 without documents."""
    return F.coalesce(F.sum(F.coalesce(F.col(measure), F.lit(0.0)) * F.col(size)) / F.nullif(F.sum(size), F.lit(0)), F.lit(0.0))


def measured(measure: str, size: str = "size") -> Column:
    """As ``weighted``, null counting as 0, but null where no point has the measure."""
    return F.when(F.count(measure) > 0, weighted(measure, size))


def scored(measure: str, size: str = "size") -> Column:
    """The mean over the points that have the measure, null without any."""
    known = F.when(F.col(measure).isNotNull(), F.col(size))
    return F.sum(F.col(measure) * F.col(size)) / F.nullif(F.sum(known), F.lit(0))


def merged_points(points: DataFrame, order: str, means: list[str], measured_means: list[str], scored_means: list[str], most: int = 60) -> DataFrame:
    """The points of a curve in at most ``most`` buckets: documents and generators of the last, sizes added, waves listed, averages by size.

    points: order, documents, size, generators, wave and the measures.
    """
    found = buckets(points, order, most)
    measures = [weighted(c).alias(c) for c in means] + [measured(c).alias(c) for c in measured_means] + [scored(c).alias(c) for c in scored_means]
    return found.groupBy("bucket").agg(
        F.max_by("documents", "place").alias("documents"),
        F.sum("size").alias("size"),
        F.max_by("generators", "place").alias("generators"),
        F.array_join(F.array_sort(F.collect_set("wave")), ",").alias("waves"),
        *measures,
    )


def tenths(points: DataFrame, order: str, measure: str, size: str | None = None) -> DataFrame:
    """The mean of the first and last max(1, n // 10) points, by their ``size`` if there is one, and the relative change, null on a base of 0."""
    found = ranked(points, order)
    share = F.greatest(F.lit(1), F.floor(F.col("total") / 10))
    weight = F.col(size) if size else F.lit(1)
    mean = lambda within: F.sum(F.when(within, F.col(measure) * weight)) / F.nullif(F.sum(F.when(within, weight)), F.lit(0))
    ends = found.agg(mean(F.col("place") <= share).alias("first_tenth"), mean(F.col("place") > F.col("total") - share).alias("last_tenth"))
    return ends.withColumn("change", F.when(F.col("first_tenth") != 0, F.col("last_tenth") / F.col("first_tenth") - 1))


def field_windows(documents: DataFrame, values: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """field, documents, found, values, generated, mean_confidence over documents that didn't fail.

    documents: doc, status, schemas (array). values: doc, field ("Schema.name"),
    method, confidence. ``documents`` counts those with the field's schema, ``found``
    those with a value of it; values of a schema the document doesn't have don't
    count. Fields of ``named`` are there without values too.
    """
    ran = documents.filter(F.col("status") != "failed")
    schema = F.split_part(F.col("field"), F.lit("."), F.lit(1))
    counts = ran.select("doc", F.explode(F.array_distinct("schemas")).alias("schema")).groupBy("schema").agg(F.count("*").alias("documents"))
    kept = values.join(ran.select("doc", "schemas"), "doc").filter(F.array_contains("schemas", schema))
    told = kept.groupBy("field").agg(F.count_distinct("doc").alias("found"), F.count("*").alias("values"), F.count_if(F.col("method") == "generated").alias("generated"), F.avg("confidence").alias("mean_confidence"))
    if named is not None:
        told = told.join(named.select("field").distinct(), "field", "full_outer")
    joined = told.withColumn("schema", schema).join(counts, "schema", "left")
    return joined.select("field", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "found", "values", "generated")], "mean_confidence")


def field_drift(observed: DataFrame) -> DataFrame:
    """field, records, found, none_rate, fallback_rate, mean_confidence of observations (field, found, method, confidence), each record of a schema."""
    told = observed.groupBy("field").agg(F.count("*").alias("records"), F.count_if("found").alias("found"), F.count_if(F.col("method") == "generated").alias("generated"), F.avg("confidence").alias("mean_confidence"))
    fallback = F.when(F.col("found") > 0, F.col("generated") / F.col("found")).otherwise(F.lit(0.0))
    return told.select("field", "records", "found", (1 - F.col("found") / F.col("records")).alias("none_rate"), fallback.alias("fallback_rate"), "mean_confidence")


def method_shares(rows: DataFrame, method: str, by: Sequence[str] = ()) -> DataFrame:
    """Count and share of each method, of all rows or by group."""
    counted = rows.groupBy(*by, method).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(*(by or [F.lit(1)]))
    return counted.withColumn("share", F.col("n") / F.sum("n").over(whole))


def nano(amount: Column) -> Column:
    """An amount of dollars in integer nano-dollars, exact to add."""
    return F.round(amount.cast("decimal(28,9)") * 1_000_000_000, 0).cast("long")


def running_spend(entries: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """The entries with the running total of their group in order, in nano-dollars."""
    over = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("running_nano", F.sum("nano").over(over))


def first_waves(rows: DataFrame, order: str, wave: str) -> DataFrame:
    """Each wave's first place."""
    return rows.groupBy(wave).agg(F.min(order).alias("first_seen"))


def change_points(rows: DataFrame, by: str, order: str, wave: str) -> DataFrame:
    """The rows where the wave differs from the row before, in order within a group."""
    before = F.lag(wave).over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("before", before).filter(F.col("before").isNull() | (F.col("before") != F.col(wave)))


def last_rows(rows: DataFrame, by: str, order: Sequence[Column], n: int) -> DataFrame:
    """The newest n rows of each group."""
    return rows.withColumn("__newest", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("__newest") <= n).drop("__newest")


def drift(rows: DataFrame, by: str, order: Sequence[Column], size: int = 200) -> DataFrame:
    """Of each group's last ``size`` rows: rows, none rate, fallback rate, mean confidence.

    rows: confidence (null: no value) and fallback (boolean).
    """
    kept = last_rows(rows, by, order, size)
    return kept.groupBy(by).agg(
        F.count("*").alias("n"),
        F.avg(F.col("confidence").isNull().cast("double")).alias("none_rate"),
        F.avg(F.col("fallback").cast("double")).alias("fallback_rate"),
        F.avg("confidence").alias("mean_confidence"),
    )


def field_stats(values: DataFrame, lowest: int = 3) -> DataFrame:
    """By field: values, mean confidence, share of nulls and the lowest confidences, comma-joined.

    The lowest come from a window whose limit works before its shuffle.
    """
    totals = values.groupBy("field").agg(F.count("confidence").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg(F.col("confidence").isNull().cast("double")).alias("none_rate"))
    order = Window.partitionBy("field").orderBy("confidence", "id")
    least = values.filter(F.col("confidence").isNotNull()).withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= lowest)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "id"))), lambda s: s["id"].cast("string")), ",")
    return totals.join(least.groupBy("field").agg(text.alias("lowest")), "field", "left")


def processed_by(asked: DataFrame, done: DataFrame, when: str, at: str) -> DataFrame:
    """For each asked row, how many done rows have a time at or before its own: an as-of count.

    Both are counted by time first and added up in one order, so the join is a
    running sum over distinct times by day, and not a comparison of pairs.
    """
    points = done.groupBy(F.col(at).alias("t")).agg(F.count("*").alias("n")).withColumn("asked", F.lit(0)).union(asked.select(F.col(when).alias("t")).distinct().select("t", F.lit(0).cast("long"), F.lit(1)))
    merged = points.groupBy("t").agg(F.sum("n").alias("n"), F.max("asked").alias("asked")).withColumn("day", F.date_trunc("month", "t"))
    days = merged.groupBy("day").agg(F.sum("n").alias("d"))
    before = days.withColumn("before", F.coalesce(F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("d")
    within = F.sum("n").over(Window.partitionBy("day").orderBy("t").rowsBetween(Window.unboundedPreceding, 0))
    counted = merged.withColumn("own", within).join(F.broadcast(before), "day").filter("asked = 1")
    return asked.join(counted.select(F.col("t").alias(when), (F.col("own") + F.col("before")).alias("processed")), when)


def thin(rows: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` evenly spaced rows in order, the last kept."""
    step = F.greatest(F.lit(1.0), F.col("total") / most)
    found = ranked(rows, order)
    return found.filter((F.floor(F.col("place") / step) > F.floor((F.col("place") - 1) / step)) | (F.col("place") == F.col("total"))).drop("total")
