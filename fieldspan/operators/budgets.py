"""Budgets: calendar periods, caps, rate limits and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def period_start(period: str, when: Column) -> Column:
    """The start of the UTC hour, day, ISO week (Monday) or month."""
    return F.date_trunc(period, when)


def spent(entries: DataFrame, period: str, when: str = "ts") -> DataFrame:
    """period, nano: what each calendar period took."""
    return entries.groupBy(period_start(period, F.col(when)).alias("period")).agg(F.sum("nano").alias("nano"))


def headroom(totals: DataFrame, limit_nano: int) -> DataFrame:
    """The totals with what is left of the limit, at least 0."""
    return totals.withColumn("left_nano", F.greatest(F.lit(limit_nano) - F.col("nano"), F.lit(0)).cast("long"))


def calls_in_window(calls: DataFrame, by: str, when: str = "ts", seconds: int = 60) -> DataFrame:
    """The calls with how many of their group fell in the seconds up to and with them."""
    micros = F.unix_micros(F.col(when).cast("timestamp"))
    over = Window.partitionBy(by).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, 0)
    return calls.withColumn("calls", F.count("*").over(over))


def document_caps(rows: DataFrame, by: str, order: list[str], max_calls: int, max_nano: int) -> DataFrame:
    """Of each document's calls in order, those that its caps admit."""
    over = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("call", F.row_number().over(Window.partitionBy(by).orderBy(*order))).withColumn("running", F.sum("nano").over(over))
    return counted.withColumn("admitted", (F.col("call") <= max_calls) & (F.col("running") <= max_nano))


def try_spend(entries: DataFrame, by: str, max_count: int) -> DataFrame:
    """Check and append in order: an entry is admitted while count + 1 is at most the cap."""
    return entries.withColumn("admitted", F.row_number().over(Window.partitionBy(by).orderBy("ts", "event_id")) <= max_count)
