"""Scoring: value matching, field scores, record pairing, percentiles, regression gates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.functions.text import fold


def number(value: Column) -> Column:
    """A text as a double, null if it isn't one. What can't be one isn't cast: each such cast throws inside, dear over many rows."""
    return F.when(value.rlike(r"(?i)[0-9]|inf|nan"), value.try_cast("double"))


def values_match(expected: Column, actual: Column, relative: float = 0.0, absolute: float = 0.0, numbers: tuple[Column, Column] | None = None) -> Column:
    """Equality of two values given as text: numbers within tolerance, else folded strings; a bool is never a number. ``numbers``: the two as ``number`` reads them, if that is done."""
    boolean = lambda c: F.lower(c).isin("true", "false")
    a, b = numbers or (number(expected), number(actual))
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(a) * relative)
    return F.when(boolean(expected) != boolean(actual), F.lit(False)).when(a.isNotNull() & b.isNotNull(), near).when(F.lower(expected) == F.lower(actual), F.lit(True)).otherwise(fold(expected) == fold(actual))


def outcome(expected: Column, actual: Column, match: Column) -> Column:
    """correct, wrong, missing, spurious or empty, for a pair of values of which either may be null."""
    return (
        F.when(expected.isNull() & actual.isNull(), "empty")
        .when(actual.isNull(), "missing")
        .when(expected.isNull(), "spurious")
        .when(match, "correct")
        .otherwise("wrong")
    )


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, null on an empty whole."""
    return F.when(whole != 0, part.cast("double") / whole)


def field_scores(pairs: DataFrame, by: str = "field") -> DataFrame:
    """Counts, precision, recall and accuracy of (field, outcome) rows, by field and over all (field null)."""
    kinds = ("correct", "wrong", "missing", "spurious", "empty")
    counted = pairs.rollup(by).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in kinds])
    c, w, m, s = (F.col(k) for k in kinds[:4])
    return counted.select(by, *kinds, ratio(c, c + w + s).alias("precision"), ratio(c, c + w + m).alias("recall"), ratio(c, c + w + m + s).alias("accuracy"))


def match_records(agreements: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs a document: most agreement first, then equal labels, then earlier places.

    agreements: doc, expected_at, found_at, agreement, same_label. A document's
    pairs are one sorted array, folded into those that are kept.
    """
    state = "struct<left:array<bigint>,right:array<bigint>,kept:array<struct<expected_at:bigint,found_at:bigint,agreement:bigint>>>"
    item = F.struct((-F.col("agreement")).alias("a"), (-F.col("same_label")).alias("s"), F.col("expected_at").alias("e"), F.col("found_at").alias("f"))

    def add(held: Column, x: Column) -> Column:
        taken = F.struct(
            F.array_append(held["left"], x["e"]).alias("left"),
            F.array_append(held["right"], x["f"]).alias("right"),
            F.array_append(held["kept"], F.struct(x["e"].alias("expected_at"), x["f"].alias("found_at"), (-x["a"]).alias("agreement"))).alias("kept"),
        ).cast(state)
        return F.when(F.array_contains(held["left"], x["e"]) | F.array_contains(held["right"], x["f"]), held).otherwise(taken)

    empty = F.struct(F.array().alias("left"), F.array().alias("right"), F.array().alias("kept")).cast(state)
    pairs = agreements.filter("agreement > 0").groupBy("doc").agg(F.array_sort(F.collect_list(item)).alias("pairs"))
    return pairs.select("doc", F.explode(F.aggregate("pairs", empty, add)["kept"]).alias("k")).select("doc", "k.*")


def list_scores(expected: Column, found: Column) -> Column:
    """struct<correct, missing, spurious>: a multiset match of two arrays, each item once."""

    def times(items: Column, x: Column) -> Column:
        return F.size(F.filter(items, lambda y: y == x))

    both = F.array_distinct(expected)
    correct = F.aggregate(both, F.lit(0), lambda n, x: n + F.least(times(expected, x), times(found, x)))
    return F.struct(correct.alias("correct"), (F.size(expected) - correct).alias("missing"), (F.size(found) - correct).alias("spurious"))


def latency(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact interpolated p50 and p95 by group."""
    return rows.groupBy(by).agg(F.expr(f"percentile({value}, 0.5)").alias("p50"), F.expr(f"percentile({value}, 0.95)").alias("p95"), F.count("*").alias("n"))


#: P(a Poisson(1) count is at most n), by n.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676, 0.99998975)


def resample_counts(keys: np.ndarray, resamples: int, seed: int) -> np.ndarray:
    """How often each row (by key) is drawn in each resample: Poisson(1), from a 32-bit hash of both and the seed."""
    mixed = (keys.astype(np.uint64)[:, None] % np.uint64(1 << 32) * np.uint64(2_654_435_761) + np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(40_503) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
    for shift, factor in ((15, 2_246_822_519), (13, 3_266_489_917)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor) & np.uint64(0xFFFFFFFF)
    mixed ^= mixed >> np.uint64(16)
    return np.searchsorted(np.array(POISSON), mixed / 4_294_967_296.0, side="left")


def poisson_bootstrap(rows: DataFrame, key: str, value: str, weight: str, resamples: int = 200, seed: int = 42) -> DataFrame:
    """Weighted mean with a 95% bootstrap interval; every row draws Poisson(1) counts, so no task holds all rows.

    A row's counts depend on its key alone, so the interval doesn't on partitions
    or their order. Partial sums of each resample are made a partition, some
    thousand rows at a time, and added by resample.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((2, resamples))
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.iloc[at : at + 4096]
                x, w = part[value].to_numpy(float), part[weight].to_numpy(float)
                counts = resample_counts(part[key].to_numpy(np.int64), resamples, seed)
                sums += [(counts * (x * w)[:, None]).sum(axis=0), (counts * w[:, None]).sum(axis=0)]
        yield pd.DataFrame({"resample": np.arange(resamples), "xw": sums[0], "w": sums[1]})

    means = rows.select(key, value, weight).mapInPandas(run, "resample int, xw double, w double").groupBy("resample").agg((F.sum("xw") / F.sum("w")).alias("mean"))
    interval = means.agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))
    return rows.agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("mean")).join(F.broadcast(interval))


def check_baseline(report: DataFrame, baseline: DataFrame, accuracy_slack: float = 0.02, field_slack: float = 0.05) -> DataFrame:
    """field, was, now, passed: a field passes while it fell by no more than the slack; the null field is the whole."""
    slack = F.when(F.col("field").isNull(), F.lit(accuracy_slack)).otherwise(F.lit(field_slack))
    joined = baseline.alias("b").join(report.alias("r"), F.col("b.field").eqNullSafe(F.col("r.field")), "left")
    both = joined.select(F.col("b.field").alias("field"), F.col("b.accuracy").alias("was"), F.col("r.accuracy").alias("now"))
    return both.withColumn("passed", F.coalesce(F.col("now"), F.lit(0.0)) >= F.col("was") - slack - 1e-9)
