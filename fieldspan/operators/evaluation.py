"""Scores of whole runs: documents, records, systems, batches of a replay, baselines.

Relations: expected and found values are (doc, schema, entity, field, value); a run
is a row a document with its times, costs and status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.functions.units import UNITS
from fieldspan.operators.evaluate import number, outcome, ratio, values_match


def tolerances(fields: DataFrame, defaults: dict[str, tuple[float, float]], overrides: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """fields (schema, field, kind) with relative and absolute: of `Schema.field`, else of the field, else of its kind, else 0."""
    found: list[Column] = []
    for name in (F.concat_ws(".", "schema", "field"), F.col("field")):
        found += [F.when(name == k, F.struct(F.lit(float(r)).alias("relative"), F.lit(float(a)).alias("absolute"))) for k, (r, a) in (overrides or {}).items()]
    found += [F.when(F.col("kind") == k, F.struct(F.lit(float(r)).alias("relative"), F.lit(float(a)).alias("absolute"))) for k, (r, a) in defaults.items()]
    zero = F.struct(F.lit(0.0).alias("relative"), F.lit(0.0).alias("absolute"))
    return fields.withColumn("__t", F.coalesce(*found, zero)).select(*fields.columns, "__t.relative", "__t.absolute")


def rounding_slack(unit: str) -> float:
    """How far a whole number in a unit within a factor of two can be off in this one, at most: half such a unit; 0 if there is none."""
    if unit not in UNITS or UNITS[unit][0] == "economy":
        return 0.0
    kind, factor, _ = UNITS[unit]
    others = [f / factor for name, (k, f, _) in UNITS.items() if k == kind and name != unit and f != factor]
    return max((one / 2 for one in others if 0.5 <= one <= 2.0), default=0.0)


def outcomes(pairs: DataFrame, relative: Column, absolute: Column) -> DataFrame:
    """pairs (expected, found, each null where there is none) with outcome."""
    read = pairs.withColumns({"__expected": number(F.col("expected")), "__found": number(F.col("found"))})
    a, b = F.col("__expected"), F.col("__found")
    match = F.coalesce(F.abs(a - b) <= F.greatest(absolute, relative * F.abs(a)), F.lit(False))
    return read.withColumn("outcome", outcome(F.col("expected"), F.col("found"), match | values_match(F.col("expected"), F.col("found"), numbers=(a, b)))).drop("__expected", "__found")


def document_scores(pairs: DataFrame, runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """doc with its counts of outcomes; every expected value of a failed document is missing, what it found doesn't count.

    pairs: doc, schema, field, expected, found, outcome; runs: doc, status; ``by``: columns of
    both, such as the system, before doc. Values of a foreign schema have no expected value,
    hence are spurious. The pairs are counted before their document's run is looked up.
    """
    key = [*by, "doc"]
    return _of_runs(pairs.groupBy(*key).agg(*_counts()), runs, key)


KINDS = ("correct", "wrong", "missing", "spurious", "empty")


def _counts() -> list[Column]:
    return [*[F.count_if(F.col("outcome") == k).alias(k) for k in KINDS], F.count_if(F.col("expected").isNotNull()).alias("__expected"), F.count_if(F.col("expected").isNull()).alias("__none")]


def _of_runs(counts: DataFrame, runs: DataFrame, key: list[str]) -> DataFrame:
    """A document's counts by the status of its run; one with several runs counts for each, its records (if there) once."""
    joined = counts.join(runs.select(*key, "status"), key, "left")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    of_failed = {"missing": F.col("__expected"), "empty": F.col("__none")}
    final = {k: F.when(failed, of_failed.get(k, F.lit(0))).otherwise(F.col(k)) for k in KINDS}
    return joined.groupBy(*key).agg(*[F.sum(c).alias(k) for k, c in final.items()], *[F.max(c).alias(c) for c in ("records", "complete") if c in counts.columns])


def scored_documents(pairs: DataFrame, runs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``document_scores`` with the records and complete of ``complete_records``, from one pass over the pairs."""
    key = [*by, "doc"]
    per = pairs.groupBy(*key, "schema", "entity").agg(*_counts(), F.every(F.col("outcome").isin("correct", "empty")).alias("__right"))
    record = F.col("entity").isNotNull() & (F.col("__expected") > 0)
    counts = per.groupBy(*key).agg(*[F.sum(c).alias(c) for c in (*KINDS, "__expected", "__none")], F.count_if(record).alias("records"), F.count_if(record & F.col("__right")).alias("complete"))
    return _of_runs(counts, runs, key)


def complete_records(pairs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """doc, records, complete: expected records, and those with every value right; ``by``: more columns before doc."""
    per = pairs.filter(F.col("entity").isNotNull()).groupBy(*by, "doc", "schema", "entity").agg(F.every(F.col("outcome").isin("correct", "empty")).alias("right"), F.some(F.col("expected").isNotNull()).alias("expected"))
    return per.filter("expected").groupBy(*by, "doc").agg(F.count("*").alias("records"), F.count_if("right").alias("complete"))


def system_scores(documents: DataFrame, records: DataFrame | None, runs: DataFrame) -> DataFrame:
    """A row a system and corpus: documents, failed, accuracy, completeness, cost and calls a document, p50 and p95 seconds of those that didn't fail."""
    key = ["system", "corpus", "doc"]
    joined = runs.join(documents, key, "left")
    if records is not None:  # else they are in documents
        joined = joined.join(records, key, "left")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    scored = zero("correct") + zero("wrong") + zero("missing") + zero("spurious")
    ran = F.when(F.col("status") != "failed", F.col("seconds"))
    return joined.groupBy("system", "corpus").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        ratio(zero("correct"), scored).alias("accuracy"),
        ratio(zero("complete"), zero("records")).alias("completeness"),
        (F.sum(F.col("cost") + F.coalesce("learning_cost", F.lit(0.0))) / F.count("*")).alias("cost_per_document"),
        (F.sum("calls") / F.count("*")).alias("calls_per_document"),
        F.percentile(ran, 0.5).alias("p50"),
        F.percentile(ran, 0.95).alias("p95"),
    )


def replay_batches(points: DataFrame, size: int) -> DataFrame:
    """A row a batch of ``size`` documents in order: documents so far, size, waves, accuracy, cost a document, generators at its end.

    points: place (from 1), wave, correct, scored, cost, generators. One
    aggregation, with a row a batch and task.
    """
    batch = F.floor((F.col("place") - 1) / size).cast("long") + 1
    return points.groupBy(batch.alias("batch")).agg(
        F.max("place").alias("documents"),
        F.count("*").alias("size"),
        F.array_join(F.array_sort(F.collect_set("wave")), ",").alias("waves"),
        ratio(F.sum("correct"), F.sum("scored")).alias("accuracy"),
        (F.sum("cost") / F.count("*")).alias("cost_per_document"),
        F.max_by("generators", "place").alias("generators"),
    )


def unknown_schemas(corpus: DataFrame, schemas: DataFrame) -> DataFrame:
    """The documents of a corpus whose schema isn't known: there may be none."""
    return corpus.join(schemas.select("schema").distinct(), "schema", "left_anti")


def comparable(baseline: DataFrame, corpus: str, mode: str, locale: str | None = None) -> DataFrame:
    """The baseline, if it is of the same corpus digest, mode and locale; an error for any row that isn't."""
    same = (F.col("corpus") == corpus) & (F.col("mode") == mode) & F.col("locale").eqNullSafe(F.lit(locale))
    return baseline.withColumn("mode", F.when(same, F.col("mode")).otherwise(F.raise_error(F.concat(F.lit("the baseline is of another corpus, mode or locale: "), F.concat_ws(", ", "corpus", "mode", "locale")))))


def results_table(scores: DataFrame, measure: str, systems: list[str]) -> DataFrame:
    """A row a corpus, a column a system."""
    return scores.groupBy("corpus").pivot("system", systems).agg(F.first(measure))


def remaining(corpus: DataFrame, done: DataFrame, key: str = "path") -> DataFrame:
    """What a run that was broken off has still to do."""
    return corpus.join(done.select(key).distinct(), key, "left_anti")


def lenient(records: DataFrame, kinds: dict[str, str], lists: tuple[str, ...] = ()) -> DataFrame:
    """Untyped records (a column of text a field) as typed ones: a value that doesn't read is missing, no record is lost by it."""

    def typed(field: str, kind: str) -> Column:
        if field not in lists:
            return F.col(field).try_cast(kind).alias(field)
        items = F.transform(F.split(F.col(field), ","), lambda x: F.trim(x).try_cast(kind))
        return F.filter(items, lambda x: x.isNotNull()).alias(field)

    return records.select(*[c for c in records.columns if c not in kinds], *[typed(f, k) for f, k in kinds.items()])
