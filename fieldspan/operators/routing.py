"""From answers to values: routing, selection, settling, merging of routes, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ALSO_P, SPAN_P, THRESHOLD = 0.1, 0.5, 0.8


def route(answers: DataFrame, also: float = ALSO_P) -> DataFrame:
    """statement, field: the likeliest category and others of at least ``also``; nothing if the likeliest is none.

    answers: statement, field, p; ties go to the earlier ``ord``.
    """
    best = answers.groupBy("statement").agg(F.max_by("field", F.struct("p", -F.col("ord"))).alias("top"))
    return answers.join(best, "statement").filter((F.col("top") != "none") & (F.col("field") != "none") & ((F.col("field") == F.col("top")) | (F.col("p") >= also))).select("statement", "field", "p", (F.col("field") == F.col("top")).alias("primary"))


def select_best(candidates: DataFrame) -> DataFrame:
    """statement, field, raw, confidence of the likeliest span; ties go to the earlier start, then the greater text."""
    best = F.max_by(F.struct("raw", "p"), F.struct("p", -F.col("start"), "raw"))
    return candidates.groupBy("statement", "field").agg(best.alias("b"), F.count_distinct("raw").alias("options")).select("statement", "field", F.col("b.raw").alias("raw"), F.col("b.p").alias("confidence"), "options")


def one_field_per_span(picks: DataFrame) -> DataFrame:
    """Of the fields that picked one span of a statement, the likeliest keeps it."""
    order = Window.partitionBy("statement", "start", "end").orderBy(F.desc("confidence"), "field")
    return picks.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")


def settle(readings: DataFrame) -> DataFrame:
    """scope, field, value, confidence, conflicts: own readings before shared ones, then confidence, then order.

    readings: scope, field, value, confidence, shared (0 or 1), ord. A null
    confidence counts as 1.
    """
    rank = F.struct(-F.col("shared"), F.coalesce("confidence", F.lit(1.0)), -F.col("ord"))
    return readings.groupBy("scope", "field").agg(F.max_by("value", rank).alias("value"), F.max_by("confidence", rank).alias("confidence"), (F.count_distinct("value") - 1).alias("conflicts"))


def merge_routes(first: DataFrame, second: DataFrame, certain: bool = False) -> DataFrame:
    """Values of two routes: the first that has one, own before shared; with ``certain``, the more confident.

    The other route's differing value is the conflict.
    """
    a = first.select("scope", "field", F.struct("value", "confidence", "shared").alias("a"))
    b = second.select("scope", "field", F.struct("value", "confidence", "shared").alias("b"))
    sure = lambda c: F.coalesce(F.col(f"{c}.confidence"), F.lit(1.0))
    later = (F.col("a.shared") > F.col("b.shared")) | ((F.col("a.shared") == F.col("b.shared")) & F.lit(certain) & (sure("b") > sure("a")))
    taken = F.when(F.col("a").isNull() | (F.col("b").isNotNull() & later), F.struct(F.lit("second").alias("route"), F.col("b").alias("v"), F.col("a").alias("o"))).otherwise(F.struct(F.lit("first").alias("route"), F.col("a").alias("v"), F.col("b").alias("o")))
    joined = a.join(b, ["scope", "field"], "full_outer").withColumn("t", taken)
    conflict = F.when(F.col("t.o.value") != F.col("t.v.value"), F.col("t.o.value"))
    return joined.select("scope", "field", "t.route", F.col("t.v.value").alias("value"), F.col("t.v.confidence").alias("confidence"), conflict.alias("conflict"))


def records(values: DataFrame, fields: list[str], threshold: float = 0.0) -> DataFrame:
    """A row for each scope, a column for each field; values below the threshold are null."""
    kept = values.withColumn("value", F.when(F.coalesce("confidence", F.lit(1.0)) >= threshold, F.col("value")))
    wide = kept.groupBy("scope").pivot("field", fields).agg(F.first("value", ignorenulls=True))
    return wide.withColumn("complete", ~F.array_contains(F.array(*[F.col(f).isNull() for f in fields]), True))


def threshold_for(schema: Column, field: Column, overrides: dict[str, float], default: float = THRESHOLD) -> Column:
    """The threshold of Schema.field, else of the field, else the default."""
    if not overrides:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
    return F.coalesce(F.element_at(table, F.concat(schema, F.lit("."), field)), F.element_at(table, field), F.lit(default))


def unlike_rest(values: DataFrame) -> DataFrame:
    """doc, entity, n_fields of entities that give too little: fewer than half the usual fields and fewer than the median, among at least three.

    values: doc, entity, field, distinct. A field is usual when more than half of
    the giving entities have it.
    """
    own = values.select("doc", "entity", "field").distinct()
    counts = own.groupBy("doc", "entity").agg(F.count("*").alias("n_fields"))
    giving = counts.groupBy("doc").agg(F.count("*").alias("giving"), F.expr("percentile(n_fields, 0.5)").alias("median"))
    usual = own.groupBy("doc", "field").agg(F.count("*").alias("entities")).join(giving, "doc").filter(F.col("entities") * 2 > F.col("giving")).groupBy("doc").agg(F.count("*").alias("usual"))
    judged = counts.join(giving, "doc").join(usual, "doc", "left")
    return judged.filter((F.col("giving") >= 3) & (F.col("n_fields") < 0.5 * F.coalesce("usual", F.lit(0))) & (F.col("n_fields") < F.col("median"))).select("doc", "entity", "n_fields")


def inherit(children: DataFrame, parents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each child with its own value of a field or, shared, its parent's."""
    renamed = parents.select(key, *[F.col(f).alias(f"__{f}") for f in fields])
    joined = children.join(renamed, key, "left")
    return joined.select(*[c for c in children.columns if c not in fields], *[F.coalesce(f, f"__{f}").alias(f) for f in fields], *[(F.col(f).isNull() & F.col(f"__{f}").isNotNull()).alias(f"{f}_shared") for f in fields])


def part_errors(errors: DataFrame) -> DataFrame:
    """doc, stage, kind, n, first: repeated failures of a part merged."""
    return errors.groupBy("doc", "stage", "kind").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def status(values: Column, errors: Column) -> Column:
    """ok without errors, failed without values, else partial."""
    return F.when(errors == 0, "ok").when(values == 0, "failed").otherwise("partial")
