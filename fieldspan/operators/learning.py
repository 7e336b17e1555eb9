"""The learning loop: examples, drafts of generators from them, tests before they are published, packs.

examples: example, field, statement, value, created; generators: id, field, pattern,
group, locales, created, learned_from. Patterns are checked before they run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.operators.generators import spans
from fieldspan.operators.storage import scratch

LEARN, REGRESSION = 0.9, 20


def loggable(values: DataFrame, threshold: float = LEARN) -> DataFrame:
    """The values worth an example: found in a statement, and as sure as the threshold or verified."""
    return values.filter(F.col("value").isNotNull() & F.col("statement").isNotNull() & (F.coalesce("verified", F.lit(False)) | (F.col("confidence") >= threshold)))


def newest(examples: DataFrame, n: int) -> DataFrame:
    """The newest n examples of each field, ties by id."""
    order = Window.partitionBy("field").orderBy(F.desc("created"), "example")
    return examples.withColumn("__at", F.row_number().over(order)).filter(F.col("__at") <= n).drop("__at")


def draft_id(field: Column, pattern: Column, group: Column, locale: Column) -> Column:
    """The id of a draft: alike for alike content."""
    text = F.to_json(F.struct(field.alias("field"), group.alias("group"), locale.alias("locale"), pattern.alias("pattern")), {"ignoreNullFields": "false"})
    return F.concat(F.lit("gen-"), F.substring(F.sha2(text, 256), 1, 12))


def proposes(statement: Column, pattern: Column, value: Column) -> Column:
    """Whether a generator's pattern proposes the value in the statement."""
    return F.exists(spans(statement, pattern), lambda s: s["raw"] == value)


def uncovered(examples: DataFrame, generators: DataFrame) -> DataFrame:
    """The examples that no generator of their field proposes: what there is to learn."""
    hit = examples.join(F.broadcast(generators.select("field", "pattern")), "field").filter(proposes(F.col("statement"), F.col("pattern"), F.col("value")))
    return examples.join(hit.select("example").distinct(), "example", "left_anti")


def tested(drafts: DataFrame, examples: DataFrame, generators: DataFrame, n: int = REGRESSION) -> DataFrame:
    """drafts with tried, found, before and passed: on the newest examples of its field a draft finds one at least, and together with it no fewer than before.

    A draft adds to the generators, so what it must not do is propose wrong spans:
    ``wrong`` counts examples where it proposes something, and not the value.
    """
    recent = newest(examples, n)
    pairs = recent.join(F.broadcast(drafts.select("id", "field", "pattern")), "field")
    own = proposes(F.col("statement"), F.col("pattern"), F.col("value"))
    said = F.size(spans(F.col("statement"), F.col("pattern"))) > 0
    counted = pairs.groupBy("id").agg(F.count("*").alias("tried"), F.count_if(own).alias("found"), F.count_if(said & ~own).alias("wrong"))
    old = recent.join(F.broadcast(generators.select("field", "pattern")), "field").groupBy("field", "example").agg(F.some(proposes(F.col("statement"), F.col("pattern"), F.col("value"))).alias("hit"))
    before = old.groupBy("field").agg(F.count_if("hit").alias("before"))
    joined = drafts.join(counted, "id", "left").join(before, "field", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tried", "found", "wrong", "before")}
    return joined.withColumns(zero).withColumn("passed", (F.col("found") > 0) & (F.col("wrong") <= F.col("found")))


def learned_from(generators: DataFrame, examples: DataFrame) -> DataFrame:
    """id, example, value of the examples that generators were learned from."""
    return generators.select("id", F.explode("learned_from").alias("example")).join(examples, "example").select("id", "example", "value")


def publish(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Both sets of rows, the newest of an id."""
    order = Window.partitionBy("id").orderBy(F.desc("created"), F.desc("__new"))
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at", "__new")


def export_pack(rows: DataFrame, fields: DataFrame | None = None, locales: list[str] | None = None) -> DataFrame:
    """The learned rows of a pack: of the fields, and for all locales or some of those asked for."""
    kept = rows if fields is None else rows.join(F.broadcast(fields.select("field").distinct()), "field", "left_semi")
    return kept if not locales else kept.filter((F.size("locales") == 0) | F.arrays_overlap("locales", F.array(*map(F.lit, locales))))


def replay(rows: DataFrame, order: str, size: int, run: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame | None]]) -> DataFrame:
    """The results of all batches of ``size`` rows in order, each run with the state that the one before left.

    run(batch, state) -> (results, state). Results and states are written to the
    shared folder batch by batch, so that a batch's plan reads tables only; the
    number of batches is what the caller asks for, a job or two each.
    """
    from fieldspan.operators.metrics import ranked

    numbered = ranked(rows, order)
    total = numbered.agg(F.max("total")).first()[0] or 0
    out, state = scratch(rows.sparkSession, "replay"), None
    for batch in range(-(-total // size)):
        part = numbered.filter((F.col("place") > batch * size) & (F.col("place") <= (batch + 1) * size)).drop("place", "total")
        results, state = run(part, state)
        results.withColumn("batch", F.lit(batch + 1)).write.mode("append").parquet(f"{out}/results")
        if state is not None:
            state.write.parquet(f"{out}/state-{batch}")
            state = rows.sparkSession.read.parquet(f"{out}/state-{batch}")
    return rows.sparkSession.read.parquet(f"{out}/results")
