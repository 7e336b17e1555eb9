"""The generative route: which questions fall back to it, how its answers are verified and settled.

Relations: statements (doc, statement, kind), candidates and selections by (doc,
scope, field, statement), answers (doc, scope, field, statement, value, evidence, p).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.operators.judge import evidence

CATEGORY, LOW, VERIFY = 0.5, 0.3, 0.7


def still_needed(values: DataFrame, wanted: DataFrame, low: float = LOW) -> DataFrame:
    """The wanted (doc, scope, field) without a value, or with one of confidence below ``low``; a value without confidence is sure."""
    keys = ["doc", "scope", "field"]
    sure = values.filter(F.col("value").isNotNull() & (F.coalesce("confidence", F.lit(1.0)) >= low))
    return wanted.join(sure.select(*keys).distinct(), keys, "left_anti")


def triggers(asked: DataFrame, category: float = CATEGORY, low: float = LOW) -> DataFrame:
    """asked with trigger: no_candidates, none_chosen or low_confidence; rows without one are left out.

    asked: kind of the statement, candidates (their number), selected (whether a
    selector was asked), raw (what it picked, null for none), confidence, category_p.
    Headers of tables never fall back.
    """
    why = (
        F.when(F.col("kind") == "table_header", None)
        .when(F.col("candidates") == 0, "no_candidates")
        .when(~F.col("selected"), None)
        .when(F.col("raw").isNull(), F.when(F.coalesce("category_p", F.lit(0.0)) >= category, "none_chosen"))
        .when(F.col("confidence") < low, "low_confidence")
    )
    return asked.withColumn("trigger", why).filter(F.col("trigger").isNotNull())


def generated(asks: DataFrame, extract: Callable[[str, str], tuple[str, str] | None]) -> DataFrame:
    """asks with value and evidence from a model: extract(text, field), a pure function, or a client that caches by request.

    A batch at a time; an answer of None, or an error of the model on one ask, leaves
    both null, and no other ask is lost by it.
    """
    names = asks.columns

    def answer(text: str, field: str) -> tuple[str | None, str | None]:
        try:
            return extract(text, field) or (None, None)
        except Exception:  # noqa: BLE001 - a part's failure is that part's
            return None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [answer(t, f) for t, f in zip(batch["text"], batch["field"])]
            yield batch.assign(value=[v for v, _ in found], evidence=[e for _, e in found])[[*names, "value", "evidence"]]

    from pyspark.sql.types import StringType, StructType

    return asks.mapInPandas(run, StructType([*asks.schema.fields]).add("value", StringType()).add("evidence", StringType()))


def grounded(answers: DataFrame) -> DataFrame:
    """The answers of which the evidence stands verbatim in the statement's text, with where."""
    return answers.withColumn("at", evidence(F.col("text"), F.col("evidence"))).filter(F.col("value").isNotNull() & F.col("at").isNotNull())


def verified(answers: DataFrame, threshold: float = VERIFY) -> DataFrame:
    """answers with verified: whether the judge's p for the claim reaches the threshold."""
    return answers.withColumn("verified", F.coalesce(F.col("p") >= threshold, F.lit(False)))


def settle(values: DataFrame, answers: DataFrame, many: Column | None = None) -> DataFrame:
    """doc, scope, field, value, confidence, method, alternatives after the route.

    Any verified answer beats the standing value; among verified ones a statement
    of the scope's own beats a shared one, then p, then the earlier place. A list
    takes the items of the best tier in order of place, with the least p. Rejected
    answers, the value that was replaced and the other verified ones are
    alternatives, the likeliest first. answers: value, p, verified, shared (0 or 1), ord.
    """
    keys = ["doc", "scope", "field"]
    many = F.lit(False) if many is None else many
    good = F.col("verified")
    rank = F.struct(-F.col("shared"), F.col("p"), -F.col("ord"))
    item = F.struct("ord", "value", "p", "shared")
    told = answers.groupBy(*keys).agg(
        F.max_by(F.when(good, F.struct("value", "p", "shared")), F.when(good, rank)).alias("best"),
        F.array_sort(F.collect_list(F.when(good, item))).alias("accepted"),
        F.collect_list(F.struct(F.col("p"), F.col("value"))).alias("offered"),
    )
    joined = values.select(*keys, F.col("value").alias("__value"), F.col("confidence").alias("__confidence"), F.col("method").alias("__method")).join(told, keys, "full_outer")
    tier = F.filter("accepted", lambda a: a["shared"] == F.col("best.shared"))
    listed = F.array_join(F.array_distinct(F.transform(tier, lambda a: a["value"])), ",")
    least = F.array_min(F.transform(tier, lambda a: a["p"]))
    taken = F.col("best").isNotNull()
    value = F.when(taken, F.when(many, listed).otherwise(F.col("best.value"))).otherwise(F.col("__value"))
    confidence = F.when(taken, F.when(many, least).otherwise(F.col("best.p"))).otherwise(F.col("__confidence"))
    was = F.when(F.col("__value").isNotNull() & taken, F.array(F.struct(F.coalesce("__confidence", F.lit(0.0)).alias("p"), F.col("__value").alias("value")))).otherwise(F.array().cast("array<struct<p:double,value:string>>"))
    others = F.filter(F.concat(F.coalesce("offered", F.array().cast("array<struct<p:double,value:string>>")), was), lambda o: ~o["value"].eqNullSafe(F.col("value")))
    chosen = joined.withColumn("value", value).withColumn("confidence", confidence).withColumn("method", F.when(taken, "generated").otherwise(F.col("__method"))).withColumn("__others", others)
    best_of = F.transform(F.array_distinct(F.transform("__others", lambda o: o["value"])), lambda v: F.struct((-F.array_max(F.transform(F.filter("__others", lambda o: o["value"] == v), lambda o: o["p"]))).alias("p"), v.alias("value")))
    return chosen.select(*keys, "value", "confidence", "method", F.array_join(F.transform(F.array_sort(best_of), lambda a: a["value"]), "|").alias("alternatives"))
