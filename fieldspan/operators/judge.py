"""The judge relation: questions and answers as tables.

A question's request key is a hash of its state and its text. Answers are a table
by that key; what it lacks goes to a scripted or a lexical judge, both pure
functions of the question, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def request_key(state: Column, question: Column) -> Column:
    """16 hex digits of the SHA-256 of compact JSON with sorted keys."""
    return F.substring(F.sha2(F.to_json(F.struct(question.alias("questions"), state.alias("state"))), 256), 1, 16)


def recorded(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """The questions with p of the recorded answers by key; null where there is none."""
    return questions.join(answers.select("key", "p"), "key", "left")


def lexical(state: Column, question: Column) -> Column:
    """A deterministic probability: the share of a question's words that the state holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    asked = words(question)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, words(state))) / F.size(asked)).otherwise(F.lit(0.0))


def scripted(questions: DataFrame, rules: DataFrame, default: float = 0.0) -> DataFrame:
    """The questions with p of the last rule whose texts both occur; rules: place, question_has, state_has, p. A broadcast table of configuration."""
    hit = F.contains(F.col("question"), F.col("question_has")) & (F.col("state_has").isNull() | F.contains(F.col("state"), F.col("state_has")))
    joined = questions.join(F.broadcast(rules), hit, "left")
    last = joined.groupBy(*questions.columns).agg(F.max_by("p", "place").alias("p"))
    return last.withColumn("p", F.coalesce("p", F.lit(default)))


def batches(questions: DataFrame, budget: int, by: str = "state_id", order: str = "place", tokens: str = "tokens") -> DataFrame:
    """The questions with batch: greedy runs in order of which the tokens fit the budget, one state each."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("place"), F.col(tokens).alias("tokens"))))
    state = F.struct(F.lit(0).alias("batch"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<place:bigint,batch:int>>").alias("out"))

    def add(held: Column, x: Column) -> Column:
        fits = (held["used"] + x["tokens"] <= budget) | (held["used"] == 0)
        at = F.when(fits, held["batch"]).otherwise(held["batch"] + 1)
        used = F.when(fits, held["used"] + x["tokens"]).otherwise(x["tokens"]).cast("long")
        return F.struct(at.alias("batch"), used.alias("used"), F.array_append(held["out"], F.struct(x["place"].cast("long").alias("place"), at.alias("batch"))).alias("out"))

    return questions.groupBy(by).agg(F.aggregate(ordered, state, add, lambda s: s["out"]).alias("b")).select(by, F.explode("b").alias("b")).select(by, F.col("b.place").alias(order), F.col("b.batch").alias("batch"))


def gate(units: DataFrame, threshold: float) -> DataFrame:
    """doc, group whose best unit reaches the threshold."""
    return units.groupBy("doc", "group").agg(F.max("p").alias("p")).filter(F.col("p") >= threshold)


def evidence(text: Column, said: Column) -> Column:
    """struct<start, end> of evidence in a text with any white space, or null: it must be verbatim."""
    joined = F.array_join(F.transform(F.split(F.trim(said), r"(?U)\s+"), lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))), r"(?U)\s+")
    found = F.regexp_substr(text, joined)
    return F.when((F.trim(said) != "") & found.isNotNull(), F.struct((F.instr(text, found) - 1).alias("start"), (F.instr(text, found) - 1 + F.length(found)).alias("end")))


def newest_rule(rules: DataFrame, key: str) -> DataFrame:
    """Of rules with one key the most recently added."""
    order = Window.partitionBy(key).orderBy(F.desc("place"))
    return rules.withColumn("__at", F.row_number().over(order)).filter("__at = 1").drop("__at")


def in_halves(questions: list, ask: Callable[[list], list], rejected: type[Exception]) -> list:
    """ask's answers to a batch; a batch that it rejects as too large is asked in halves, one question alone must pass."""
    try:
        return ask(questions)
    except rejected:
        if len(questions) < 2:
            raise
        middle = len(questions) // 2
        return in_halves(questions[:middle], ask, rejected) + in_halves(questions[middle:], ask, rejected)


@dataclass(frozen=True)
class Retry:
    """Waits between tries of a call that fails for a while: doubled each time, up to a limit, with a share of jitter."""

    tries: int = 4
    first: float = 0.5
    longest: float = 30.0
    jitter: float = 0.25

    def waits(self, draw: Callable[[], float]) -> list[float]:
        return [min(self.first * 2**i, self.longest) * (1 + self.jitter * (2 * draw() - 1)) for i in range(self.tries - 1)]

    def call(self, work: Callable[[], object], passing: type[Exception], draw: Callable[[], float], sleep: Callable[[float], None]) -> object:
        for wait in self.waits(draw):
            try:
                return work()
            except passing:
                sleep(wait)
        return work()
