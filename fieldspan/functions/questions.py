"""The texts of questions, what a judge sees beside them, and their sizes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspan.functions.text import estimate_tokens

REQUEST_OVERHEAD = 260


def listed(options: Column) -> Column:
    return F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o)), "\n")


def select(label: Column, candidates: Column) -> Column:
    """Which candidate is the field, or none of them; a candidate that reads none is quoted."""
    quoted = F.transform(candidates, lambda c: F.when(c == "none", F.lit('"none"')).otherwise(c))
    return F.concat(F.lit("Which of these is the "), label, F.lit("?\n"), listed(F.concat(quoted, F.array(F.lit("none")))))


def settle(label: Column, stated: Column) -> Column:
    """Which value holds, each shown with the statement it stands in; stated: array<struct<value, statement>>."""
    each = F.transform(stated, lambda s: F.concat(s["value"], F.lit(" — "), s["statement"]))
    return F.concat(F.lit("Which "), label, F.lit(" is stated of it?\n"), listed(F.concat(each, F.array(F.lit("none")))))


def verify(label: Column, value: Column, boolean: Column) -> Column:
    """The claim that a field has a value; of a boolean one, that it holds or doesn't."""
    holds = F.when(F.lower(value) == "true", F.lit("")).otherwise(F.lit("not "))
    return F.when(boolean, F.concat(F.lit("Does the text say that it is "), holds, label, F.lit("?"))).otherwise(F.concat(F.lit("Does the text say that the "), label, F.lit(" is "), value, F.lit("?")))


def key_path(path: Column, example: Column, labels: Column) -> Column:
    return F.concat(F.lit("Which field is "), path, F.lit(", as in "), example, F.lit("?\n"), listed(F.concat(labels, F.array(F.lit("none")))))


def state(text: Column, section: Column, corner: Column, fellows: Column) -> Column:
    """What a judge sees of a statement, as JSON without what is missing."""
    return F.to_json(F.struct(text.alias("text"), F.nullif(section, F.lit("")).alias("section"), F.nullif(corner, F.lit("")).alias("corner"), F.when(F.size(fellows) > 0, fellows).alias("headers")))


def request_tokens(state_text: Column, questions: Column) -> Column:
    """Tokens of a request: its state, its questions and a constant overhead."""
    return estimate_tokens(state_text) + F.aggregate(questions, F.lit(0), lambda n, q: n + estimate_tokens(q)) + REQUEST_OVERHEAD


def truncate(text: Column, most: Column) -> Column:
    """The longest run of leading words, with the space between them, of at most ``most`` tokens; white space behind it is cut."""
    pieces = F.regexp_extract_all(text, F.lit(r"\s*\S+"), F.lit(0))
    empty = F.struct(F.lit(0).alias("n"), F.lit(False).alias("full"), F.lit("").alias("out"))

    def add(held: Column, piece: Column) -> Column:
        n = held["n"] + estimate_tokens(piece)
        full = held["full"] | (n > most)
        return F.struct(F.when(full, held["n"]).otherwise(n).alias("n"), full.alias("full"), F.when(full, held["out"]).otherwise(F.concat(held["out"], piece)).alias("out"))

    return F.aggregate(pieces, empty, add, lambda held: held["out"])


def fit(text: Column, questions: Column, budget: int) -> Column:
    """A state cut so that it and its questions stay within the budget."""
    asked = F.aggregate(questions, F.lit(0), lambda n, q: n + estimate_tokens(q)) + REQUEST_OVERHEAD
    return truncate(text, F.greatest(F.lit(budget) - asked, F.lit(0)))


def charge(line: Column) -> Column:
    """The amount of a ledger line, the last part after white space: finite and not below 0, else null."""
    amount = F.element_at(F.split(F.trim(line), r"\s+"), -1).try_cast("double")
    return F.when((amount >= 0) & ~F.isnan(amount) & (amount != float("inf")), amount)
