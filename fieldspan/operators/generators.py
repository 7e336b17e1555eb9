"""Candidate generators: rows of data that propose spans of a statement for a field.

A declarative generator is a row (id, field, pattern, group, locales, sources,
place), joined with the statements by scope. Spans come from the same patterns as
the matches: a text is matched and split by one pattern, so offsets need no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from fieldspan.functions.locales import scope_matches

MAX_PATTERN = 500
_FORBIDDEN = re.compile(r"\(\?[=!<]|\\C|\\[1-9]|\(\?>|[+*?}]\+")


def check_pattern(pattern: str) -> str:
    """The pattern, if it is short, valid and without look-around, back references or possessive parts."""
    if not 0 < len(pattern) <= MAX_PATTERN:
        raise ValueError(f"a pattern has 1 to {MAX_PATTERN} characters")
    if found := _FORBIDDEN.search(pattern):
        raise ValueError(f"{found.group()!r} isn't allowed in a pattern")
    re.compile(pattern)
    return pattern


def spans(text: Column, pattern: Column) -> Column:
    """array<struct<start,end,raw>> of the matches of a pattern, in code points."""

    def from_matches(matches: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,raw:string>>").alias("out"))

        def add(held: Column, x: Column) -> Column:
            start = held["at"] + x["gap"]
            end = start + F.length(x["raw"])
            return F.struct(end.alias("at"), F.array_append(held["out"], F.struct(start.alias("start"), end.alias("end"), x["raw"].alias("raw"))).alias("out"))

        pairs = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(g.alias("gap"), m.alias("raw")))
        return F.aggregate(pairs, state, add, lambda s: s["out"])

    return F.element_at(F.transform(F.array(F.regexp_extract_all(text, pattern, F.lit(0))), from_matches), 1)


def generate(statements: DataFrame, generators: DataFrame) -> DataFrame:
    """statement, field, start, end, raw, generator: all candidates in scope.

    A span counts once a field: the generator first in order wins. The generators
    are a broadcast table of configuration.
    """
    joined = statements.join(F.broadcast(generators), scope_matches(F.col("locales"), F.col("locale")) & ((F.size("sources") == 0) | F.array_contains("sources", F.coalesce("source", F.lit("")))))
    found = joined.select("statement", "field", "place", F.col("id").alias("generator"), F.explode(spans(F.col("text"), F.col("pattern"))).alias("s")).select("statement", "field", "place", "generator", "s.*")
    first = Window.partitionBy("statement", "field", "start", "end").orderBy("place", "generator")
    return found.filter("end > start").withColumn("__at", F.row_number().over(first)).filter("__at = 1").select("statement", "field", "start", "end", "raw", "generator")


def phrases(text: Column, most: int = 8) -> Column:
    """All contiguous runs of words of each phrase of up to ``most`` words; longer phrases in pieces of ``most``.

    Phrases end at punctuation.
    """
    parts = F.filter(F.transform(F.split(text, r"[.,;:!?()\n|]+"), lambda p: F.trim(p)), lambda p: p != "")

    def runs(words: Column) -> Column:
        n = F.size(words)
        short = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda a: F.transform(F.sequence(F.lit(1), n - a + 1), lambda k: F.array_join(F.slice(words, a, k), " "))))
        pieces = F.transform(F.sequence(F.lit(1), n, F.lit(most)), lambda a: F.array_join(F.slice(words, a, F.lit(most)), " "))
        return F.when(n <= most, short).otherwise(pieces)

    return F.flatten(F.transform(parts, lambda p: runs(F.split(p, r"\s+"))))


def whole_statement(text: Column, most: int = 16) -> Column:
    """The text itself if it has at most ``most`` words, else null."""
    trimmed = F.trim(text)
    return F.when((trimmed != "") & (F.size(F.split(trimmed, r"\s+")) <= most), trimmed)
