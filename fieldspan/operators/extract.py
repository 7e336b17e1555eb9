"""The whole chain: pages to typed records of a user's schema.

Pages are cleaned, laid out and split into statements in one pass. All that
follows is built-in expressions in the statement's own row: the judge's answers
for every field of the schema (an array, bounded by the schema), the route by
category, the candidate and its value. One shuffle, by document, settles the
fields and makes the record.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.functions import locales, quantities, text
from fieldspan.functions.schema import Field, Schema
from fieldspan.operators import generators, html, statements
from fieldspan.operators.judge import lexical

NONE_P, ALSO_P = 0.3, 0.1
#: judge(text, kind of the statement, field) -> probability that the statement states the field
Judge = Callable[[Column, Column, Field], Column]


def lexical_judge(said: Column, kind: Column, field: Field) -> Column:
    return lexical(said, F.lit(field.label()))


def parsed(markup: str | None, strict: bool = False) -> list[tuple]:
    root = html.Cleaner().clean(html.parse(markup, strict))
    lang = html.language(markup)
    own = (lang or "en").replace("_", "-").split("-")[0].lower()
    return [(at, kind, section, said, lang) for at, _, kind, section, said in statements.statements_of(root, own)]


def value(field: Field, said: Column, decimal: Column) -> Column:
    """The field's value in a statement as text, null where it doesn't read: the value of a key/value pair, else the whole statement."""
    raw = F.when(text.is_key_value(said), text.value_after_label(said)).otherwise(generators.whole_statement(said))
    if field.kind == "str":
        return F.nullif(F.trim(raw), F.lit(""))
    if field.kind in ("int", "float"):
        found = F.when(decimal == ",", quantities.parse_number(said, ",")).otherwise(quantities.parse_number(said))
        return (F.round(found).cast("long") if field.kind == "int" else found).cast("string")
    if field.kind == "money":
        return F.when(decimal == ",", quantities.parse_money(said, ",")["amount"]).otherwise(quantities.parse_money(said)["amount"]).cast("string")
    if field.kind == "date":
        return quantities.parse_date(said).cast("string")
    if field.kind == "bool":
        return F.when(F.lower(raw).isin("yes", "true", "ja", "oui", "sí"), "true").when(F.lower(raw).isin("no", "false", "nein", "non"), "false")
    options = F.array(*[F.lit(o) for o in field.options])
    return F.get(F.filter(options, lambda o: text.fold(o) == text.fold(raw)), F.lit(0))


def extract(pages: DataFrame, key: str, markup: str, schema: Schema, judge: Judge = lexical_judge, threshold: float = 0.0, strict: bool = False) -> DataFrame:
    """key, a column a field and complete, for every page; a page that states nothing has a record of nulls.

    A statement goes to its likeliest field, if that beats none, and to others of at
    least ``ALSO_P``; of a field's values the surest holds, then the earliest; one
    below the threshold counts as missing. A list field has its distinct values in order.
    ``strict`` as in ``html.parse``.
    """
    said = html.per_page(pages, key, markup, "at int, kind string, section string, said string, lang string", partial(parsed, strict=strict))
    decimal = locales.convention(locales.canonical_locale(F.col("lang")), "decimal")
    said = said.withColumn("decimal", F.coalesce(decimal, F.lit(".")))
    answer = lambda i, f: F.struct(judge(F.col("said"), F.col("kind"), f).alias("p"), F.lit(-i).alias("ord"), F.lit(f.name).alias("field"))
    none = F.struct(F.lit(NONE_P).alias("p"), F.lit(-len(schema.fields)).alias("ord"), F.lit("none").alias("field"))
    asked = said.withColumn("answers", F.array(*[answer(i, f) for i, f in enumerate(schema.fields)], none)).withColumn("top", F.array_max("answers"))
    kept = F.filter("answers", lambda a: (a["field"] != "none") & ((a["field"] == F.col("top.field")) | (a["p"] >= ALSO_P)))
    routed = asked.filter(F.col("top.field") != "none").select(key, "at", "said", "decimal", F.explode(kept).alias("a"))
    read = F.coalesce(*[F.when(F.col("a.field") == f.name, value(f, F.col("said"), F.col("decimal"))) for f in schema.fields])
    values = routed.select(key, "at", F.col("a.field").alias("field"), F.col("a.p").alias("p"), read.alias("value")).filter(F.col("value").isNotNull() & (F.col("p") >= threshold))
    rank = F.struct(F.col("p"), -F.col("at"))

    def settled(f: Field) -> Column:
        own = F.col("field") == f.name
        if f.many:
            items = F.array_sort(F.collect_list(F.when(own, F.struct("at", "value"))))
            return F.array_distinct(F.transform(items, lambda i: i["value"])).cast(f.type()).alias(f.name)
        return F.max_by(F.when(own, F.col("value")), F.when(own, rank)).cast(f.type()).alias(f.name)

    found = values.groupBy(key).agg(*[settled(f) for f in schema.fields])
    # parsed rows are guessed to be as small as the pages' columns: by that guess the records would be broadcast through the driver
    records = pages.select(key).join(found.hint("merge"), key, "left")
    required = [F.col(f.name).isNotNull() for f in schema.fields if f.required]
    return records.withColumn("complete", F.forall(F.array(*required), lambda x: x) if required else F.lit(True))
