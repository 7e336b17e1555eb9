"""From direct answers and picks to fields: enums and booleans, units of bare numbers, documents of picks, results.

Relations by (doc, scope, field): answers with value, p, shared (0 or 1) and ord,
the statement's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("doc", "scope", "field")


def direct(kind: Column, choice: Column, p: Column, secondary: Column) -> Column:
    """struct<value, p> of an enum's or boolean's answer: none gives nothing, and a secondary boolean can only be true."""
    boolean = kind == "bool"
    said = F.when(boolean, F.when(p >= 0.5, "true").otherwise("false")).otherwise(choice)
    sure = F.when(boolean & (p < 0.5), 1 - p).otherwise(p)
    nothing = (~boolean & (choice == "none")) | (boolean & secondary & (p < 0.5))
    return F.when(~nothing, F.struct(said.alias("value"), sure.alias("p")))


def combine(answers: DataFrame, many: Column) -> DataFrame:
    """doc, scope, field, value, confidence: own answers before shared ones, the surest, the earliest on a tie.

    A list (``many``) has the distinct items of its best tier in order, with the least p.
    """
    tier = answers.groupBy(*KEYS).agg(F.min("shared").alias("__tier"))
    own = answers.withColumn("__many", many).join(tier, list(KEYS)).filter(F.col("shared") == F.col("__tier"))
    items = own.groupBy(*KEYS, "__many", "value").agg(F.max(F.struct(F.col("p"), -F.col("ord"))).alias("best"), F.min("ord").alias("ord"), F.min("p").alias("least"))
    told = items.groupBy(*KEYS, "__many").agg(
        F.max_by(F.struct("value", F.col("best.p").alias("p")), "best").alias("one"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda i: i["value"]), ",").alias("list"),
        F.min("least").alias("least"),
    )
    return told.select(*KEYS, F.when(F.col("__many"), F.col("list")).otherwise(F.col("one.value")).alias("value"), F.when(F.col("__many"), F.col("least")).otherwise(F.col("one.p")).alias("confidence"))


def unit_questions(candidates: DataFrame, units: DataFrame) -> DataFrame:
    """doc, statement, field, options: bare numbers of which the document names another unit of the field's dimension.

    candidates: doc, statement, field, dimension, default_unit, unit (null: bare);
    units: doc, dimension, unit named anywhere in it.
    """
    bare = candidates.filter("unit IS NULL").select("doc", "statement", "field", "dimension", "default_unit").distinct()
    named = units.groupBy("doc", "dimension").agg(F.array_sort(F.collect_set("unit")).alias("named"))
    offered = F.array_sort(F.array_distinct(F.concat(F.array("default_unit"), F.col("named"))))
    return bare.join(named, ["doc", "dimension"]).select("doc", "statement", "field", offered.alias("options")).filter(F.size("options") > 1)


def in_units(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """The candidates, bare ones with the unit answered, and confidence at most the answer's; answers: doc, statement, field, choice, p."""
    joined = candidates.join(answers, ["doc", "statement", "field"], "left")
    taken = F.col("unit").isNull() & F.col("choice").isNotNull()
    cols = {"unit": F.when(taken, F.col("choice")).otherwise(F.col("unit")), "confidence": F.when(taken, F.least("confidence", "p")).otherwise(F.col("confidence"))}
    return joined.withColumns(cols).drop("choice", "p")


def asked_about(statements: DataFrame) -> DataFrame:
    """doc, scope, trail: the commonest heading trail of a scope's own statements, the first to stand on a tie."""
    counted = statements.filter("shared = 0").groupBy("doc", "scope", "trail").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return counted.groupBy("doc", "scope").agg(F.max_by("trail", F.struct(F.col("n"), -F.col("first"))).alias("trail"))


def picks(answers: DataFrame) -> DataFrame:
    """One pick for each value taken, best first: own, then p, then place; with its place in that order."""
    best = Window.partitionBy(*KEYS, "value").orderBy("shared", F.desc("p"), "ord", "start")
    order = Window.partitionBy(*KEYS).orderBy("shared", F.desc("p"), "ord", "start", "value")
    once = answers.withColumn("__at", F.row_number().over(best)).filter("__at = 1").drop("__at")
    return once.withColumn("place", F.row_number().over(order))


def gated_out(pages: DataFrame, schemas: DataFrame) -> DataFrame:
    """doc, page asked about and failed by every active schema; none of a document that some schema wasn't gated by page.

    pages: doc, schema, page, passed; schemas: doc, schema, gated.
    """
    active = schemas.groupBy("doc").agg(F.count("*").alias("n"), F.every("gated").alias("all"))
    failed = pages.groupBy("doc", "page").agg(F.count_distinct(F.when(~F.col("passed"), F.col("schema"))).alias("failed"), F.some("passed").alias("passed"))
    return failed.join(active.filter("all"), "doc").filter((F.col("failed") == F.col("n")) & ~F.col("passed")).select("doc", "page")


def first_images(images: DataFrame, most: int = 50) -> DataFrame:
    """The first ``most`` images of each document."""
    return images.withColumn("__at", F.row_number().over(Window.partitionBy("doc").orderBy("ord"))).filter(F.col("__at") <= most).drop("__at")


def plain(records: DataFrame, fields: list[str]) -> DataFrame:
    """doc, schema, json: a document's records of a schema as JSON, in order of entity, without what is missing."""
    row = F.struct("entity", F.struct(*fields).alias("values"))
    return records.groupBy("doc", "schema").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


def one(records: DataFrame, schema: str) -> DataFrame:
    """The one record of a schema that each document has; an error for a document with several."""
    n = F.count("*").over(Window.partitionBy("doc", "schema"))
    counted = records.filter(F.col("schema") == schema).withColumn("__n", n)
    return counted.withColumn("schema", F.when(F.col("__n") == 1, F.col("schema")).otherwise(F.raise_error(F.concat(F.lit("several records in "), F.col("doc").cast("string"))))).drop("__n")


def feedback(items: DataFrame, answered: DataFrame) -> DataFrame:
    """The review items with a person's value as verified examples; evidence outside the statement is an error.

    items: id, doc, field, statement; answered: id, value, start, end (both null: none).
    """
    joined = items.join(answered, "id")
    inside = F.col("start").isNull() | ((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("statement")))
    value = F.when(inside, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("evidence outside the statement of "), F.col("id"))))
    example = F.concat(F.lit("ex-"), F.substring(F.sha2(F.concat_ws("\u0000", "field", "statement", "value"), 256), 1, 12))
    return joined.withColumn("value", value).withColumn("example", example).select("example", "doc", "field", "statement", "value", "start", "end")
