"""Queries over answers, units, questions and results: an order is a statement, its customer the document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions import questions
from fieldspan.operators import answers
from fieldspan.plans.common import Register, load

register = Register()

_DIRECT = """
WITH a AS (SELECT o_custkey AS doc, o_orderkey % 2 AS scope, CASE WHEN o_orderkey % 5 < 2 THEN 'bool' ELSE 'enum' END AS kind, CASE WHEN o_orderkey % 7 = 0 THEN 'none' ELSE o_orderpriority END AS choice, o_orderkey % 10 / 10.0 AS p, o_orderkey % 3 = 0 AS secondary, o_orderkey % 4 // 2 AS shared, o_orderkey AS ord FROM orders),
d AS (SELECT doc, scope, kind AS field, CASE WHEN kind = 'bool' THEN CASE WHEN p >= 0.5 THEN 'true' ELSE 'false' END ELSE choice END AS value, CAST(CASE WHEN kind = 'bool' AND p < 0.5 THEN 1 - p ELSE p END AS DOUBLE) AS p, shared, ord FROM a WHERE NOT ((kind = 'enum' AND choice = 'none') OR (kind = 'bool' AND secondary AND p < 0.5)))
"""


def told(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 5 < 2, "bool").otherwise("enum")
    choice = F.when(key % 7 == 0, "none").otherwise(F.col("o_orderpriority"))
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), (key % 2).alias("scope"), kind.alias("field"), answers.direct(kind, choice, key % 10 / 10, key % 3 == 0).alias("a"), F.floor(key % 4 / 2).alias("shared"), key.alias("ord"))
    return rows.filter("a IS NOT NULL").select("doc", "scope", "field", "a.*", "shared", "ord")


@register(_DIRECT + "SELECT ord, field, value, round(p, 6) AS p FROM d")
def direct_answers(spark, sf_dir):
    return told(spark, sf_dir).select("ord", "field", "value", F.round("p", 6).alias("p"))


@register(_DIRECT + """, t AS (SELECT *, min(shared) OVER (PARTITION BY doc, scope, field) AS tier FROM d), o AS (SELECT * FROM t WHERE shared = tier),
r AS (SELECT *, row_number() OVER (PARTITION BY doc, scope, field ORDER BY p DESC, ord) AS rn FROM o),
l AS (SELECT doc, scope, field, string_agg(value, ',' ORDER BY ord, value) AS value, min(p) AS p FROM (SELECT doc, scope, field, value, min(ord) AS ord, min(p) AS p FROM o WHERE field = 'enum' GROUP BY ALL) GROUP BY 1, 2, 3)
SELECT doc, scope, field, value, round(p, 6) AS confidence FROM l UNION ALL SELECT doc, scope, field, value, round(p, 6) FROM r WHERE rn = 1 AND field = 'bool'""")
def combined_answers(spark, sf_dir):
    return answers.combine(told(spark, sf_dir), F.col("field") == "enum").withColumn("confidence", F.round("confidence", 6))


@register(_DIRECT + """, f AS (SELECT *, row_number() OVER (PARTITION BY doc, scope, field, value ORDER BY shared, p DESC, ord) AS rn FROM d)
SELECT doc, scope, field, value, ord, row_number() OVER (PARTITION BY doc, scope, field ORDER BY shared, p DESC, ord, value) AS place FROM f WHERE rn = 1""")
def value_picks(spark, sf_dir):
    return answers.picks(told(spark, sf_dir).withColumn("start", F.lit(0))).select("doc", "scope", "field", "value", "ord", "place")


@register(_DIRECT + """, c AS (SELECT doc, scope, field AS trail, count(*) AS n, min(ord) AS first FROM d WHERE shared = 0 GROUP BY ALL)
SELECT doc, scope, arg_max(trail, n * 1000000000 - first) AS trail FROM c GROUP BY 1, 2""")
def asked_about(spark, sf_dir):
    return answers.asked_about(told(spark, sf_dir).withColumnRenamed("field", "trail"))


_UNITS = """
WITH c AS (SELECT l_orderkey AS doc, l_linenumber AS statement, 'power' AS field, 'power' AS dimension, 'kW' AS default_unit, CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN 'PS' ELSE 'bhp' END END AS unit, l_discount AS confidence FROM lineitem),
u AS (SELECT DISTINCT doc, dimension, unit FROM c WHERE unit IS NOT NULL),
q AS (SELECT DISTINCT c.doc, c.statement, c.field, string_agg(DISTINCT n.unit, ',' ORDER BY n.unit) AS options FROM c JOIN (SELECT doc, dimension, unit FROM u UNION SELECT doc, 'power', 'kW' FROM u) n ON n.doc = c.doc AND n.dimension = c.dimension WHERE c.unit IS NULL GROUP BY ALL)
"""


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.when(F.col("l_linenumber") % 2 == 0, F.when(F.col("l_orderkey") % 2 == 0, "PS").otherwise("bhp"))
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("statement"), F.lit("power").alias("field"), F.lit("power").alias("dimension"), F.lit("kW").alias("default_unit"), unit.alias("unit"), F.col("l_discount").alias("confidence"))


def asked_units(rows: DataFrame) -> DataFrame:
    return answers.unit_questions(rows, rows.filter("unit IS NOT NULL").select("doc", "dimension", "unit").distinct())


@register(_UNITS + "SELECT * FROM q WHERE contains(options, ',')")
def unit_questions(spark, sf_dir):
    return asked_units(numbers(spark, sf_dir)).withColumn("options", F.array_join("options", ","))


@register(_UNITS + """, a AS (SELECT doc, statement, field, 'PS' AS choice, 0.05 AS p FROM q WHERE doc % 2 = 0 AND contains(options, ','))
SELECT c.doc, c.statement, CASE WHEN c.unit IS NULL AND choice IS NOT NULL THEN choice ELSE c.unit END AS unit, CASE WHEN c.unit IS NULL AND choice IS NOT NULL THEN least(confidence, p) ELSE confidence END AS confidence FROM c LEFT JOIN a USING (doc, statement, field)""")
def units_taken(spark, sf_dir):
    rows = numbers(spark, sf_dir)
    told_units = asked_units(rows).filter("doc % 2 = 0").select("doc", "statement", "field", F.lit("PS").alias("choice"), F.lit(0.05).alias("p"))
    return answers.in_units(rows, told_units).select("doc", "statement", "unit", "confidence")


@register("""
SELECT o_orderkey, 'Which of these is the status?' || chr(10) || '- ' || o_orderstatus || chr(10) || '- ' || CASE WHEN o_orderkey % 3 = 0 THEN '"none"' ELSE o_orderpriority END || chr(10) || '- none' AS picked,
  'Which status is stated of it?' || chr(10) || '- ' || o_orderstatus || ' — said ' || o_orderkey || chr(10) || '- none' AS settled,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Does the text say that it is ' || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'not ' END || 'status?' ELSE 'Does the text say that the status is ' || o_orderstatus || '?' END AS verified,
  'Which field is $.a, as in ' || o_orderstatus || '?' || chr(10) || '- status' || chr(10) || '- none' AS path,
  CASE WHEN o_orderkey % 5 = 0 THEN '{"text":"' || o_orderstatus || '"}' ELSE '{"text":"' || o_orderstatus || '","section":"Top","headers":["x"]}' END AS state FROM orders""")
def question_texts(spark, sf_dir):
    key, status, label = F.col("o_orderkey"), F.col("o_orderstatus"), F.lit("status")
    value = F.when(key % 2 == 0, F.when(key % 4 == 0, "true").otherwise("false")).otherwise(status)
    stated = F.array(F.struct(status.alias("value"), F.concat(F.lit("said "), key.cast("string")).alias("statement")))
    bare = key % 5 == 0
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        questions.select(label, F.array(status, F.when(key % 3 == 0, "none").otherwise(F.col("o_orderpriority")))).alias("picked"),
        questions.settle(label, stated).alias("settled"),
        questions.verify(label, value, key % 2 == 0).alias("verified"),
        questions.key_path(F.lit("$.a"), status, F.array(label)).alias("path"),
        questions.state(status, F.when(bare, "").otherwise("Top"), F.lit(None).cast("string"), F.when(bare, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))).alias("state"),
    )


@register("""
SELECT p_partkey, CASE WHEN length(p_name) <= 7 AND NOT contains(p_name, ' ') THEN p_name ELSE p_name END AS whole, string_split(p_name, ' ')[1] AS one, '' AS none, CAST(260 + 2 AS BIGINT) + 0 AS least FROM part WHERE regexp_matches(p_name, '^[a-z]{1,7} [a-z]{1,7}$')""")
def truncated(spark, sf_dir):
    part = load(spark, sf_dir, "part").filter(F.col("p_name").rlike("^[a-z]{1,7} [a-z]{1,7}$"))
    cut = lambda n: questions.truncate(F.col("p_name"), F.lit(n))
    return part.select("p_partkey", cut(2).alias("whole"), cut(1).alias("one"), cut(0).alias("none"), questions.request_tokens(F.lit("a"), F.array(F.lit("b"))).cast("long").alias("least"))


@register("""
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE CAST(event_id % 7 / 4.0 AS DOUBLE) END AS amount FROM events""")
def ledger_charges(spark, sf_dir):
    at = F.col("event_id")
    line = F.concat(F.lit("2026-01-02 judge "), F.when(at % 4 == 0, "-1.5").when(at % 4 == 1, "NaN").otherwise((at % 7 / 4).cast("string")))
    return load(spark, sf_dir, "events").select("event_id", questions.charge(line).alias("amount"))


@register("""
WITH p AS (SELECT DISTINCT o_custkey AS doc, s.schema, o_orderkey % 5 AS page, o_orderkey % 3 <> 0 AS passed FROM orders, (VALUES ('A'), ('B')) s(schema) WHERE NOT (s.schema = 'B' AND o_orderkey % 11 = 0)),
f AS (SELECT doc, page, count(DISTINCT schema) FILTER (NOT passed) AS failed, bool_or(passed) AS passed FROM p GROUP BY 1, 2)
SELECT doc, page FROM f WHERE failed = 2 AND NOT passed AND doc % 4 <> 0""")
def gated_out_pages(spark, sf_dir):
    key = F.col("o_orderkey")
    pages = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.explode(F.when(key % 11 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B")))).alias("schema"), (key % 5).alias("page"), (key % 3 != 0).alias("passed")).distinct()
    schemas = pages.select("doc").distinct().select("doc", F.explode(F.array(F.lit("A"), F.lit("B"))).alias("schema")).withColumn("gated", ~((F.col("doc") % 4 == 0) & (F.col("schema") == "B")))
    return answers.gated_out(pages, schemas)


@register("SELECT o_custkey AS doc, o_orderkey AS ord FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn <= 5")
def first_images(spark, sf_dir):
    return answers.first_images(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord")), 5)


@register("""
SELECT n_regionkey AS doc, 'Nation' AS schema, '[' || string_agg('{"entity":"' || n_name || '","values":{' || CASE WHEN n_nationkey % 3 <> 0 THEN '"key":' || n_nationkey || ',' ELSE '' END || '"region":' || n_regionkey || '}}', ',' ORDER BY n_name) || ']' AS json FROM nation GROUP BY 1""")
def plain_records(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("doc"), F.lit("Nation").alias("schema"), F.col("n_name").alias("entity"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")).alias("key"), F.col("n_regionkey").alias("region"))
    return answers.plain(rows, ["key", "region"])


@register("""
SELECT 'ex-' || substr(sha256(event_type || chr(0) || 'said ' || event_id || chr(0) || event_id), 1, 12) AS example, user_id AS doc, event_type AS field, CAST(event_id AS VARCHAR) AS value, 5 AS start, 5 + length(CAST(event_id AS VARCHAR)) AS "end" FROM events WHERE event_id % 3 = 0""")
def review_feedback(spark, sf_dir):
    at = F.col("event_id").cast("string")
    events = load(spark, sf_dir, "events")
    items = events.select(F.concat(F.lit("rv-"), at).alias("id"), F.col("user_id").alias("doc"), F.col("event_type").alias("field"), F.concat(F.lit("said "), at).alias("statement"))
    answered = events.filter("event_id % 3 = 0").select(F.concat(F.lit("rv-"), at).alias("id"), at.alias("value"), F.lit(5).alias("start"), (F.length(at) + 5).alias("end"))
    return answers.feedback(items, answered).drop("statement")
