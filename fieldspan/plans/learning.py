"""Queries over the learning loop: orders are examples, patterns are drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import learning
from fieldspan.operators.generators import check_pattern
from fieldspan.plans.common import Register, load

register = Register()

_EXAMPLES = """
WITH examples AS (SELECT 'ex-' || o_orderkey AS example, CASE WHEN o_orderkey % 2 = 0 THEN 'number' ELSE 'status' END AS field, 'Order ' || o_orderkey || ' is ' || o_orderstatus AS statement, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS value, o_orderdate AS created FROM orders),
recent AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY created DESC, example) AS rn FROM examples) WHERE rn <= 20)
"""
_PATTERNS = {"digits": ("number", r"[0-9]+"), "two": ("number", r"[0-9]{2}"), "last": ("status", r"[A-Z]$"), "capital": ("status", r"[A-Z]"), "open": ("status", r"O$")}


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    even = key % 2 == 0
    text = key.cast("string")
    return load(spark, sf_dir, "orders").select(F.concat(F.lit("ex-"), text).alias("example"), F.when(even, "number").otherwise("status").alias("field"), F.concat(F.lit("Order "), text, F.lit(" is "), status).alias("statement"), F.when(even, text).otherwise(status).alias("value"), F.col("o_orderdate").alias("created"))


def generators(spark: SparkSession, *names: str) -> DataFrame:
    rows = [(n, _PATTERNS[n][0], check_pattern(_PATTERNS[n][1])) for n in names]
    return spark.createDataFrame(rows, "id string, field string, pattern string")


@register(_EXAMPLES + "SELECT field, example FROM recent")
def newest_examples(spark, sf_dir):
    return learning.newest(examples(spark, sf_dir), 20).select("field", "example")


@register(_EXAMPLES + "SELECT example, field, statement, value, created FROM examples WHERE NOT (field = 'status' AND value = 'O') AND field <> 'number' OR (field = 'number' AND length(value) <> 2)")
def uncovered_examples(spark, sf_dir):
    return learning.uncovered(examples(spark, sf_dir), generators(spark, "two", "open"))


@register(_EXAMPLES + """, drafts(id, field) AS (VALUES ('digits', 'number'), ('last', 'status'), ('capital', 'status'), ('open', 'status')),
t AS (SELECT d.id, d.field, count(*) AS tried, count(*) FILTER (CASE d.id WHEN 'digits' THEN TRUE WHEN 'last' THEN TRUE WHEN 'capital' THEN value <> '' ELSE value = 'O' END) AS found, 0 AS wrong FROM drafts d JOIN recent r ON r.field = d.field GROUP BY ALL),
b AS (SELECT field, count(*) FILTER (CASE field WHEN 'number' THEN length(value) = 2 ELSE value = 'O' END) AS before FROM recent GROUP BY 1)
SELECT id, tried, found, CAST(wrong AS BIGINT) AS wrong, before, found > 0 AND wrong <= found AS passed FROM t JOIN b USING (field)""")
def tested_drafts(spark, sf_dir):
    found = learning.tested(generators(spark, "digits", "last", "capital", "open"), examples(spark, sf_dir), generators(spark, "two", "open"))
    return found.select("id", "tried", "found", "wrong", "before", "passed")


@register("""
SELECT DISTINCT 'gen-' || substr(sha256('{"field":"' || event_type || '","group":' || CASE WHEN event_type < 'd' THEN '1' ELSE 'null' END || ',"locale":null,"pattern":"' || event_type || '"}'), 1, 12) AS id, event_type FROM events""")
def draft_ids(spark, sf_dir):
    kind = F.col("event_type")
    kinds = load(spark, sf_dir, "events").select(kind).distinct()
    return kinds.select(learning.draft_id(kind, kind, F.when(kind < "d", F.lit(1)), F.lit(None).cast("string")).alias("id"), "event_type")


@register("""
WITH a AS (SELECT c_nationkey AS id, max(c_custkey) AS created, 'old' AS body FROM customer WHERE c_nationkey % 3 <> 0 GROUP BY 1), b AS (SELECT c_nationkey AS id, min(c_custkey) + 100 AS created, 'new' AS body FROM customer WHERE c_nationkey % 4 <> 0 GROUP BY 1)
SELECT coalesce(b.id, a.id) AS id, CASE WHEN a.id IS NULL OR b.created >= a.created THEN b.created ELSE a.created END AS created, CASE WHEN a.id IS NULL OR b.created >= a.created THEN 'new' ELSE 'old' END AS body FROM a FULL JOIN b ON a.id = b.id""")
def published(spark, sf_dir):
    customer = load(spark, sf_dir, "customer")
    old = customer.filter("c_nationkey % 3 <> 0").groupBy(F.col("c_nationkey").alias("id")).agg(F.max("c_custkey").alias("created")).withColumn("body", F.lit("old"))
    new = customer.filter("c_nationkey % 4 <> 0").groupBy(F.col("c_nationkey").alias("id")).agg((F.min("c_custkey") + 100).alias("created")).withColumn("body", F.lit("new"))
    return learning.publish(old, new)


@register("""
SELECT event_id, event_type AS field FROM events WHERE event_type IN ('click', 'view') AND (event_id % 3 = 0 OR event_id % 3 = 1)""")
def exported_pack(spark, sf_dir):
    at = F.col("event_id")
    locales = F.when(at % 3 == 0, F.array().cast("array<string>")).when(at % 3 == 1, F.array(F.lit("en"), F.lit("fr"))).otherwise(F.array(F.lit("de")))
    rows = load(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("field"), locales.alias("locales"))
    return learning.export_pack(rows, spark.createDataFrame([("click",), ("view",)], "field string"), ["en"]).select("event_id", "field")


@register("""
WITH g AS (SELECT o_custkey AS id, unnest(['ex-' || min(o_orderkey), 'ex-' || max(o_orderkey)]) AS example FROM orders GROUP BY 1)
SELECT DISTINCT 'g' || id AS id, example, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) ELSE o_orderstatus END AS value FROM g JOIN orders ON 'ex-' || o_orderkey = example""")
def learned_from(spark, sf_dir):
    orders = load(spark, sf_dir, "orders")
    name = lambda c: F.concat(F.lit("ex-"), c.cast("string"))
    own = orders.groupBy("o_custkey").agg(F.array_distinct(F.array(name(F.min("o_orderkey")), name(F.max("o_orderkey")))).alias("learned_from"))
    return learning.learned_from(own.select(F.concat(F.lit("g"), F.col("o_custkey").cast("string")).alias("id"), "learned_from"), examples(spark, sf_dir))


@register("""
SELECT event_type, event_id, user_id % 10 / 10.0 AS confidence FROM events WHERE event_id % 6 <> 0 AND event_id % 5 <> 0 AND (user_id % 10 >= 9 OR event_id % 4 = 0)""")
def loggable_values(spark, sf_dir):
    at = F.col("event_id")
    rows = load(spark, sf_dir, "events").select("event_type", "event_id", F.when(at % 6 != 0, F.col("props")).alias("value"), F.when(at % 5 != 0, F.col("event_type")).alias("statement"), F.when(at % 4 == 0, True).alias("verified"), (F.col("user_id") % 10 / 10).alias("confidence"))
    return learning.loggable(rows).select("event_type", "event_id", "confidence")
