"""Queries that score runs: an order is a document, its lines are the records, two systems found them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import evaluation
from fieldspan.plans.common import Register, load

register = Register()

_PAIRS = """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, CAST(l_quantity AS BIGINT) AS q, l_returnflag AS f FROM lineitem),
pairs AS (
  SELECT s.system, doc, 'Line' AS schema, CAST(n AS VARCHAR) AS entity, 'quantity' AS field, CAST(q AS VARCHAR) AS expected, CASE WHEN (doc + n + s.k) % 6 = 0 THEN NULL WHEN (doc + n + s.k) % 6 = 1 THEN CAST(q + 5 AS VARCHAR) WHEN (doc + n) % 6 = 2 THEN CAST(q + 0.5 AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS found FROM l, (VALUES ('rules', 0), ('model', 1)) s(system, k)
  UNION ALL SELECT s.system, doc, 'Line', CAST(n AS VARCHAR), 'flag', CASE WHEN n % 3 <> 0 THEN f END, CASE WHEN (doc + s.k) % 5 <> 0 THEN lower(f) END FROM l, (VALUES ('rules', 0), ('model', 1)) s(system, k)),
o AS (SELECT *, CASE WHEN expected IS NULL AND found IS NULL THEN 'empty' WHEN found IS NULL THEN 'missing' WHEN expected IS NULL THEN 'spurious'
  WHEN (field = 'quantity' AND abs(CAST(expected AS DOUBLE) - CAST(found AS DOUBLE)) <= 0.5) OR (field = 'flag' AND lower(expected) = lower(found)) THEN 'correct' ELSE 'wrong' END AS outcome FROM pairs),
runs AS (SELECT s.system, 'orders' AS corpus, o_orderkey AS doc, CASE WHEN (o_orderkey + s.k) % 13 = 0 THEN 'failed' ELSE 'ok' END AS status, o_custkey % 100 / 10.0 AS seconds, o_custkey % 7 / 100.0 AS cost, o_custkey % 3 AS calls, CASE WHEN o_custkey % 2 = 0 THEN 0.01 END AS learning_cost FROM orders, (VALUES ('rules', 0), ('model', 1)) s(system, k))
"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, n, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("long")
    both = load(spark, sf_dir, "lineitem").select(doc.alias("doc"), n.alias("n"), q.alias("q"), F.col("l_returnflag").alias("f"), F.explode(F.array(F.struct(F.lit("rules").alias("system"), F.lit(0).alias("k")), F.struct(F.lit("model").alias("system"), F.lit(1).alias("k")))).alias("s"))
    at = F.col("doc") + F.col("n")
    moved = (at + F.col("s.k")) % 6
    found = F.when(moved == 0, None).when(moved == 1, (F.col("q") + 5).cast("string")).when(at % 6 == 2, F.concat(F.col("q").cast("string"), F.lit(".5"))).otherwise(F.col("q").cast("string"))
    value = lambda field, a, b: F.struct(F.lit(field).alias("field"), a.alias("expected"), b.alias("found"))
    values = F.array(value("quantity", F.col("q").cast("string"), found), value("flag", F.when(F.col("n") % 3 != 0, F.col("f")), F.when((F.col("doc") + F.col("s.k")) % 5 != 0, F.lower("f"))))
    rows = both.select("s.system", "doc", F.lit("Line").alias("schema"), F.col("n").cast("string").alias("entity"), F.explode(values).alias("v")).select("system", "doc", "schema", "entity", "v.*")
    fields = spark.createDataFrame([("Line", "quantity", "float"), ("Line", "flag", "str")], "schema string, field string, kind string")
    limits = evaluation.tolerances(fields, {"float": (0.0, 0.0)}, {"Line.quantity": (0.0, 0.5), "flag": (0.0, 0.0)})
    return evaluation.outcomes(rows.join(F.broadcast(limits), ["schema", "field"]), F.col("relative"), F.col("absolute")).drop("relative", "absolute", "kind")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey")
    each = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.explode(F.array(F.struct(F.lit("rules").alias("system"), F.lit(0).alias("k")), F.struct(F.lit("model").alias("system"), F.lit(1).alias("k")))).alias("s"))
    failed = F.when((F.col("o_orderkey") + F.col("s.k")) % 13 == 0, "failed").otherwise("ok")
    return each.select("s.system", F.lit("orders").alias("corpus"), F.col("o_orderkey").alias("doc"), failed.alias("status"), (customer % 100 / 10).alias("seconds"), (customer % 7 / 100).alias("cost"), (customer % 3).alias("calls"), F.when(customer % 2 == 0, 0.01).alias("learning_cost"))


@register(_PAIRS + "SELECT system, field, outcome, count(*) AS n FROM o GROUP BY ALL")
def pair_outcomes(spark, sf_dir):
    return pairs(spark, sf_dir).groupBy("system", "field", "outcome").agg(F.count("*").alias("n"))


_SCORED = _PAIRS.rstrip() + """, docs AS (SELECT system, doc, CASE WHEN status = 'failed' THEN CASE WHEN expected IS NULL THEN 'empty' ELSE 'missing' END ELSE outcome END AS outcome FROM o LEFT JOIN runs USING (system, doc)),
counts AS (SELECT system, doc, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'spurious') AS spurious, count(*) FILTER (outcome = 'empty') AS empty FROM docs GROUP BY 1, 2),
recs AS (SELECT system, doc, count(*) AS records, count(*) FILTER (whole) AS complete FROM (SELECT system, doc, entity, bool_and(outcome IN ('correct', 'empty')) AS whole FROM o GROUP BY 1, 2, 3 HAVING count(expected) > 0) GROUP BY 1, 2)
"""


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.document_scores(pairs(spark, sf_dir), runs(spark, sf_dir), ("system",))


def record_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.complete_records(pairs(spark, sf_dir), ("system",))


@register(_SCORED + "SELECT * FROM counts")
def document_scores(spark, sf_dir):
    return document_counts(spark, sf_dir)


@register(_SCORED + "SELECT * FROM recs")
def complete_records(spark, sf_dir):
    return record_counts(spark, sf_dir)


_SYSTEMS = _SCORED.rstrip() + """, systems AS (SELECT system, corpus, count(*) AS documents, count(*) FILTER (status = 'failed') AS failed, round(sum(correct) / sum(correct + wrong + missing + spurious), 9) AS accuracy, round(sum(complete) / sum(records), 9) AS completeness,
  round(sum(cost + coalesce(learning_cost, 0)) / count(*), 9) AS cost_per_document, round(sum(calls) / count(*), 9) AS calls_per_document, round(quantile_cont(seconds, 0.5) FILTER (status <> 'failed'), 6) AS p50, round(quantile_cont(seconds, 0.95) FILTER (status <> 'failed'), 6) AS p95
  FROM runs LEFT JOIN counts USING (system, doc) LEFT JOIN recs USING (system, doc) GROUP BY 1, 2)
"""


def rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({c: F.round(c, 6 if c in ("p50", "p95") else 9) for c in found.columns[4:]})


@register(_SYSTEMS + "SELECT * FROM systems")
def system_scores(spark, sf_dir):
    ran = runs(spark, sf_dir)
    scored = evaluation.scored_documents(pairs(spark, sf_dir), ran, ("system",)).withColumn("corpus", F.lit("orders"))
    return rounded(evaluation.system_scores(scored, None, ran))


@register(_SYSTEMS + "SELECT corpus, max(accuracy) FILTER (system = 'rules') AS rules, max(accuracy) FILTER (system = 'model') AS model FROM systems GROUP BY 1")
def results_table(spark, sf_dir):
    # accuracy needs no records: counted apart, they are pruned
    documents, records = (f(spark, sf_dir).withColumn("corpus", F.lit("orders")) for f in (document_counts, record_counts))
    return evaluation.results_table(rounded(evaluation.system_scores(documents, records, runs(spark, sf_dir))), "accuracy", ["rules", "model"])


@register("""
WITH p AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place, event_type AS wave, user_id % 5 AS correct, user_id % 5 + event_id % 2 AS scored, value AS cost, event_id // 100 AS generators FROM events)
SELECT (place - 1) // 500 + 1 AS batch, max(place) AS documents, count(*) AS size, string_agg(DISTINCT wave, ',' ORDER BY wave) AS waves, round(sum(correct) / nullif(sum(scored), 0), 9) AS accuracy, round(sum(cost) / count(*), 6) AS cost_per_document, max_by(generators, place) AS generators FROM p GROUP BY 1""")
def replay_batches(spark, sf_dir):
    from fieldspan.operators.metrics import ranked

    at, user = F.col("event_id"), F.col("user_id")
    points = ranked(load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), "event_id").select("place", F.col("event_type").alias("wave"), (user % 5).alias("correct"), (user % 5 + at % 2).alias("scored"), F.col("value").alias("cost"), F.floor(at / 100).alias("generators"))
    found = evaluation.replay_batches(points, 500)
    return found.withColumns({"accuracy": F.round("accuracy", 9), "cost_per_document": F.round("cost_per_document", 6)})


@register("""
SELECT o_orderkey, CAST(o_custkey AS BIGINT) AS customer, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS DOUBLE) END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM orders""")
def lenient_records(spark, sf_dir):
    key = F.col("o_orderkey")
    raw = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("customer"), F.when(key % 4 == 0, "about ten").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(key % 2 == 0, "1, 2").otherwise("x,3").alias("sizes"))
    found = evaluation.lenient(raw, {"customer": "bigint", "price": "double", "sizes": "int"}, ("sizes",))
    return found.select("o_orderkey", "customer", "price", F.size("sizes").alias("n"))


@register("SELECT o_orderkey AS path, o_orderstatus AS schema FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderstatus <> 'P'")
def remaining_documents(spark, sf_dir):
    orders = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderstatus").alias("schema"))
    unknown = evaluation.unknown_schemas(orders, orders.limit(0).unionByName(spark.createDataFrame([(0, "P")], orders.schema)))
    return evaluation.remaining(unknown, orders.filter("path % 4 = 0")).select("path", "schema")
