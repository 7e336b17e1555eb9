"""Queries over candidate generators and embedded data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspan.operators import embedded, generators
from fieldspan.plans.common import Register, load

register = Register()


@register("SELECT p_partkey, CAST(len(w) * (len(w) + 1) // 2 AS BIGINT) AS n FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def phrase_ngrams(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", F.size(generators.phrases(F.col("p_name"))).cast("long").alias("n"))


@register("SELECT doc_id, trim(text) AS whole FROM documents WHERE len(string_split_regex(trim(text), '\\s+')) <= 16 AND trim(text) <> ''")
def whole_statement(spark, sf_dir):
    found = load(spark, sf_dir, "documents").select("doc_id", generators.whole_statement(F.col("text")).alias("whole"))
    return found.filter(F.col("whole").isNotNull())


@register("""
WITH t AS (SELECT o_orderkey AS statement, 'Order ' || o_orderkey || ' of ' || o_custkey || ' is ' || o_orderstatus AS text FROM orders)
SELECT statement, 'number' AS field, 6 AS start, 6 + length(CAST(statement AS VARCHAR)) AS "end", CAST(statement AS VARCHAR) AS raw, 'digits' AS generator FROM t
UNION ALL SELECT o_orderkey, 'number', 10 + length(CAST(o_orderkey AS VARCHAR)), 10 + length(CAST(o_orderkey AS VARCHAR)) + length(CAST(o_custkey AS VARCHAR)), CAST(o_custkey AS VARCHAR), 'digits' FROM orders
UNION ALL SELECT statement, 'status', length(text) - 1, length(text), right(text, 1), 'letter' FROM t""")
def registry_dedupe(spark, sf_dir):
    rows = [("digits", "number", r"[0-9]+", [], [], 1), ("number", "number", r"[0-9]+", ["en"], [], 2), ("letter", "status", r"[A-Z]$", ["en"], [], 3), ("german", "status", r"[A-Z]$", ["de"], [], 0)]
    table = spark.createDataFrame([(i, f, generators.check_pattern(p), l, s, k) for i, f, p, l, s, k in rows], "id string, field string, pattern string, locales array<string>, sources array<string>, place int")
    orders = load(spark, sf_dir, "orders")
    said = F.concat_ws(" ", F.lit("Order"), F.col("o_orderkey").cast("string"), F.lit("of"), F.col("o_custkey").cast("string"), F.lit("is"), F.col("o_orderstatus"))
    return generators.generate(orders.select(F.col("o_orderkey").alias("statement"), said.alias("text"), F.lit("en-GB").alias("locale"), F.lit(None).cast("string").alias("source")), table)


@register("SELECT event_id, '$.k' AS path, '$.k' AS shape, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value FROM events")
def json_leaves(spark, sf_dir):
    blobs = load(spark, sf_dir, "events").select("event_id", F.col("props").alias("blob"))
    return embedded.flatten(blobs, "event_id").select("event_id", "path", "shape", "value")


@register("SELECT event_id, substr(sha256('app' || chr(10) || event_type || chr(10) || '$.k'), 1, 16) AS fingerprint FROM events")
def fingerprint(spark, sf_dir):
    events = load(spark, sf_dir, "events")
    leaves = embedded.flatten(events.select("event_id", F.col("props").alias("blob")), "event_id")
    kinds = events.select("event_id", F.array("event_type").alias("types"), F.lit("app").alias("source"))
    return embedded.fingerprints(leaves, kinds, "event_id")


@register("""
WITH l AS (SELECT event_type, '$.k' AS path FROM events GROUP BY 1),
m AS (SELECT * FROM (VALUES ('click', 1, 'clicks'), ('click', 2, 'later'), ('view', 2, 'views'), ('error', 3, 'none')) t(event_type, layer, field))
SELECT event_type, path, field FROM (SELECT l.event_type, l.path, m.field, row_number() OVER (PARTITION BY l.event_type ORDER BY m.layer) AS rn FROM l LEFT JOIN m USING (event_type)) WHERE rn = 1""")
def mapping_layers(spark, sf_dir):
    leaves = load(spark, sf_dir, "events").select("event_type").distinct().withColumn("path", F.lit("$.k"))
    layers = spark.createDataFrame([("click", 1, "clicks"), ("click", 2, "later"), ("view", 2, "views"), ("error", 3, "none")], "event_type string, layer int, field string")
    best = layers.groupBy("event_type").agg(F.min_by("field", "layer").alias("field"))
    return leaves.join(F.broadcast(best), "event_type", "left")
