"""Queries over the judge relation, entities, chains and costs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldspan.functions.chains import NormaliserRegistry, NormaliserStep, localised
from fieldspan.operators import entities, judge, metrics, routing
from fieldspan.plans.common import Register, load

register = Register()


@register("""
SELECT doc_id, CASE WHEN contains(text, 'idiot') AND contains(lang, 'en') THEN 0.9 WHEN contains(text, ' the ') THEN 0.4 ELSE 0.0 END AS p FROM documents""")
def scripted_judge(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    flags = F.concat_ws("|", "lang", F.when(F.contains("text", F.lit("idiot")), "rude"), F.when(F.contains("text", F.lit(" the ")), "article"))
    rules = spark.createDataFrame([(1, "doc", "article", 0.4), (2, "en", "rude", 0.9)], "place int, question_has string, state_has string, p double")
    asked = docs.select("doc_id", flags.alias("state"), F.concat(F.lit("doc "), F.col("lang")).alias("question"))
    return judge.scripted(asked, rules).select("doc_id", "p")


@register("""
WITH w AS (SELECT p_partkey, string_split(lower(p_name), ' ')[1] AS f, list_distinct(string_split(lower(p_name), ' ')) AS a, list_distinct(string_split(lower(p_type), ' ')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, list_concat(b, [f]))) / len(a), 9) AS p FROM w""")
def lexical_judge(spark, sf_dir):
    state = F.concat_ws(" ", "p_type", F.split_part("p_name", F.lit(" "), F.lit(1)))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(judge.lexical(state, F.col("p_name")), 9).alias("p"))


@register("""
SELECT event_id, substr(sha256('{"questions":"' || event_type || '","state":"' || user_id || '"}'), 1, 16) AS key FROM events""")
def request_keys(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", judge.request_key(F.col("user_id").cast("string"), F.col("event_type")).alias("key"))


def _asked(lines):
    return lines.groupBy(F.col("l_orderkey").alias("state_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("place")).agg(F.min("l_quantity").cast("long").alias("tokens"))


@register("""
WITH RECURSIVE q AS (SELECT l_orderkey AS state_id, CAST(l_partkey AS BIGINT) * 100 + l_linenumber AS place, CAST(min(l_quantity) AS BIGINT) AS tokens FROM lineitem GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY state_id ORDER BY place) AS rn FROM q),
b AS (SELECT state_id, place, rn, 0 AS batch, tokens AS used FROM o WHERE rn = 1
  UNION ALL SELECT o.state_id, o.place, o.rn, CASE WHEN used + tokens <= 60 THEN batch ELSE batch + 1 END, CASE WHEN used + tokens <= 60 THEN used + tokens ELSE tokens END FROM b JOIN o ON o.state_id = b.state_id AND o.rn = b.rn + 1)
SELECT state_id, place, batch FROM b""")
def judge_batches(spark, sf_dir):
    return judge.batches(_asked(load(spark, sf_dir, "lineitem")), 60)


@register("SELECT user_id AS doc, event_type AS \"group\", max(value) AS p FROM events GROUP BY 1, 2 HAVING max(value) >= 60")
def component_gate(spark, sf_dir):
    units = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("group"), F.col("value").alias("p"))
    return judge.gate(units, 60.0)


@register("""
SELECT doc_id, instr(text, regexp_extract(text, '[A-Za-z]+ +[A-Za-z]+')) - 1 AS start, instr(text, regexp_extract(text, '[A-Za-z]+ +[A-Za-z]+')) - 1 + length(regexp_extract(text, '[A-Za-z]+ +[A-Za-z]+')) AS "end"
FROM documents WHERE regexp_extract(text, '[A-Za-z]+ +[A-Za-z]+') <> ''""")
def evidence_spans(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").withColumn("said", F.regexp_extract("text", "[A-Za-z]+ +[A-Za-z]+", 0)).filter("said <> ''")
    exact = F.struct((F.instr("text", F.col("said")) - 1).alias("start"), (F.instr("text", F.col("said")) - 1 + F.length("said")).alias("end"))
    found = docs.select("doc_id", judge.evidence(F.col("text"), F.regexp_replace("said", " +", "\n ")).alias("e"), exact.alias("x"))
    return found.select("doc_id", F.least("e.start", "x.start").alias("start"), F.when(F.col("e.start") <= F.col("x.start"), F.col("e.end")).otherwise(F.col("x.end")).alias("end"))


@register("""
WITH s AS (SELECT o_custkey AS doc, o_orderkey AS statement, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS label FROM orders),
l AS (SELECT DISTINCT doc, label FROM s WHERE label IS NOT NULL), m AS (SELECT doc FROM l GROUP BY doc HAVING count(*) >= 2)
SELECT doc, label AS entity, statement, true AS own FROM s SEMI JOIN m USING (doc) WHERE label IS NOT NULL
UNION ALL SELECT s.doc, l.label, statement, false FROM s SEMI JOIN m USING (doc) JOIN l ON l.doc = s.doc WHERE s.label IS NULL
UNION ALL SELECT doc, 'document', statement, true FROM s ANTI JOIN m USING (doc)""")
def axis_entities(spark, sf_dir):
    key = F.col("o_orderkey")
    said = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), key.alias("statement"), F.when(key % 3 > 0, F.col("o_orderpriority")).alias("label"))
    return entities.by_axis(said)


@register("""
SELECT o_custkey AS doc, o_orderkey AS place, o_orderpriority || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS entity
FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey)""")
def unique_labels(spark, sf_dir):
    return entities.unique_labels(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("label")))


@register("""
SELECT o_orderkey, CASE WHEN count(*) OVER (PARTITION BY o_custkey, o_orderstatus) > 1 THEN o_orderpriority || ' › ' || o_orderstatus ELSE o_orderstatus END AS entity FROM orders""")
def name_apart(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("entity"), F.col("o_orderpriority").alias("section"))
    return entities.name_apart(rows).select("o_orderkey", "entity")


@register("SELECT DISTINCT o_custkey AS doc, o_orderpriority AS label FROM orders GROUP BY o_custkey, o_orderpriority, o_orderdate >= TIMESTAMP '1995-01-01' HAVING count(DISTINCT o_orderstatus) > 1")
def label_conflicts(spark, sf_dir):
    late = (F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp")).cast("string")
    return entities.conflicts(load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("label"), late.alias("header"), F.col("o_orderstatus").alias("value")))


@register("SELECT l_linestatus AS doc, l_orderkey AS parent FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0)")
def orphan_children(spark, sf_dir):
    children = load(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("doc"), F.col("l_orderkey").alias("parent"))
    orders = load(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0")
    parents = orders.select(F.explode(F.array(F.lit("O"), F.lit("F"))).alias("doc"), F.col("o_orderkey").alias("entity"))
    return entities.check_children(children, parents)


@register("""
WITH p AS (SELECT l_orderkey AS statement, l_linenumber AS start, l_linenumber + 1 AS "end", l_returnflag AS field, max(l_discount) AS confidence FROM lineitem GROUP BY ALL)
SELECT statement, start, field FROM (SELECT *, row_number() OVER (PARTITION BY statement, start, "end" ORDER BY confidence DESC, field) AS rn FROM p) WHERE rn = 1""")
def one_field_per_span(spark, sf_dir):
    line = F.col("l_linenumber")
    picks = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("statement"), line.alias("start"), (line + 1).alias("end"), F.col("l_returnflag").alias("field")).agg(F.max("l_discount").alias("confidence"))
    return routing.one_field_per_span(picks).select("statement", "start", "field")


@register("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS p, count(*) OVER () AS n FROM events) WHERE floor(p / greatest(1.0, n / 120)) > floor((p - 1) / greatest(1.0, n / 120)) OR p = n")
def thin_points(spark, sf_dir):
    return metrics.thin(load(spark, sf_dir, "events").select("event_id"), "event_id", 120).select("event_id")


@register("""
SELECT p_partkey, round(p_size * 0.73549875, 3) AS kw, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS price, CASE WHEN p_partkey % 2 = 0 THEN 'Petrol' END AS fuel FROM part""")
def normaliser_chains(spark, sf_dir):
    registry = NormaliserRegistry()
    power = registry.compile([NormaliserStep("strip"), NormaliserStep("number"), NormaliserStep("unit", {"source": "PS", "target": "kW"})])
    price = registry.compile([*localised([NormaliserStep("money", {"currency": "EUR"})], decimal=","), NormaliserStep("whole")])
    fuel = registry.compile([NormaliserStep("value"), NormaliserStep("enum", {"options": ("Petrol", "Diesel")})])
    size = F.col("p_size").cast("string")
    written = F.concat(F.lit("Preis "), F.translate(F.format_number("p_retailprice", 2), ",.", ".,"), F.lit(" €"))
    said = F.concat(F.lit("Fuel: https://schema.org/"), F.when(F.col("p_partkey") % 2 == 0, "PETROL").otherwise("Steam"))
    return load(spark, sf_dir, "part").select("p_partkey", F.round(power(F.concat(F.lit("  up to "), size, F.lit(" PS ."))), 3).alias("kw"), price(written).alias("price"), fuel(said).alias("fuel"))


@register("""
WITH p AS (SELECT * FROM (VALUES ('base', 0.042, 0.0), ('other', 0.5, 1.5)) t(model, input_price, output_price))
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 2 THEN NULL ELSE round((n_chars * input_price + length(lang) * output_price) / 1000000, 12) END AS DOUBLE) AS cost
FROM documents LEFT JOIN p ON p.model = CASE doc_id % 3 WHEN 0 THEN 'base' WHEN 1 THEN 'other' END""")
def model_cost(spark, sf_dir):
    k = F.col("doc_id") % 3
    prices = spark.createDataFrame([("base", 0.042, 0.0), ("other", 0.5, 1.5)], "model string, input_price double, output_price double")
    named = F.when(k == 0, "base-2024-05-01").when(k == 1, "other").otherwise("unknown")
    docs = load(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(named, r"-\d{4}-\d{2}-\d{2}$", "").alias("model"), F.col("n_chars").alias("input"), F.length("lang").alias("output"))
    cost = F.round((F.col("input") * F.col("input_price") + F.col("output") * F.col("output_price")) / 1_000_000, 12)
    return docs.join(F.broadcast(prices), "model", "left").select("doc_id", cost.alias("cost"))


@register("""
WITH d AS (SELECT user_id AS doc, event_type AS field, max(value) AS p FROM events GROUP BY 1, 2)
SELECT doc, count(*) FILTER (p >= CASE field WHEN 'error' THEN 30 WHEN 'view' THEN 20 ELSE 60 END) AS kept FROM d GROUP BY 1""")
def thresholds(spark, sf_dir):
    best = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("field")).agg(F.max("value").alias("p"))
    least = routing.threshold_for(F.lit("Event"), F.col("field"), {"Event.error": 30.0, "view": 20.0, "error": 99.0}, 60.0)
    return best.groupBy("doc").agg(F.count_if(F.col("p") >= least).alias("kept"))


@register("""
SELECT name, kind, CAST(value AS DOUBLE) AS value FROM (SELECT 'documents_total' AS name, event_type AS kind, count(*) AS value FROM events GROUP BY 2 UNION ALL SELECT 'value_sum', event_type, round(sum(value), 4) FROM events GROUP BY 2)""")
def metric_families(spark, sf_dir):
    found = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kind")).agg(F.count("*").cast("double").alias("documents_total"), F.round(F.sum("value"), 4).alias("value_sum"))
    return found.unpivot("kind", ["documents_total", "value_sum"], "name", "value")


@register("""
SELECT doc_id, place, alternative, p FROM (SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY p DESC, alternative) AS INTEGER) AS place, alternative, p FROM (SELECT l_orderkey, CAST(l_partkey AS VARCHAR) AS alternative, max(l_discount) AS p FROM lineitem GROUP BY 1, 2)) WHERE place <= 3""")
def alternatives(spark, sf_dir):
    best = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").cast("string").alias("alternative")).agg(F.max("l_discount").alias("p"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("p"), "alternative")
    return best.withColumn("place", F.row_number().over(order)).filter("place <= 3").select("doc_id", "place", "alternative", "p")
