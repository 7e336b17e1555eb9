"""Queries over embedded data: an event is a blob of its user's document, its type the fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import keypaths
from fieldspan.plans.common import Register, load

register = Register()

_LEAVES = """
WITH e AS (SELECT user_id AS doc, event_id AS blob, event_type AS fingerprint, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
leaves AS (
  SELECT doc, blob, fingerprint, 0 AS ix, '$.k' AS path, '$.k' AS shape, CAST(k % 3 AS VARCHAR) AS value FROM e
  UNION ALL SELECT doc, blob, fingerprint, 1, '$.items[0].name', '$.items[].name', fingerprint || k % 2 FROM e
  UNION ALL SELECT doc, blob, fingerprint, 2, '$.items[1].name', '$.items[].name', CASE WHEN blob % 50 = 0 THEN 'none' ELSE fingerprint END FROM e),
shapes AS (SELECT DISTINCT fingerprint, 'Event' AS schema, shape FROM leaves),
mappings(layer, fingerprint, schema, shape, field) AS (VALUES (1, 'click', 'Event', '$.k', 'number'), (2, 'click', 'Event', '$.k', 'other'), (2, 'view', 'Event', '$.k', NULL), (1, 'error', 'Event', '$.items[].name', 'names'), (2, 'view', 'Event', '$.items[].name', 'label'), (3, 'purchase', 'Event', '$.k', 'number')),
firsts AS (SELECT fingerprint, schema, shape, field FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint, schema, shape ORDER BY layer) AS rn FROM mappings) WHERE rn = 1),
mapped AS (SELECT s.*, f.field, f.fingerprint IS NOT NULL AS known FROM shapes s LEFT JOIN firsts f USING (fingerprint, schema, shape))
"""
_MAPPINGS = [(1, "click", "Event", "$.k", "number"), (2, "click", "Event", "$.k", "other"), (2, "view", "Event", "$.k", None), (1, "error", "Event", "$.items[].name", "names"), (2, "view", "Event", "$.items[].name", "label"), (3, "purchase", "Event", "$.k", "number")]


def leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    leaf = lambda ix, path, shape, value: F.struct(F.lit(ix).alias("ix"), F.lit(path).alias("path"), F.lit(shape).alias("shape"), value.alias("value"))
    own = F.array(
        leaf(0, "$.k", "$.k", (k % 3).cast("string")),
        leaf(1, "$.items[0].name", "$.items[].name", F.concat("event_type", (k % 2).cast("string"))),
        leaf(2, "$.items[1].name", "$.items[].name", F.when(F.col("event_id") % 50 == 0, "none").otherwise(F.col("event_type"))),
    )
    events = load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "props")
    return events.select(F.col("user_id").alias("doc"), F.col("event_id").alias("blob"), F.col("event_type").alias("fingerprint"), F.explode(own).alias("l")).select("doc", "blob", "fingerprint", "l.*")


def mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    shapes = leaves(spark, sf_dir).select("fingerprint", F.lit("Event").alias("schema"), "shape").distinct()
    mappings = spark.createDataFrame(_MAPPINGS, "layer int, fingerprint string, schema string, shape string, field string")
    return keypaths.known(shapes, mappings)


@register(_LEAVES + "SELECT * FROM mapped")
def keypath_known(spark, sf_dir):
    return mapped(spark, sf_dir)


@register(_LEAVES + """, r AS (SELECT l.fingerprint, shape, path || ': ' || value AS line, value, ix, row_number() OVER (PARTITION BY l.fingerprint, shape ORDER BY doc, blob, ix) AS rn FROM leaves l JOIN mapped m USING (fingerprint, shape) WHERE NOT known)
SELECT fingerprint, shape, 0 AS batch, string_agg(line, chr(10) ORDER BY rn) AS lines, min(value) FILTER (rn = 1) AS example FROM r WHERE rn <= 3 GROUP BY 1, 2""")
def keypath_questions(spark, sf_dir):
    return keypaths.questions(leaves(spark, sf_dir), mapped(spark, sf_dir).filter("NOT known"))


@register(_LEAVES + """, a AS (SELECT fingerprint, schema, shape, CASE WHEN shape = '$.k' THEN 'number' ELSE 'none' END AS field, CASE WHEN fingerprint < 'd' THEN 0.3 WHEN fingerprint < 'm' THEN 0.5 ELSE 0.4 END AS p, CASE WHEN fingerprint < 'd' THEN 2 ELSE 1 END AS times FROM shapes)
SELECT fingerprint, schema, shape, CASE WHEN p >= 0.5 AND field <> 'none' THEN field END AS field, p >= 0.5 OR times + 1 >= 3 AS sure, CAST(CASE WHEN p >= 0.5 THEN 0 ELSE times + 1 END AS BIGINT) AS times FROM a""")
def keypath_accepted(spark, sf_dir):
    shapes = leaves(spark, sf_dir).select("fingerprint", F.lit("Event").alias("schema"), "shape").distinct()
    kind = F.col("fingerprint")
    answers = shapes.withColumns({"field": F.when(F.col("shape") == "$.k", "number").otherwise("none"), "p": F.when(kind < "d", 0.3).when(kind < "m", 0.5).otherwise(0.4)})
    return keypaths.accepted(answers, shapes.withColumn("times", F.when(kind < "d", 2).otherwise(1).cast("long")))


_VALUES = _LEAVES + """, j AS (SELECT doc, schema, field, value, blob, ix FROM leaves JOIN mapped USING (fingerprint, shape) WHERE field IS NOT NULL),
d AS (SELECT doc, schema, field, value, min_by(ix, (blob, ix)) AS ix, min((blob, ix)) AS place FROM j GROUP BY 1, 2, 3, 4),
vals AS (SELECT doc, schema, field, value, value AS raw, ix FROM d WHERE field <> 'names'
  UNION ALL SELECT doc, schema, field, string_agg(value, ',' ORDER BY place), min_by(value, place), min_by(ix, place) FROM d WHERE field = 'names' GROUP BY 1, 2, 3)
"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keypaths.field_values(leaves(spark, sf_dir), mapped(spark, sf_dir), F.col("value"), F.col("field") == "names")


@register(_VALUES + "SELECT * FROM vals")
def keypath_values(spark, sf_dir):
    return values(spark, sf_dir)


_OPTIONS = _VALUES.rstrip() + """, o AS (SELECT *, CASE WHEN raw = 'none' THEN '"none"' ELSE raw END AS opt FROM vals),
u AS (SELECT doc, schema, field, opt, min(ix) AS ix FROM o GROUP BY ALL)
"""


@register(_OPTIONS + "SELECT doc, schema, field, string_agg(opt, '|' ORDER BY ix, opt) AS options FROM u GROUP BY 1, 2, 3 HAVING count(*) > 1")
def keypath_disputed(spark, sf_dir):
    return keypaths.disputed(values(spark, sf_dir)).withColumn("options", F.array_join("options", "|"))


@register(_OPTIONS + """, c AS (SELECT doc, schema, field, CASE WHEN doc % 3 = 0 THEN 'none' ELSE max(opt) END AS choice FROM u GROUP BY 1, 2, 3 HAVING count(*) > 1),
s AS (SELECT o.*, choice FROM o LEFT JOIN c USING (doc, schema, field))
SELECT doc, schema, field, CASE WHEN any_value(choice) IS NULL THEN min_by(value, ix) ELSE min(value) FILTER (opt = choice) END AS value, CASE WHEN any_value(choice) IS NOT NULL THEN CAST(0.75 AS DOUBLE) END AS confidence,
  coalesce(string_agg(DISTINCT value, '|' ORDER BY value) FILTER (choice IS NOT NULL AND opt <> choice), '') AS alternatives FROM s GROUP BY 1, 2, 3""")
def keypath_settle(spark, sf_dir):
    own = values(spark, sf_dir)
    asked = keypaths.disputed(own)
    answers = asked.select("doc", "schema", "field", F.when(F.col("doc") % 3 == 0, "none").otherwise(F.array_max("options")).alias("choice"), F.lit(0.75).alias("p"))
    return keypaths.settle(own, answers)


_WANTED = _VALUES.rstrip() + """, wanted AS (SELECT DISTINCT doc, 'Event' AS schema, f.field FROM leaves, (VALUES ('number'), ('label'), ('names')) f(field))
"""


@register(_WANTED + """
SELECT 'fill_gaps' AS mode, * FROM (SELECT doc, schema, field FROM wanted EXCEPT SELECT doc, schema, field FROM vals)
UNION ALL SELECT 'structured_only', doc, schema, field FROM wanted WHERE doc NOT IN (SELECT doc FROM vals)
UNION ALL SELECT 'merge', * FROM wanted""")
def layout_needed(spark, sf_dir):
    own = values(spark, sf_dir)
    docs = leaves(spark, sf_dir).select("doc").distinct()
    wanted = docs.select("doc", F.lit("Event").alias("schema"), F.explode(F.array(F.lit("number"), F.lit("label"), F.lit("names"))).alias("field"))
    parts = [keypaths.layout_needed(own, wanted, mode).select(F.lit(mode).alias("mode"), "doc", "schema", "field") for mode in ("fill_gaps", "structured_only", "merge")]
    return parts[0].union(parts[1]).union(parts[2])


@register(_LEAVES + "SELECT doc, blob, CASE ix WHEN 1 THEN '$.items[0]' ELSE '$.items[1]' END AS item, path, value FROM leaves WHERE ix > 0")
def structured_items(spark, sf_dir):
    return keypaths.items(leaves(spark, sf_dir))
