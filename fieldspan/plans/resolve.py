"""Queries over entities: a nation is a document, its customers and suppliers the parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import resolve
from fieldspan.plans.common import Register, load

register = Register()

_CELLS = """
WITH cells AS (SELECT o_custkey AS doc, o_orderstatus AS "table", CASE WHEN o_orderkey % 4 <> 0 THEN 'band ' || o_orderkey % 2 END AS band, o_orderpriority AS label, 'h' || o_orderkey % 3 AS header,
  CASE WHEN o_custkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'Six-speed' WHEN 1 THEN 'six speed' ELSE '5' END ELSE CAST(o_orderkey % 5 AS VARCHAR) END AS value, o_orderkey AS statement FROM orders),
c AS (SELECT *, replace(replace(lower(value), ' ', ''), '-', '') AS v FROM cells),
apart AS (SELECT DISTINCT doc, "table" FROM (SELECT doc, "table", label, header FROM c GROUP BY ALL HAVING count(DISTINCT v) > 1 AND count(DISTINCT band) > 1)),
named AS (SELECT c.*, CASE WHEN a.doc IS NOT NULL AND band IS NOT NULL THEN band || ' ' || label ELSE label END AS claim FROM c LEFT JOIN apart a ON a.doc = c.doc AND a."table" = c."table")
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    text = F.when(key % 3 == 0, "Six-speed").when(key % 3 == 1, "six speed").otherwise("5")
    band = F.when(key % 4 != 0, F.concat(F.lit("band "), (key % 2).cast("string")))
    return load(spark, sf_dir, "orders").select(
        customer.alias("doc"), F.col("o_orderstatus").alias("table"), band.alias("band"), F.col("o_orderpriority").alias("label"), F.concat(F.lit("h"), (key % 3).cast("string")).alias("header"),
        F.when(customer % 2 == 0, text).otherwise((key % 5).cast("string")).alias("value"), key.alias("statement"),
    )


@register(_CELLS + """SELECT doc, "table", claim AS label, string_agg(DISTINCT CAST(statement AS VARCHAR), ',' ORDER BY CAST(statement AS VARCHAR)) AS statements FROM named GROUP BY ALL""")
def row_claims(spark, sf_dir):
    joined = F.array_join(F.array_sort(F.transform("statements", lambda s: s.cast("string"))), ",")
    return resolve.row_claims(cells(spark, sf_dir)).withColumn("statements", joined)


@register(_CELLS + """, g AS (SELECT DISTINCT doc, "table", 'columns' AS axis, header AS label FROM named UNION SELECT DISTINCT doc, "table", 'rows', claim FROM named)
SELECT doc, "table", axis, label FROM (SELECT *, count(*) OVER (PARTITION BY doc, "table", axis) AS n FROM g) WHERE n >= 2""")
def table_groups(spark, sf_dir):
    return resolve.table_groups(cells(spark, sf_dir))


@register(_CELLS + """, g AS (SELECT DISTINCT doc, "table", 'columns' AS axis, header AS label FROM named UNION SELECT DISTINCT doc, "table", 'rows', claim FROM named),
k AS (SELECT doc, "table", axis, label, count(DISTINCT axis) OVER (PARTITION BY doc, "table") AS axes FROM (SELECT *, count(*) OVER (PARTITION BY doc, "table", axis) AS n FROM g) WHERE n >= 2)
SELECT doc, "table", axis, label FROM k WHERE CASE WHEN doc % 5 = 0 THEN axis = 'rows' WHEN doc % 5 = 1 THEN FALSE ELSE axes = 1 END""")
def one_axis(spark, sf_dir):
    groups = resolve.table_groups(cells(spark, sf_dir))
    choices = groups.select("doc", "table").distinct().filter("doc % 5 < 2").withColumn("axis", F.when(F.col("doc") % 5 == 0, "rows").otherwise("none"))
    return resolve.one_axis(groups, choices)


_PARTS = """
WITH parts AS (SELECT o_custkey AS doc, '0.' || o_orderkey % 3 || '.' || o_orderkey AS path, '0.' || o_orderkey % 3 AS parent, CASE WHEN o_orderkey % 7 = 0 THEN 'table' ELSE 'section' END AS type, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority END AS label, CASE WHEN o_orderkey % 2 = 0 THEN 'heading,paragraph' ELSE 'heading,paragraph,paragraph' END AS children, o_orderkey % 3 <> 1 AS headed FROM orders)
"""


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    parent = F.concat(F.lit("0."), (key % 3).cast("string"))
    children = F.when(key % 2 == 0, F.array(F.lit("heading"), F.lit("paragraph"))).otherwise(F.array(F.lit("heading"), F.lit("paragraph"), F.lit("paragraph")))
    return load(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc"), F.concat_ws(".", parent, key.cast("string")).alias("path"), parent.alias("parent"), F.when(key % 7 == 0, "table").otherwise("section").alias("type"),
        F.when(key % 11 != 0, F.col("o_orderpriority")).alias("label"), children.alias("children"), (key % 3 != 1).alias("headed"),
    )


@register(_PARTS + """, named AS (SELECT * FROM parts WHERE label IS NOT NULL),
runs AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc, parent, type, children) AS n FROM named WHERE type = 'section') WHERE n >= 2),
told AS (SELECT n.doc, n.parent FROM named n LEFT JOIN runs r ON r.doc = n.doc AND r.path = n.path WHERE n.headed GROUP BY 1, 2 HAVING count(*) >= 2 AND (count(*) FILTER (r.path IS NULL) > 0 OR count(DISTINCT r.children) > 1))
SELECT doc, parent, 1 AS rule, path, label FROM runs UNION ALL SELECT doc, parent, 2, path, label FROM named WHERE headed AND (doc, parent) IN (SELECT (doc, parent) FROM told)""")
def component_groups(spark, sf_dir):
    return resolve.component_groups(parts(spark, sf_dir))


@register(_PARTS + """, nested AS (SELECT doc, path, label FROM parts WHERE type = 'section' UNION ALL SELECT doc, path || '.1', 'inner' FROM parts UNION ALL SELECT doc, path || '.1.4', 'inmost' FROM parts)
SELECT * FROM nested WHERE label <> 'inmost' AND (label <> 'inner' OR (doc, path) NOT IN (SELECT (doc, path || '.1') FROM parts WHERE type = 'section')) OR label IS NULL""")
def type_members(spark, sf_dir):
    own = parts(spark, sf_dir).select("doc", "path", "label", "type")
    inner = own.select("doc", F.concat("path", F.lit(".1")).alias("path"), F.lit("inner").alias("label"), F.lit("section").alias("type"))
    inmost = own.select("doc", F.concat("path", F.lit(".1.4")).alias("path"), F.lit("inmost").alias("label"), F.lit("section").alias("type"))
    return resolve.type_members(own.union(inner).union(inmost), "section")


@register("""
WITH picks AS (SELECT c_nationkey AS doc, c_mktsegment || CASE WHEN c_custkey % 3 = 0 THEN ' plus' ELSE '' END AS entity, CASE c_custkey % 4 WHEN 0 THEN c_mktsegment WHEN 1 THEN lower(c_mktsegment) WHEN 2 THEN 'LINE ' || c_custkey % 2 ELSE c_mktsegment || ' plus wide' END AS picked,
  max(CASE WHEN c_custkey % 5 = 0 THEN 0.5 ELSE 0.9 END) AS p, bool_and(c_custkey % 10 = 3) AS conflict, bool_or(c_custkey % 20 = 1) AS entity_apart, bool_or(c_custkey % 28 = 1) AS picked_apart FROM customer GROUP BY ALL),
sure AS (SELECT * FROM picks WHERE p >= 0.7 AND NOT conflict), n AS (SELECT doc, picked, count(*) AS n FROM sure GROUP BY 1, 2),
w AS (SELECT s.*, list_sort(list_distinct(string_split(lower(s.entity), ' '))) AS a, list_sort(list_distinct(string_split(lower(s.picked), ' '))) AS b, coalesce(n1.n, 0) AS of_n, coalesce(n2.n, 0) AS own_n,
  (s.doc, s.picked, s.entity) IN (SELECT (doc, entity, picked) FROM sure) AS back FROM sure s LEFT JOIN n n1 ON n1.doc = s.doc AND n1.picked = s.picked LEFT JOIN n n2 ON n2.doc = s.doc AND n2.picked = s.entity),
h AS (SELECT *, CASE WHEN a = b THEN CASE WHEN entity_apart AND NOT picked_apart THEN 'kind' WHEN picked_apart AND NOT entity_apart THEN 'over' WHEN NOT entity_apart THEN 'same' END
  WHEN list_has_all(b, a) THEN 'over' WHEN list_has_all(a, b) OR NOT back THEN 'kind' WHEN of_n > own_n THEN 'kind' WHEN of_n = own_n THEN 'same' END AS how FROM w)
SELECT DISTINCT doc, CASE how WHEN 'same' THEN least(entity, picked) WHEN 'over' THEN picked ELSE entity END AS finer, CASE how WHEN 'same' THEN greatest(entity, picked) WHEN 'over' THEN entity ELSE picked END AS coarser, how = 'same' AS same FROM h WHERE how IS NOT NULL""")
def entity_relations(spark, sf_dir):
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    entity = F.concat(segment, F.when(key % 3 == 0, " plus").otherwise(""))
    picked = F.when(key % 4 == 0, segment).when(key % 4 == 1, F.lower(segment)).when(key % 4 == 2, F.concat(F.lit("LINE "), (key % 2).cast("string"))).otherwise(F.concat(segment, F.lit(" plus wide")))
    rows = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc"), entity.alias("entity"), picked.alias("picked"))
    return resolve.relations(rows.agg(F.max(F.when(key % 5 == 0, 0.5).otherwise(0.9)).alias("p"), F.every(key % 10 == 3).alias("conflict"), F.some(key % 20 == 1).alias("entity_apart"), F.some(key % 28 == 1).alias("picked_apart")))


@register("""
WITH g AS (SELECT o_custkey AS doc, 'g' || o_orderkey % 3 AS grp, o_orderkey % 3 AS depth, o_orderkey % 2 AS rule, o_orderpriority AS label, o_orderkey // 10 AS statement FROM orders),
f AS (SELECT *, first_value(grp) OVER (PARTITION BY doc, statement ORDER BY depth DESC, rule, grp) AS best FROM g)
SELECT DISTINCT doc, statement, label FROM f WHERE grp = best AND statement % 3 <> 0""")
def owners(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.concat(F.lit("g"), (key % 3).cast("string")).alias("group"), (key % 3).alias("depth"), (key % 2).alias("rule"), F.col("o_orderpriority").alias("label"), F.floor(key / 10).alias("statement"))
    groups = rows.groupBy("doc", "group", "depth", "rule", "label").agg(F.collect_set("statement").alias("statements"))
    return resolve.owners(rows.filter("statement % 3 <> 0"), groups).distinct()


@register("""
WITH own AS (SELECT DISTINCT o_custkey AS doc, o_orderkey AS statement, o_orderpriority AS label, CASE WHEN o_orderkey % 3 = 0 THEN 'heading' ELSE 'sentence' END AS kind FROM orders),
solid AS (SELECT DISTINCT doc, label FROM own WHERE kind = 'sentence'), kinds AS (SELECT doc, '1-URGENT' AS finer, '2-HIGH' AS coarser FROM solid UNION SELECT doc, '3-MEDIUM', '5-LOW' FROM solid)
SELECT doc, label FROM solid s WHERE NOT EXISTS (SELECT 1 FROM kinds k JOIN solid t ON t.doc = k.doc AND t.label = k.finer WHERE k.doc = s.doc AND k.coarser = s.label)""")
def finest_entities(spark, sf_dir):
    own = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("statement"), F.col("o_orderpriority").alias("label"), F.when(F.col("o_orderkey") % 3 == 0, "heading").otherwise("sentence").alias("kind"))
    pair = lambda a, b: F.struct(F.lit(a).alias("finer"), F.lit(b).alias("coarser"))
    kinds = own.select("doc").distinct().select("doc", F.explode(F.array(pair("1-URGENT", "2-HIGH"), pair("3-MEDIUM", "5-LOW"))).alias("k")).select("doc", "k.*")
    return resolve.finest(own, kinds, own)


@register("""
WITH loose AS (SELECT o_custkey AS doc, o_orderkey AS statement, '0.' || o_orderkey % 3 || '.' || o_orderkey % 4 AS path, CASE WHEN o_orderkey % 9 = 0 THEN 'heading' ELSE 'sentence' END AS kind FROM orders),
recs AS (SELECT DISTINCT o_custkey AS doc, o_orderpriority AS label, '0.' || o_orderkey % 2 || '.' || o_orderkey % 5 AS path FROM orders WHERE o_orderkey % 3 <> 0),
held AS (SELECT DISTINCT doc, label, u.part FROM recs, (SELECT 0) z, LATERAL (SELECT unnest([path, regexp_replace(path, '\\.[0-9]+$', ''), '0']) AS part) u),
up AS (SELECT doc, statement, kind, u.part, length(u.part) AS depth FROM loose, LATERAL (SELECT unnest([path, regexp_replace(path, '\\.[0-9]+$', ''), '0']) AS part) u),
near AS (SELECT doc, statement, kind, arg_max(part, depth) AS part FROM up WHERE (doc, part) IN (SELECT (doc, part) FROM held) GROUP BY 1, 2, 3),
offered AS (SELECT n.*, h.label, count(*) OVER (PARTITION BY n.doc, n.statement) AS n FROM near n JOIN held h ON h.doc = n.doc AND h.part = n.part),
told AS (SELECT *, CASE statement % 5 WHEN 0 THEN 'all' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '5-LOW' END AS choice FROM offered),
s AS (SELECT *, kind = 'heading' OR n = 1 OR choice IS NULL OR choice = 'all' AS shared FROM told)
SELECT doc, statement, label, shared FROM s WHERE shared OR label = choice""")
def assigned_statements(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders")
    path = lambda a, b: F.concat_ws(".", F.lit("0"), (key % a).cast("string"), (key % b).cast("string")).alias("path")
    loose = orders.select(F.col("o_custkey").alias("doc"), key.alias("statement"), path(3, 4), F.when(key % 9 == 0, "heading").otherwise("sentence").alias("kind"))
    records = orders.filter(key % 3 != 0).select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("label"), path(2, 5)).distinct()
    answers = orders.filter(key % 5 < 3).select(F.col("o_custkey").alias("doc"), key.alias("statement"), F.when(key % 5 == 0, "all").when(key % 5 == 1, "2-HIGH").otherwise("5-LOW").alias("choice"))
    return resolve.assigned(loose, records, answers)


@register("""
WITH l AS (SELECT DISTINCT p_size AS doc, p_brand AS tab, upper(p_name) AS label FROM part), e AS (SELECT DISTINCT p_size AS doc, p_type AS tab, regexp_replace(p_name, ' [A-Za-z0-9]+$', '') AS other FROM part),
w AS (SELECT l.doc, label, other, list_distinct(string_split(lower(label), ' ')) AS a, list_distinct(string_split(lower(other), ' ')) AS b FROM l JOIN e ON l.doc = e.doc AND l.tab <> e.tab)
SELECT DISTINCT doc, label, other FROM w WHERE list_has_all(a, b) OR list_has_all(b, a)""")
def named_elsewhere(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    labels = part.select(F.col("p_size").alias("doc"), F.col("p_brand").alias("table"), F.upper("p_name").alias("label")).distinct()
    other = part.select(F.col("p_size").alias("doc"), F.col("p_type").alias("table"), F.regexp_replace("p_name", " [A-Za-z0-9]+$", "").alias("label")).distinct()
    return resolve.named_elsewhere(labels, other)


@register("""
WITH o AS (SELECT o_custkey AS doc, '0.' || o_orderkey AS path, o_orderkey AS k FROM orders UNION ALL SELECT o_custkey, '0.' || o_orderkey || '.1', o_orderkey + 1 FROM orders),
labels AS (SELECT DISTINCT o_custkey AS doc, o_orderpriority AS label FROM orders),
ans AS (SELECT doc, path, CASE WHEN k % 3 = 0 THEN '1-URGENT' WHEN k % 3 = 1 THEN '5-LOW' ELSE 'none' END AS choice FROM o),
placed AS (SELECT a.* FROM ans a WHERE (doc, choice) IN (SELECT (doc, label) FROM labels)),
own AS (SELECT * FROM placed p WHERE NOT EXISTS (SELECT 1 FROM placed q WHERE q.doc = p.doc AND starts_with(q.path, p.path || '.')))
SELECT doc, choice AS label, path, FALSE AS shared FROM own UNION ALL SELECT o.doc, label, path, TRUE FROM o JOIN labels USING (doc) WHERE (o.doc, path) NOT IN (SELECT (doc, path) FROM own)""")
def placed_values(spark, sf_dir):
    orders, key = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("0."), key.cast("string"))
    outer = orders.select(F.col("o_custkey").alias("doc"), path.alias("path"), key.alias("k"))
    objects = outer.union(orders.select("o_custkey", F.concat(path, F.lit(".1")), key + 1))
    labels = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderpriority").alias("label")).distinct()
    answers = objects.select("doc", "path", F.when(F.col("k") % 3 == 0, "1-URGENT").when(F.col("k") % 3 == 1, "5-LOW").otherwise("none").alias("choice"))
    return resolve.placed_values(objects.select("doc", "path"), labels, answers)
