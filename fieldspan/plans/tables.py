"""Queries over tables of cells: an order is a table, its lines are the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import tables
from fieldspan.plans.common import Register, load

register = Register()

#: Marked tables, unmarked ones of two and three columns, records of text, numeric heads, blank rows.
_CELLS = """
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, l_returnflag AS f, l_orderkey % 3 = 0 AS marked, l_orderkey % 5 = 0 AS narrow FROM lineitem),
cells AS (
  SELECT doc, 'lines' AS "table", n AS row, 0 AS col, 1 AS row_span, 1 AS col_span, marked AS header, CASE WHEN doc % 7 = 1 THEN CAST(n AS VARCHAR) ELSE 'Line ' || n END AS text FROM l
  UNION ALL SELECT doc, 'lines', n, 1, 1, 1, FALSE, CASE WHEN marked AND n = 3 THEN ' ' WHEN doc % 4 = 0 THEN 'flag ' || f ELSE q END FROM l
  UNION ALL SELECT doc, 'lines', n, 2, 1, 1, FALSE, CASE WHEN marked AND n = 3 THEN '' ELSE q || ' PS' END FROM l WHERE NOT narrow
  UNION ALL SELECT doc, 'lines', 0, c.col, 1, 1, marked, c.text FROM (SELECT DISTINCT doc, marked FROM l WHERE NOT narrow) d, (VALUES (0, ''), (1, 'Quantity'), (2, 'Power')) c(col, text) WHERE NOT (doc % 11 = 0 AND c.col = 1)
  UNION ALL SELECT DISTINCT doc, 'lines', 0, 1, 1, 1, marked, '2019' FROM l WHERE NOT narrow AND doc % 11 = 0
), filled AS (SELECT * FROM cells WHERE trim(text) <> ''),
"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, n = F.col("l_orderkey"), F.col("l_linenumber")
    marked, narrow = doc % 3 == 0, doc % 5 == 0
    quantity = F.col("l_quantity").cast("long").cast("string")
    cell = lambda row, col, header, said: F.struct(row.cast("int").alias("row"), F.lit(col).alias("col"), F.lit(1).alias("row_span"), F.lit(1).alias("col_span"), header.alias("header"), said.alias("text"))
    no = F.lit(False)
    own = [
        cell(n, 0, marked, F.when(doc % 7 == 1, n.cast("string")).otherwise(F.concat(F.lit("Line "), n.cast("string")))),
        cell(n, 1, no, F.when(marked & (n == 3), " ").when(doc % 4 == 0, F.concat(F.lit("flag "), F.col("l_returnflag"))).otherwise(quantity)),
        F.when(~narrow, cell(n, 2, no, F.when(marked & (n == 3), "").otherwise(F.concat(quantity, F.lit(" PS"))))),
    ]
    lines = load(spark, sf_dir, "lineitem")
    body = lines.select(doc.alias("doc"), F.explode(F.array_compact(F.array(*own))).alias("c"))
    zero = F.lit(0)
    heads = [cell(zero, 0, marked, F.lit("")), cell(zero, 1, marked, F.when(doc % 11 == 0, "2019").otherwise("Quantity")), cell(zero, 2, marked, F.lit("Power"))]
    top = lines.filter(~narrow).select("l_orderkey").distinct().select(doc.alias("doc"), F.explode(F.array(*heads)).alias("c"))
    return body.union(top).select("doc", F.lit("lines").alias("table"), "c.*")


_SHAPES = """
whole AS (SELECT doc, max(col + 1) AS width, min(row) AS top FROM filled GROUP BY doc HAVING doc NOT IN (SELECT doc FROM cells WHERE header)),
s AS (SELECT f.*, width, top, len(regexp_extract_all(text, '[0-9]')) AS d, len(regexp_extract_all(text, '[A-Za-z]')) AS a FROM filled f JOIN whole USING (doc)),
shapes AS (SELECT doc, "table", CASE
  WHEN any_value(width) = 2 AND count(*) FILTER (col = 0) > 0 AND count(*) FILTER (col = 1) > 0 AND bool_and(col <> 0 OR a > 0) THEN 'labels'
  WHEN any_value(width) >= 3 AND count(*) FILTER (row > top AND col > 0) > 0 AND count(DISTINCT col) FILTER (row = top AND col > 0) = any_value(width) - 1
    AND count(DISTINCT row) FILTER (row > top) = count(DISTINCT row) FILTER (row > top AND col = 0)
    AND bool_and(row > top OR col = 0 OR (a > 0 AND a >= d)) AND bool_and(row = top OR col > 0 OR a > 0)
    AND 2 * count(*) FILTER (row > top AND col > 0 AND d > 0 AND d >= a) > count(*) FILTER (row > top AND col > 0) THEN 'comparison' END AS shape FROM s GROUP BY doc, "table")
"""


@register(_CELLS + _SHAPES + "SELECT doc, \"table\", shape FROM shapes WHERE shape IS NOT NULL")
def header_shapes(spark, sf_dir):
    return tables.header_shape(cells(spark, sf_dir))


@register(_CELLS + """
datacols AS (SELECT DISTINCT doc, col FROM filled WHERE NOT header),
heads AS (SELECT doc, row, max(col + 1) AS stop FROM filled GROUP BY doc, row HAVING bool_and(header)),
blank AS (SELECT DISTINCT c.doc, c.row FROM cells c JOIN heads h ON c.doc = h.doc AND c.row = h.row JOIN datacols d ON d.doc = c.doc AND d.col = c.col WHERE trim(c.text) = '' AND NOT c.header AND c.col >= h.stop),
whole AS (SELECT doc, max(col + 1) AS width, min(row) AS top, bool_and(header) AS every_head, bool_or(header) AS some_head FROM filled GROUP BY doc),
named AS (SELECT DISTINCT f.doc FROM filled f JOIN whole USING (doc) WHERE header AND row = top AND col > 0),
states AS (SELECT DISTINCT doc, row FROM filled JOIN whole USING (doc) WHERE NOT header AND (row <> top OR doc NOT IN (SELECT doc FROM named) OR regexp_matches(text, '[A-Za-z0-9]')) UNION SELECT * FROM blank)
SELECT f.doc, 'lines' AS "table", f.row, CASE WHEN any_value(every_head) OR NOT any_value(some_head) OR (f.doc, f.row) IN (SELECT (doc, row) FROM states) OR NOT bool_or(header) THEN 'body'
  WHEN count(*) = 1 AND min(col) = 0 AND any_value(width) > 1 THEN 'band' ELSE 'header' END AS role FROM filled f JOIN whole USING (doc) GROUP BY f.doc, f.row""")
def row_roles(spark, sf_dir):
    return tables.row_roles(cells(spark, sf_dir))


@register(_CELLS + """
datacols AS (SELECT DISTINCT doc, col FROM filled WHERE NOT header),
heads AS (SELECT doc, row, max(col + 1) AS stop FROM filled GROUP BY doc, row HAVING bool_and(header))
SELECT DISTINCT c.doc, 'lines' AS "table", c.row FROM cells c JOIN heads h ON c.doc = h.doc AND c.row = h.row JOIN datacols d ON d.doc = c.doc AND d.col = c.col WHERE trim(c.text) = '' AND NOT c.header AND c.col >= h.stop""")
def blank_rows(spark, sf_dir):
    return tables.blank_rows(cells(spark, sf_dir))


@register(_CELLS + _SHAPES + """
SELECT c.doc, c."table", c.row, c.col, c.header OR coalesce(CASE WHEN shape = 'comparison' THEN (c.row = w.top AND c.doc % 2 = 0) OR c.col = 0 WHEN shape = 'labels' THEN c.col = 0 END, FALSE) AS header
FROM cells c LEFT JOIN shapes s ON s.doc = c.doc LEFT JOIN whole w ON w.doc = c.doc""")
def inferred_headers(spark, sf_dir):
    own = cells(spark, sf_dir)
    docs = own.select("doc", "table").distinct()
    axes = docs.withColumn("axis", F.explode(F.when(F.col("doc") % 2 == 0, F.array(F.lit("rows"), F.lit("columns"))).otherwise(F.array(F.lit("rows")))))
    return tables.infer_headers(own, axes).select("doc", "table", "row", "col", "header")
