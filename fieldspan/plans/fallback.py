"""Queries over the generative route: a user is a scope, an event's type the field, an event the statement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.operators import fallback
from fieldspan.plans.common import Register, load

register = Register()

_ASKED = """
WITH asked AS (SELECT event_id AS statement, event_type AS field, CASE WHEN event_id % 9 = 0 THEN 'table_header' ELSE 'sentence' END AS kind, event_id % 4 AS candidates, event_id % 5 <> 0 AS selected,
  CASE WHEN event_id % 3 <> 0 THEN 'raw' END AS raw, event_id % 10 / 10.0 AS confidence, user_id % 10 / 10.0 AS category_p FROM events)
"""


@register(_ASKED + """, t AS (SELECT statement, field, CASE WHEN kind = 'table_header' THEN NULL WHEN candidates = 0 THEN 'no_candidates' WHEN NOT selected THEN NULL WHEN raw IS NULL THEN CASE WHEN category_p >= 0.5 THEN 'none_chosen' END WHEN confidence < 0.3 THEN 'low_confidence' END AS trigger FROM asked)
SELECT * FROM t WHERE trigger IS NOT NULL""")
def fallback_triggers(spark, sf_dir):
    at = F.col("event_id")
    asked = load(spark, sf_dir, "events").select(
        at.alias("statement"), F.col("event_type").alias("field"), F.when(at % 9 == 0, "table_header").otherwise("sentence").alias("kind"), (at % 4).alias("candidates"), (at % 5 != 0).alias("selected"),
        F.when(at % 3 != 0, "raw").alias("raw"), (at % 10 / 10).alias("confidence"), (F.col("user_id") % 10 / 10).alias("category_p"),
    )
    return fallback.triggers(asked).select("statement", "field", "trigger")


_VALUES = """
WITH vals AS (SELECT user_id % 50 AS doc, user_id AS scope, event_type AS field, CASE WHEN count(*) % 4 <> 0 THEN CAST(max(event_id) AS VARCHAR) END AS value, CASE WHEN count(*) % 5 <> 0 THEN CAST(count(*) % 10 / 10.0 AS DOUBLE) END AS confidence, 'selected' AS method FROM events GROUP BY ALL),
answers AS (SELECT user_id % 50 AS doc, user_id AS scope, event_type AS field, CAST(event_id % 7 AS VARCHAR) AS value, CAST(event_id % 20 / 20.0 AS DOUBLE) AS p, event_id % 20 / 20.0 >= 0.7 AS verified, event_id % 2 AS shared, event_id AS ord FROM events WHERE user_id % 3 <> 0)
"""


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count("*")
    grouped = load(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("doc"), F.col("user_id").alias("scope"), F.col("event_type").alias("field"))
    return grouped.agg(F.when(n % 4 != 0, F.max("event_id").cast("string")).alias("value"), F.when(n % 5 != 0, n % 10 / 10).alias("confidence"), F.lit("selected").alias("method"))


@register(_VALUES + """
SELECT d.doc, d.scope, f.field FROM (SELECT DISTINCT doc, scope FROM vals) d, (VALUES ('click'), ('view'), ('error')) f(field)
EXCEPT SELECT doc, scope, field FROM vals WHERE value IS NOT NULL AND coalesce(confidence, 1) >= 0.3""")
def fallback_needs(spark, sf_dir):
    own = values(spark, sf_dir)
    wanted = own.select("doc", "scope").distinct().select("*", F.explode(F.array(*map(F.lit, ("click", "view", "error")))).alias("field"))
    return fallback.still_needed(own, wanted)


@register(_VALUES + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, scope, field ORDER BY shared, p DESC, ord) AS rn FROM answers WHERE verified),
best AS (SELECT doc, scope, field, value, p, shared FROM ranked WHERE rn = 1),
lists AS (SELECT doc, scope, field, string_agg(value, ',' ORDER BY ord) AS value, min(least) AS p FROM (SELECT r.doc, r.scope, r.field, r.value, min(r.ord) AS ord, min(r.p) AS least FROM ranked r JOIN best b ON r.doc = b.doc AND r.scope = b.scope AND r.field = b.field AND r.shared = b.shared GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
told AS (SELECT doc, scope, field, CASE WHEN field = 'view' THEN l.value ELSE b.value END AS value, CASE WHEN field = 'view' THEN l.p ELSE b.p END AS p FROM best b JOIN lists l USING (doc, scope, field)),
keys AS (SELECT doc, scope, field FROM vals UNION SELECT doc, scope, field FROM answers),
final AS (SELECT k.*, coalesce(t.value, v.value) AS value, CASE WHEN t.value IS NOT NULL THEN t.p ELSE v.confidence END AS confidence, CASE WHEN t.value IS NOT NULL THEN 'generated' ELSE v.method END AS method, v.value AS was, v.confidence AS was_p, t.value IS NOT NULL AS taken FROM keys k LEFT JOIN vals v USING (doc, scope, field) LEFT JOIN told t USING (doc, scope, field)),
others AS (SELECT a.doc, a.scope, a.field, a.value, a.p FROM answers a UNION ALL SELECT doc, scope, field, was, coalesce(was_p, 0) FROM final WHERE taken AND was IS NOT NULL),
alts AS (SELECT o.doc, o.scope, o.field, o.value, max(o.p) AS p FROM others o JOIN final f ON o.doc = f.doc AND o.scope = f.scope AND o.field = f.field AND o.value IS DISTINCT FROM f.value GROUP BY ALL)
SELECT doc, scope, field, value, confidence, method, coalesce((SELECT string_agg(a.value, '|' ORDER BY a.p DESC, a.value) FROM alts a WHERE a.doc = f.doc AND a.scope = f.scope AND a.field = f.field), '') AS alternatives FROM final f""")
def fallback_settle(spark, sf_dir):
    at = F.col("event_id")
    p = at % 20 / 20
    answers = load(spark, sf_dir, "events").filter("user_id % 3 <> 0").select((F.col("user_id") % 50).alias("doc"), F.col("user_id").alias("scope"), F.col("event_type").alias("field"), (at % 7).cast("string").alias("value"), p.alias("p"), (at % 2).alias("shared"), at.alias("ord"))
    return fallback.settle(values(spark, sf_dir), fallback.verified(answers), F.col("field") == "view")


@register("""
SELECT o_orderkey AS statement, o_orderpriority AS value, 10 AS start, 10 + length(o_orderpriority) AS "end" FROM orders WHERE o_orderkey % 3 <> 0""")
def fallback_grounded(spark, sf_dir):
    def extract(text, field):
        if text.startswith("Broken"):
            raise ValueError(text)
        return text.split(": ")[1], text.split(": ")[1].replace(" ", "\n ")

    orders = load(spark, sf_dir, "orders")
    said = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Broken").otherwise("Priority"), F.lit(": "), F.col("o_orderpriority"))
    asks = orders.select(F.col("o_orderkey").alias("statement"), F.lit("priority").alias("field"), said.alias("text"))
    return fallback.grounded(fallback.generated(asks, extract)).select("statement", "value", F.col("at.start").alias("start"), F.col("at.end").alias("end"))
