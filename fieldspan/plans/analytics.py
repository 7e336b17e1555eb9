"""Queries over operational and learned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.functions import text
from fieldspan.operators import budgets, evaluate, learned, metrics, routing
from fieldspan.plans.common import Register, load

register = Register()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("nano", metrics.nano(F.col("value")))


@register("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_pct(spark, sf_dir):
    found = evaluate.latency(load(spark, sf_dir, "events"), "event_type", "value")
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "n")


@register(f"""
WITH d AS (SELECT value, user_id, CAST((event_id % 4294967296 * 2654435761::HUGEINT + r * 40503 + 42) % 4294967296 AS UBIGINT) AS h, r FROM events, range(200) t(r)),
a AS (SELECT *, CAST(CAST(xor(h, h >> 15) AS HUGEINT) * 2246822519 % 4294967296 AS UBIGINT) AS i FROM d), b AS (SELECT *, CAST(CAST(xor(i, i >> 13) AS HUGEINT) * 3266489917 % 4294967296 AS UBIGINT) AS j FROM a),
u AS (SELECT value, user_id, r, xor(j, j >> 16) / 4294967296.0 AS u FROM b), c AS (SELECT *, len(list_filter({list(evaluate.POISSON)}, lambda p: p < u)) AS n FROM u),
m AS (SELECT r, sum(n * value * user_id) / sum(n * user_id) AS mean FROM c GROUP BY r)
SELECT (SELECT round(sum(value * user_id) / sum(user_id), 4) FROM events) AS mean, round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high FROM m""")
def bootstrap_mean(spark, sf_dir):
    found = evaluate.poisson_bootstrap(load(spark, sf_dir, "events"), "event_id", "value", "user_id")
    return found.select(F.round("mean", 4).alias("mean"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register("""
WITH o AS (SELECT *, row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () AS total FROM events),
b AS (SELECT *, (place - 1) // CAST(ceil(total / 60) AS BIGINT) + 1 AS bucket FROM o)
SELECT bucket, min(place) AS first, max(place) AS last, count(*) AS size, round(avg(value), 6) AS mean_value,
  CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors FROM b GROUP BY bucket""")
def learning_curve(spark, sf_dir):
    measures = {"mean_value": F.round(F.avg("value"), 6), "errors": F.count_if(F.col("event_type") == "error")}
    return metrics.learning_curve(load(spark, sf_dir, "events"), "event_id", measures)


@register("""
WITH o AS (SELECT value, row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () AS total FROM events),
t AS (SELECT avg(value) FILTER (place <= greatest(1, total // 10)) AS f, avg(value) FILTER (place > total - greatest(1, total // 10)) AS l FROM o)
SELECT round(f, 6) AS first_tenth, round(l, 6) AS last_tenth, round(l / f - 1, 6) AS change FROM t""")
def summary_tiles(spark, sf_dir):
    found = metrics.tenths(load(spark, sf_dir, "events"), "event_id", "value")
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns])


@register("""
WITH p AS (SELECT row_number() OVER (ORDER BY event_id) AS place, count(*) OVER () AS total, event_id * 3 AS documents, event_id % 4 AS size, event_id // 7 AS generators, event_type AS wave, value AS cost, CASE WHEN event_id % 500 < 200 THEN value / 2 END AS learning, CASE WHEN event_id % 3 = 0 THEN user_id / 1000.0 END AS accuracy FROM events),
b AS (SELECT *, (place - 1) // CAST(ceil(total / 60) AS BIGINT) + 1 AS bucket FROM p)
SELECT bucket, max_by(documents, place) AS documents, CAST(sum(size) AS BIGINT) AS size, max_by(generators, place) AS generators, string_agg(DISTINCT wave, ',' ORDER BY wave) AS waves, round(sum(cost * size) / sum(size), 6) AS cost,
  CASE WHEN count(learning) > 0 THEN round(sum(coalesce(learning, 0) * size) / sum(size), 6) END AS learning, round(sum(accuracy * size) / nullif(sum(size) FILTER (accuracy IS NOT NULL), 0), 6) AS accuracy FROM b GROUP BY bucket""")
def merged_points(spark, sf_dir):
    at = F.col("event_id")
    points = load(spark, sf_dir, "events").select(
        at, (at * 3).alias("documents"), (at % 4).alias("size"), F.floor(at / 7).alias("generators"), F.col("event_type").alias("wave"), F.col("value").alias("cost"),
        F.when(at % 500 < 200, F.col("value") / 2).alias("learning"), F.when(at % 3 == 0, F.col("user_id") / 1000).alias("accuracy"),
    )
    found = metrics.merged_points(points, "event_id", ["cost"], ["learning"], ["accuracy"])
    return found.withColumns({c: F.round(c, 6) for c in ("cost", "learning", "accuracy")})


_STATS = """
WITH d AS (SELECT DISTINCT o_custkey AS doc, CASE WHEN o_custkey % 6 = 0 THEN 'failed' ELSE 'ok' END AS status, o_custkey % 2 = 0 AS twice FROM orders),
v AS (SELECT o_custkey AS doc, CASE WHEN o_orderkey % 2 = 0 THEN 'A.' ELSE 'B.' END || o_orderstatus AS field, CASE WHEN o_orderkey % 5 = 0 THEN 'generated' ELSE 'selected' END AS method, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 10 / 10.0 END AS confidence FROM orders)
"""


def _field_values(spark, sf_dir):
    key = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders")
    field = F.concat(F.when(key % 2 == 0, "A.").otherwise("B."), F.col("o_orderstatus"))
    return orders.select(F.col("o_custkey").alias("doc"), field.alias("field"), F.when(key % 5 == 0, "generated").otherwise("selected").alias("method"), F.when(key % 3 != 0, key % 10 / 10).alias("confidence"))


@register(_STATS + """, k AS (SELECT v.* FROM v JOIN d USING (doc) WHERE status = 'ok' AND (twice OR starts_with(field, 'A.'))),
n AS (SELECT (SELECT count(*) FROM d WHERE status = 'ok') AS a, (SELECT count(*) FROM d WHERE status = 'ok' AND twice) AS b)
SELECT field, CASE WHEN starts_with(field, 'A.') THEN a ELSE b END AS documents, count(DISTINCT doc) AS found, count(*) AS "values", count(*) FILTER (method = 'generated') AS generated, round(avg(confidence), 9) AS mean_confidence FROM k, n GROUP BY field, a, b
UNION ALL SELECT 'A.never', a, 0, 0, 0, NULL FROM n""")
def field_windows(spark, sf_dir):
    doc = F.col("o_custkey")
    schemas = F.when(doc % 2 == 0, F.array(F.lit("A"), F.lit("B"))).otherwise(F.array(F.lit("A")))
    documents = load(spark, sf_dir, "orders").select(doc).distinct().select(doc.alias("doc"), F.when(doc % 6 == 0, "failed").otherwise("ok").alias("status"), schemas.alias("schemas"))
    found = metrics.field_windows(documents, _field_values(spark, sf_dir), spark.createDataFrame([("A.never",), ("A.O",)], "field string"))
    return found.withColumn("mean_confidence", F.round("mean_confidence", 9))


@register(_STATS + """SELECT field, count(*) AS records, count(confidence) AS found, round(1 - count(confidence) / count(*), 9) AS none_rate, round(count(*) FILTER (method = 'generated') / count(confidence), 9) AS fallback_rate, round(avg(confidence), 9) AS mean_confidence FROM v GROUP BY 1""")
def field_drift(spark, sf_dir):
    found = metrics.field_drift(_field_values(spark, sf_dir).withColumn("found", F.col("confidence").isNotNull()))
    return found.withColumns({c: F.round(c, 9) for c in ("none_rate", "fallback_rate", "mean_confidence")})


@register("SELECT event_type AS method, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM events GROUP BY 1")
def method_mix(spark, sf_dir):
    found = metrics.method_shares(load(spark, sf_dir, "events").withColumnRenamed("event_type", "method"), "method")
    return found.select("method", "n", F.round("share", 9).alias("share"))


@register("""
SELECT event_id, user_id, CAST(sum(CAST(round(CAST(value AS DECIMAL(28,9)) * 1000000000) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS running_nano FROM events""")
def running_spend(spark, sf_dir):
    return metrics.running_spend(events(spark, sf_dir), "user_id", ["ts", "event_id"]).select("event_id", "user_id", "running_nano")


@register("""
WITH p AS (SELECT date_trunc('week', ts) AS period, CAST(sum(CAST(round(CAST(value AS DECIMAL(28,9)) * 1000000000) AS BIGINT)) AS BIGINT) AS nano FROM events GROUP BY 1)
SELECT CAST(period AS VARCHAR) AS period, nano, CAST(greatest(30000000000000 - nano, 0) AS BIGINT) AS left_nano FROM p""")
def period_budget(spark, sf_dir):
    found = budgets.headroom(budgets.spent(events(spark, sf_dir), "week"), 30_000_000_000_000)
    return found.select(F.date_format("period", "yyyy-MM-dd HH:mm:ss").alias("period"), "nano", "left_nano")


@register("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS calls FROM events""")
def rate_limit(spark, sf_dir):
    return budgets.calls_in_window(load(spark, sf_dir, "events"), "user_id").select("event_id", "calls")


@register("""
SELECT event_id, row_number() OVER w <= 10 AND sum(CAST(round(CAST(value AS DECIMAL(28,9)) * 1000000000) AS BIGINT)) OVER w <= 200000000000 AS admitted
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def doc_budget(spark, sf_dir):
    return budgets.document_caps(events(spark, sf_dir), "user_id", ["ts", "event_id"], 10, 200_000_000_000).select("event_id", "admitted")


@register("SELECT event_id, row_number() OVER (PARTITION BY date_trunc('day', ts) ORDER BY ts, event_id) <= 50 AS admitted FROM events")
def try_spend(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumn("day", budgets.period_start("day", F.col("ts")))
    return budgets.try_spend(rows, "day", 50).select("event_id", "admitted")


@register("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_type, count(*) AS n, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END), 9) AS none_rate,
  round(avg(CASE WHEN user_id % 7 = 0 THEN 1.0 ELSE 0.0 END), 9) AS fallback_rate, round(avg(CASE WHEN value >= 5 THEN value END), 6) AS mean_confidence
FROM l WHERE rn <= 200 GROUP BY 1""")
def drift_window(spark, sf_dir):
    rows = load(spark, sf_dir, "events").withColumns({"confidence": F.when(F.col("value") >= 5, F.col("value")), "fallback": F.col("user_id") % 7 == 0})
    found = metrics.drift(rows, "event_type", [F.desc("ts"), F.desc("event_id")])
    return found.select("event_type", "n", F.round("none_rate", 9).alias("none_rate"), F.round("fallback_rate", 9).alias("fallback_rate"), F.round("mean_confidence", 6).alias("mean_confidence"))


@register("""
WITH v AS (SELECT event_type AS field, event_id AS id, CASE WHEN value >= 5 THEN value END AS confidence FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY confidence, id) AS rn FROM v WHERE confidence IS NOT NULL)
SELECT v.field, count(confidence) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN confidence IS NULL THEN 1.0 ELSE 0.0 END), 9) AS none_rate,
  (SELECT string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) FROM r WHERE r.field = v.field AND rn <= 3) AS lowest
FROM v GROUP BY v.field""")
def field_stats(spark, sf_dir):
    values = load(spark, sf_dir, "events").select(F.col("event_type").alias("field"), F.col("event_id").alias("id"), F.when(F.col("value") >= 5, F.col("value")).alias("confidence"))
    found = metrics.field_stats(values)
    return found.select("field", "n", F.round("mean_confidence", 6).alias("mean_confidence"), F.round("none_rate", 9).alias("none_rate"), "lowest")


@register("""
WITH d AS (SELECT o_orderdate AS t, count(*) AS n FROM orders GROUP BY 1), a AS (SELECT DISTINCT l_shipdate AS t FROM lineitem)
SELECT CAST(a.t AS VARCHAR) AS shipped, CAST(coalesce((SELECT sum(n) FROM d WHERE d.t <= a.t), 0) AS BIGINT) AS processed FROM a""")
def processed_by(spark, sf_dir):
    asked = load(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("when")).distinct()
    found = metrics.processed_by(asked, load(spark, sf_dir, "orders"), "when", "o_orderdate")
    return found.select(F.date_format("when", "yyyy-MM-dd HH:mm:ss").alias("shipped"), "processed")


@register("""
WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, event_type, before FROM w WHERE before IS NULL OR before <> event_type""")
def wave_starts(spark, sf_dir):
    return metrics.change_points(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type")


@register("SELECT event_type AS wave, min(event_id) AS first_seen FROM events GROUP BY 1")
def first_waves(spark, sf_dir):
    return metrics.first_waves(load(spark, sf_dir, "events").withColumnRenamed("event_type", "wave"), "event_id", "wave")


@register("""
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id FROM l WHERE rn <= 3""")
def newest_documents(spark, sf_dir):
    return metrics.last_rows(load(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id")


def _generator_stats(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("documents"), F.count_if(F.col("l_quantity") > 25).alias("hits"), F.count_if(F.col("l_returnflag") == "R").alias("wins"), F.count_if(F.col("l_discount") >= 0.1).alias("failures")
    )
    return lines.withColumnRenamed("l_partkey", "id")


@register("""
WITH s AS (SELECT l_partkey AS id, count(*) AS documents, count(*) FILTER (l_quantity > 25) AS hits, count(*) FILTER (l_returnflag = 'R') AS wins, count(*) FILTER (l_discount >= 0.1) AS failures FROM lineitem GROUP BY 1)
SELECT id, documents, hits, wins, failures, round(hits / documents, 9) AS hit_rate, round(wins / documents, 9) AS win_rate,
  CASE WHEN failures >= 5 THEN 'quarantine' WHEN documents >= 20 AND wins = 0 THEN 'prune' ELSE 'keep' END AS verdict FROM s""")
def housekeeping(spark, sf_dir):
    found = learned.housekeeping(_generator_stats(spark, sf_dir), prune_after=20, quarantine_after=5)
    return found.withColumns({c: F.round(c, 9) for c in ("hit_rate", "win_rate")})


@register("""
WITH s AS (SELECT l_partkey AS id, count(*) AS documents, count(*) FILTER (l_quantity > 25) AS hits, count(*) FILTER (l_returnflag = 'R') AS wins, count(*) FILTER (l_discount >= 0.1) AS failures FROM lineitem GROUP BY 1)
SELECT id, CAST(2 * documents AS BIGINT) AS documents, CAST(2 * hits AS BIGINT) AS hits, CAST(2 * wins AS BIGINT) AS wins, CAST(2 * failures AS BIGINT) AS failures FROM s""")
def upsert_counts(spark, sf_dir):
    stats = _generator_stats(spark, sf_dir)
    return learned.add_counts(stats, stats)


@register("""
WITH c AS (SELECT DISTINCT p_size AS id, p_brand || '|' || p_type AS item FROM part WHERE p_size <= 50),
m AS (SELECT p_size AS id, p_brand AS item FROM part UNION SELECT p_size + 100, p_brand FROM part),
s AS (SELECT id, string_agg(item, ',' ORDER BY item) AS shape FROM (SELECT DISTINCT id, item FROM m) GROUP BY id),
k AS (SELECT id, first_value(id) OVER (PARTITION BY shape ORDER BY id % 5 DESC, id) AS kept FROM s)
SELECT id, kept FROM k WHERE id <> kept""")
def duplicate_generators(spark, sf_dir):
    part = load(spark, sf_dir, "part")
    both = part.select(F.col("p_size").alias("id"), F.col("p_brand").alias("value")).union(part.select(F.col("p_size") + 100, "p_brand")).withColumn("example", F.lit(1))
    stats = both.select("id").distinct().select("id", (F.col("id") % 5).alias("wins"), F.col("id").alias("created"))
    return learned.duplicates(both, stats)


@register("""
WITH r AS (SELECT s_nationkey AS id, 1 AS layer, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT c_nationkey, 2, c_name FROM customer),
f AS (SELECT id, min(layer) AS layer, min(name) FILTER (layer = m) AS name FROM (SELECT *, min(layer) OVER (PARTITION BY id) AS m FROM r) GROUP BY id),
d AS (SELECT n_nationkey AS id, 1 AS off_at FROM nation WHERE n_regionkey = 1)
SELECT f.id, f.layer, f.name FROM f LEFT JOIN d USING (id) WHERE off_at IS NULL OR off_at >= f.layer""")
def layered_generators(spark, sf_dir):
    first = load(spark, sf_dir, "supplier").filter("s_suppkey % 2 = 0").groupBy(F.col("s_nationkey").alias("id")).agg(F.min("s_name").alias("name")).select("id", F.lit(1).alias("layer"), "name")
    second = load(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("name")).select(F.col("c_nationkey").alias("id"), F.lit(2).alias("layer"), "name")
    disables = load(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("id"), F.lit(1).alias("layer"))
    return learned.layered(first.union(second), disables)


@register("""
WITH a AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 10 <> 0),
b AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 7 <> 0)
SELECT s_suppkey, CASE WHEN a.s_nationkey IS NULL THEN 'added' WHEN b.s_nationkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b USING (s_suppkey) WHERE a.s_nationkey IS DISTINCT FROM b.s_nationkey OR a.s_acctbal IS DISTINCT FROM b.s_acctbal""")
def pack_diff(spark, sf_dir):
    supplier = load(spark, sf_dir, "supplier")
    old = supplier.filter("s_suppkey % 10 <> 0")
    new = supplier.filter("s_suppkey % 7 <> 0").withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")))
    return learned.diff(old, new, "s_suppkey", ["s_nationkey", "s_acctbal"])


@register("""
WITH l AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 11 <> 0),
n AS (SELECT doc_id, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 13 <> 0)
SELECT doc_id, CASE WHEN l.digest IS NULL THEN 'extra' WHEN n.digest IS NULL THEN 'missing' ELSE 'changed' END AS state
FROM l FULL JOIN n USING (doc_id) WHERE l.digest IS DISTINCT FROM n.digest""")
def corpus_lock(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    locked = learned.lock(docs.filter("doc_id % 11 <> 0"), "doc_id", F.col("text"))
    now = docs.filter("doc_id % 13 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return learned.check_lock(locked, learned.lock(now, "doc_id", F.col("text")), "doc_id")


@register("""
WITH a AS (SELECT doc_id AS k, sha256(text) AS d FROM documents WHERE text IS NOT NULL),
b AS (SELECT k // 4096 AS k, sha256(string_agg(d, chr(10) ORDER BY k, d)) AS d FROM a GROUP BY k // 4096),
c AS (SELECT k // 4096 AS k, sha256(string_agg(d, chr(10) ORDER BY k, d)) AS d FROM b GROUP BY k // 4096)
SELECT sha256(string_agg(d, chr(10) ORDER BY k, d)) AS digest FROM c""")
def corpus_digest(spark, sf_dir):
    parts = load(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"))
    return learned.digest_tree(parts, "doc_id", "digest")


@register("""
SELECT 'rv-' || substr(sha256(CAST(event_id AS VARCHAR) || chr(0) || event_type), 1, 12) AS id, event_id, value AS confidence FROM events WHERE value < 8""")
def review_items(spark, sf_dir):
    rows = load(spark, sf_dir, "events").filter(F.col("value") < 8)
    return rows.select(text.short_id("rv-", F.col("event_id"), F.col("event_type")).alias("id"), "event_id", F.col("value").alias("confidence"))


@register("""
WITH e AS (SELECT user_id AS doc, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors, CAST(count(*) FILTER (event_type = 'purchase') AS BIGINT) AS found FROM events GROUP BY 1)
SELECT doc, errors, found, CASE WHEN errors = 0 THEN 'ok' WHEN found = 0 THEN 'failed' ELSE 'partial' END AS status FROM e""")
def error_status(spark, sf_dir):
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("found"))
    return rows.withColumn("status", routing.status(F.col("found"), F.col("errors")))


@register("""
SELECT user_id AS doc, event_type AS stage, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS kind, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL""")
def part_errors(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.col("event_type").alias("stage"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("kind"), F.col("event_id").alias("ord"))
    return routing.part_errors(rows)


SCORES = """
WITH v AS (SELECT 'quality' AS field, CAST(l.quality AS VARCHAR) AS expected, CASE WHEN d.n_chars > 2000 THEN '1' WHEN d.n_chars > 100 THEN '0' END AS actual FROM labels l JOIN documents d USING (doc_id)
  UNION ALL SELECT 'toxic', CAST(l.toxic AS VARCHAR), CASE WHEN contains(lower(d.text), 'idiot') OR contains(lower(d.text), 'stupid') THEN '1.0' ELSE '0' END FROM labels l JOIN documents d USING (doc_id)),
o AS (SELECT field, CASE WHEN expected IS NULL AND actual IS NULL THEN 'empty' WHEN actual IS NULL THEN 'missing' WHEN expected IS NULL THEN 'spurious' WHEN CAST(expected AS DOUBLE) = CAST(actual AS DOUBLE) THEN 'correct' ELSE 'wrong' END AS outcome FROM v),
c AS (SELECT field, count(*) FILTER (outcome = 'correct') AS correct, count(*) FILTER (outcome = 'wrong') AS wrong, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome = 'spurious') AS spurious, count(*) FILTER (outcome = 'empty') AS empty FROM o GROUP BY ROLLUP (field)),
s AS (SELECT *, round(correct / nullif(correct + wrong + spurious, 0), 9) AS precision, round(correct / nullif(correct + wrong + missing, 0), 9) AS recall, round(correct / nullif(correct + wrong + missing + spurious, 0), 9) AS accuracy FROM c)
"""


def _scores(spark, sf_dir):
    both = load(spark, sf_dir, "labels").join(load(spark, sf_dir, "documents"), "doc_id")
    chars, lower = F.col("n_chars"), F.lower("text")
    pairs = both.select(
        F.explode(
            F.array(
                F.struct(F.lit("quality").alias("field"), F.col("quality").cast("string").alias("expected"), F.when(chars > 2000, "1").when(chars > 100, "0").alias("actual")),
                F.struct(F.lit("toxic").alias("field"), F.col("toxic").cast("string").alias("expected"), F.when(F.contains(lower, F.lit("idiot")) | F.contains(lower, F.lit("stupid")), "1.0").otherwise("0").alias("actual")),
            )
        ).alias("p")
    ).select("p.*")
    match = evaluate.values_match(F.col("expected"), F.col("actual"))
    found = evaluate.field_scores(pairs.withColumn("outcome", evaluate.outcome(F.col("expected"), F.col("actual"), match)))
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "accuracy")})


@register(SCORES + "SELECT * FROM s")
def score_fields(spark, sf_dir):
    return _scores(spark, sf_dir)


@register(SCORES + """
SELECT b.field, b.accuracy AS was, s.accuracy AS now, coalesce(s.accuracy, 0) >= b.accuracy - CASE WHEN b.field IS NULL THEN 0.02 ELSE 0.05 END - 1e-9 AS passed
FROM (VALUES ('quality', 0.5), ('toxic', 0.99), (NULL, 0.7)) b(field, accuracy) LEFT JOIN s ON s.field IS NOT DISTINCT FROM b.field""")
def regression_gate(spark, sf_dir):
    baseline = spark.createDataFrame([("quality", 0.5), ("toxic", 0.99), (None, 0.7)], "field string, accuracy double")
    return evaluate.check_baseline(_scores(spark, sf_dir), baseline)


@register("""
WITH g AS (SELECT o_orderkey AS doc, l_linenumber AS expected_at, l_linenumber AS found_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT DISTINCT doc, CAST(expected_at AS BIGINT) AS expected_at, CAST(found_at AS BIGINT) AS found_at, CAST(2 AS BIGINT) AS agreement FROM g""")
def match_records(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("at")).distinct()
    other = lines.withColumnRenamed("at", "found_at")
    same = F.col("expected_at") == F.col("found_at")
    pairs = lines.withColumnRenamed("at", "expected_at").join(other, "doc").select("doc", "expected_at", "found_at", F.when(same, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("agreement"), same.cast("int").alias("same_label"))
    return evaluate.match_records(pairs)


@register("""
WITH a AS (SELECT o_custkey AS c, list(o_orderpriority ORDER BY o_orderkey) AS x, list(o_orderstatus ORDER BY o_orderkey) AS y FROM orders GROUP BY 1),
l AS (SELECT c, x, [CASE WHEN s = 'O' THEN x[1] ELSE x[-1] END FOR s IN y] AS z FROM a),
m AS (SELECT c, len(x) AS n, len(z) AS k, list_sum([least(len([1 FOR q IN x IF q = v]), len([1 FOR q IN z IF q = v])) FOR v IN list_distinct(x)]) AS correct FROM l)
SELECT c AS custkey, CAST(correct AS INTEGER) AS correct, CAST(n - correct AS INTEGER) AS missing, CAST(k - correct AS INTEGER) AS spurious FROM m""")
def list_scores(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", "o_orderstatus")))
    lists = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(ordered.alias("o"))
    x = F.transform("o", lambda s: s["o_orderpriority"])
    z = F.transform("o", lambda s: F.when(s["o_orderstatus"] == "O", F.get("o", F.lit(0))["o_orderpriority"]).otherwise(F.element_at("o", -1)["o_orderpriority"]))
    return lists.select("custkey", evaluate.list_scores(x, z).alias("s")).select("custkey", "s.*")


@register("""
WITH p AS (SELECT doc_id AS statement, lang AS field, 1 AS ord, n_chars % 100 / 100.0 AS p FROM documents UNION ALL SELECT doc_id, source, 2, (100 - n_chars % 100) / 200.0 FROM documents UNION ALL SELECT doc_id, 'none', 3, 0.3 FROM documents),
t AS (SELECT statement, arg_max(field, p * 10 - ord / 1000.0) AS top FROM p GROUP BY 1)
SELECT p.statement, p.field, round(p.p, 4) AS p, p.field = t.top AS "primary" FROM p JOIN t USING (statement) WHERE top <> 'none' AND field <> 'none' AND (field = top OR p.p >= 0.1)""")
def route_statements(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    r = F.col("n_chars") % 100
    options = F.array(*[F.struct(f.alias("field"), F.lit(o).alias("ord"), p.alias("p")) for o, (f, p) in enumerate([(F.col("lang"), r / 100), (F.col("source"), (100 - r) / 200), (F.lit("none"), F.lit(0.3))], 1)])
    answers = docs.select(F.col("doc_id").alias("statement"), F.explode(options).alias("a")).select("statement", "a.*")
    return routing.route(answers).withColumn("p", F.round("p", 4))


@register("""
WITH c AS (SELECT l_orderkey AS statement, l_returnflag AS field, CAST(l_partkey AS VARCHAR) AS raw, l_linenumber AS start, l_discount AS p FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY statement, field ORDER BY p DESC, start, raw DESC) AS rn FROM c)
SELECT r.statement, r.field, r.raw, r.p AS confidence, (SELECT count(DISTINCT raw) FROM c WHERE c.statement = r.statement AND c.field = r.field) AS options FROM r WHERE rn = 1""")
def select_best(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    return routing.select_best(lines.select(F.col("l_orderkey").alias("statement"), F.col("l_returnflag").alias("field"), F.col("l_partkey").cast("string").alias("raw"), F.col("l_linenumber").alias("start"), F.col("l_discount").alias("p")))


@register("""
WITH r AS (SELECT user_id AS scope, event_type AS field, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS value, value AS confidence, event_id % 2 AS shared, event_id AS ord FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY scope, field ORDER BY shared, confidence DESC, ord) AS rn, count(*) OVER (PARTITION BY scope, field) AS n FROM r)
SELECT scope, field, value, confidence, (SELECT count(DISTINCT value) - 1 FROM r WHERE r.scope = k.scope AND r.field = k.field) AS conflicts FROM k WHERE rn = 1""")
def settle_values(spark, sf_dir):
    rows = load(spark, sf_dir, "events").select(F.col("user_id").alias("scope"), F.col("event_type").alias("field"), F.get_json_object("props", "$.k").alias("value"), F.col("value").alias("confidence"), (F.col("event_id") % 2).alias("shared"), F.col("event_id").alias("ord"))
    return routing.settle(rows)


@register("""
WITH a AS (SELECT c_custkey AS scope, c_mktsegment AS value, 0.5 AS confidence, c_custkey % 2 AS shared FROM customer WHERE c_custkey % 3 <> 0),
b AS (SELECT c_custkey AS scope, upper(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE 'X' END AS value, c_custkey % 10 / 10.0 AS confidence, c_custkey % 5 % 2 AS shared FROM customer WHERE c_custkey % 7 <> 0),
j AS (SELECT coalesce(a.scope, b.scope) AS scope, a.scope IS NULL OR (b.scope IS NOT NULL AND (a.shared > b.shared OR (a.shared = b.shared AND b.confidence > a.confidence))) AS later, a.value AS av, b.value AS bv, a.confidence AS ac, b.confidence AS bc FROM a FULL JOIN b ON a.scope = b.scope)
SELECT scope, 'segment' AS field, CASE WHEN later THEN 'second' ELSE 'first' END AS route, CASE WHEN later THEN bv ELSE av END AS value, CAST(CASE WHEN later THEN bc ELSE ac END AS DOUBLE) AS confidence,
  CASE WHEN av <> bv THEN CASE WHEN later THEN av ELSE bv END END AS conflict FROM j""")
def merge_routes(spark, sf_dir):
    customer, key = load(spark, sf_dir, "customer"), F.col("c_custkey")
    first = customer.filter("c_custkey % 3 <> 0").select(key.alias("scope"), F.lit("segment").alias("field"), F.col("c_mktsegment").alias("value"), F.lit(0.5).alias("confidence"), (key % 2).alias("shared"))
    upper = F.concat(F.upper("c_mktsegment"), F.when(key % 4 == 0, "").otherwise("X"))
    second = customer.filter("c_custkey % 7 <> 0").select(key.alias("scope"), F.lit("segment").alias("field"), upper.alias("value"), (key % 10 / 10).alias("confidence"), (key % 5 % 2).alias("shared"))
    return routing.merge_routes(first, second, certain=True)


@register("""
WITH v AS (SELECT user_id AS scope, event_type AS field, arg_max(CAST(json_extract_string(props, '$.k') AS VARCHAR), event_id) AS value, arg_max(value, event_id) AS confidence FROM events GROUP BY 1, 2)
SELECT scope, max(value) FILTER (field = 'view' AND confidence >= 5) AS view, max(value) FILTER (field = 'click' AND confidence >= 5) AS click, max(value) FILTER (field = 'error' AND confidence >= 5) AS error,
  count(value) FILTER (confidence >= 5 AND field IN ('view', 'click', 'error')) = 3 AS complete FROM v GROUP BY scope""")
def records_pivot(spark, sf_dir):
    last = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("scope"), F.col("event_type").alias("field")).agg(F.max_by(F.get_json_object("props", "$.k"), "event_id").alias("value"), F.max_by("value", "event_id").alias("confidence"))
    return routing.records(last, ["view", "click", "error"], threshold=5.0)


@register("""
WITH v AS (SELECT DISTINCT user_id % 5 AS doc, user_id AS entity, event_type AS field FROM events WHERE event_id % 240 = 0 OR user_id % 9 <> 0),
c AS (SELECT doc, entity, count(*) AS n_fields FROM v GROUP BY 1, 2), g AS (SELECT doc, count(*) AS giving, quantile_cont(n_fields, 0.5) AS med FROM c GROUP BY 1),
u AS (SELECT doc, count(*) AS usual FROM (SELECT v.doc, field, count(*) AS e, any_value(giving) AS giving FROM v JOIN g USING (doc) GROUP BY 1, 2) WHERE e * 2 > giving GROUP BY 1)
SELECT c.doc, c.entity, c.n_fields FROM c JOIN g USING (doc) LEFT JOIN u USING (doc) WHERE giving >= 3 AND n_fields < 0.5 * coalesce(usual, 0) AND n_fields < med""")
def unlike_rest(spark, sf_dir):
    rows = load(spark, sf_dir, "events").filter("event_id % 240 = 0 OR user_id % 9 <> 0")
    return routing.unlike_rest(rows.select((F.col("user_id") % 5).alias("doc"), F.col("user_id").alias("entity"), F.col("event_type").alias("field")))


@register("""
SELECT l.l_orderkey, l.l_linenumber, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END, o_orderstatus) AS status, l_linenumber % 2 <> 0 AND o_orderstatus IS NOT NULL AS status_shared
FROM lineitem l LEFT JOIN orders ON l_orderkey = o_orderkey""")
def parent_child(spark, sf_dir):
    children = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("status"))
    parents = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("status"))
    return routing.inherit(children, parents, "l_orderkey", ["status"])
