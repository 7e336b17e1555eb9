"""Queries over values read from text. Most are round trips: a text is built from a column and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspan.functions import locales, quantities, text, units
from fieldspan.plans.common import Register, load

register = Register()


@register("SELECT page_id, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS source FROM pages")
def doc_source(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.source(F.lit(None).cast("string"), F.col("url")).alias("source"))


@register("SELECT page_id, regexp_extract(lower(url), '^([a-z]+://[^/?#]+)', 1) AS origin FROM pages")
def url_origin(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", text.origin(F.col("url")).alias("origin"))


@register("""
SELECT page_id, 'text/html' AS own, CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' END AS made FROM pages""")
def sniff_type(spark, sf_dir):
    k = F.col("page_id") % 4
    made = F.when(k == 0, F.lit("%PDF-1.7").cast("binary")).when(k == 1, F.unhex(F.lit("89504E470D0A1A0A00"))).when(k == 2, F.unhex(F.lit("FFD8FFE0"))).otherwise(F.lit("plain words").cast("binary"))
    return load(spark, sf_dir, "pages").select("page_id", text.sniff_content_type(F.col("html").cast("binary")).alias("own"), text.sniff_content_type(made).alias("made"))


@register("""
SELECT nation.n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'de-DE' WHEN 1 THEN 'zh-Hant-TW' ELSE 'en' END AS locale,
  CASE n_nationkey % 3 WHEN 0 THEN ',' ELSE '.' END AS decimal, CASE n_nationkey % 3 WHEN 1 THEN 'ymd' ELSE 'dmy' END AS date_order FROM nation""")
def canonical_locale(spark, sf_dir):
    k = F.col("n_nationkey") % 3
    tag = F.when(k == 0, "de_de").when(k == 1, "ZH-hant-tw").otherwise(" EN ")
    found = load(spark, sf_dir, "nation").select("n_nationkey", locales.canonical_locale(tag).alias("locale"))
    return found.select("*", locales.convention(F.col("locale"), "decimal").alias("decimal"), locales.convention(F.col("locale"), "date_order").alias("date_order"))


@register("""
WITH s AS (SELECT * FROM (VALUES ('any', []), ('en', ['en']), ('en-GB', ['en-GB']), ('de', ['de', 'fr'])) t(scope, tags))
SELECT doc_id, scope FROM documents, s WHERE len(tags) = 0 OR (doc_id % 10 <> 0 AND list_contains(tags, lang))""")
def scope_join(spark, sf_dir):
    scopes = spark.createDataFrame([("any", []), ("en", ["en"]), ("en-GB", ["en-GB"]), ("de", ["de", "fr"])], "scope string, tags array<string>")
    locale = F.when(F.col("doc_id") % 10 != 0, F.concat("lang", F.lit("-XX")))
    docs = load(spark, sf_dir, "documents").select("doc_id", locale.alias("locale"))
    return docs.join(F.broadcast(scopes), locales.scope_matches(F.col("tags"), F.col("locale"))).select("doc_id", "scope")


@register("""
WITH m AS (SELECT p_partkey, p_partkey % 3 AS k, CAST(round(p_retailprice, 2) AS DECIMAL(20,2)) AS price, CAST(floor(p_retailprice) AS BIGINT) AS thousands FROM part)
SELECT p_partkey, CAST(CASE WHEN k = 1 THEN thousands * 1000 ELSE price END AS DOUBLE) AS amount, CASE k WHEN 0 THEN 'GBP' WHEN 1 THEN 'USD' ELSE 'EUR' END AS currency FROM m""")
def money_roundtrip(spark, sf_dir):
    k, price = F.col("p_partkey") % 3, F.col("p_retailprice")
    written = F.when(k == 0, F.concat(F.lit("Now only £"), F.format_number(price, 2), F.lit(" a piece"))).when(k == 1, F.concat(F.lit("about $"), F.floor(price).cast("string"), F.lit("k"))).otherwise(F.concat(F.format_string("%.2f", price), F.lit(" EUR")))
    found = load(spark, sf_dir, "part").select("p_partkey", quantities.parse_money(written).alias("m"))
    return found.select("p_partkey", F.col("m.amount").cast("double").alias("amount"), F.col("m.currency").alias("currency"))


@register("SELECT p_partkey, CAST(round(p_retailprice, 2) AS DOUBLE) AS amount, 'EUR' AS currency FROM part")
def money_de(spark, sf_dir):
    german = F.translate(F.format_number("p_retailprice", 2), ",.", ".,")
    found = load(spark, sf_dir, "part").select("p_partkey", quantities.parse_money(F.concat(F.lit("Preis: "), german, F.lit(" €")), ",").alias("m"))
    return found.select("p_partkey", F.col("m.amount").cast("double").alias("amount"), F.col("m.currency").alias("currency"))


@register("SELECT p_partkey, CAST(p_size AS DOUBLE) AS number, 'mm' AS unit, round(p_size / 10.0, 6) AS cm FROM part")
def number_unit(spark, sf_dir):
    written = F.concat(F.lit("Size is "), F.col("p_size").cast("string"), F.lit(" MM overall"))
    found = load(spark, sf_dir, "part").select("p_partkey", quantities.parse_number(written).alias("number"), units.canonical_unit(F.regexp_extract(written, r"\d+ (\p{L}+)", 1)).alias("unit"))
    return found.withColumn("cm", units.convert(F.col("number"), F.col("unit"), F.lit("cm")))


@register("""
SELECT p_partkey, round(282.480936 / (p_size + 20.0), 6) AS l_uk, round(235.214583 / (p_size + 20.0), 6) AS l_us,
  CAST(round(282.480936 / (p_size + 30.0), 6) AS VARCHAR) || '..' || CAST(round(282.480936 / (p_size + 20.0), 6) AS VARCHAR) AS bounds FROM part""")
def economy_convert(spark, sf_dir):
    mpg, from_, to = F.col("p_size") + 20.0, F.lit("mpg"), F.lit("l/100km")
    bounds = units.convert_range(F.array(mpg, mpg + 10), from_, to)
    return load(spark, sf_dir, "part").select("p_partkey", units.convert(mpg, from_, to).alias("l_uk"), units.convert(mpg, from_, to, "us").alias("l_us"), F.array_join(F.transform(bounds, lambda x: x.cast("string")), "..").alias("bounds"))


@register("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders")
def date_roundtrip(spark, sf_dir):
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    month = lambda lang: F.element_at(F.array(*[F.lit(m) for m in units.MONTHS[lang]]), F.month(day))
    d, y = F.dayofmonth(day).cast("string"), F.year(day).cast("string")
    forms = [
        F.date_format(day, "yyyy-MM-dd"),
        F.date_format(day, "dd/MM/yyyy"),
        F.concat(d, F.lit("th "), F.initcap(month("en")), F.lit(" "), y),
        F.concat(F.initcap(month("en")), F.lit(" "), d, F.lit(", "), y),
        F.concat(d, F.lit(". "), F.initcap(month("de")), F.lit(" "), y),
        F.concat(d, F.lit(" de "), month("es"), F.lit(" de "), y),
    ]
    written = F.concat(F.lit("made on "), F.element_at(F.array(*forms), (key % 6 + 1).cast("int")))
    return load(spark, sf_dir, "orders").select("o_orderkey", F.date_format(quantities.parse_date(written), "yyyy-MM-dd").alias("date"))


@register("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS first, CAST(2 AS INTEGER) AS n FROM orders")
def year_candidates(spark, sf_dir):
    written = F.concat(F.lit("from "), F.year("o_orderdate").cast("string"), F.lit(", part 123456, MY2024."))
    return load(spark, sf_dir, "orders").select("o_orderkey", quantities.years(written).alias("y")).select("o_orderkey", F.get("y", F.lit(0)).alias("first"), F.size("y").alias("n"))


@register("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS DOUBLE) AS low, CAST(l_quantity + 7 AS DOUBLE) AS high FROM lineitem""")
def range_roundtrip(spark, sf_dir):
    low, high = F.col("l_quantity").cast("int").cast("string"), (F.col("l_quantity") + 7).cast("int").cast("string")
    joint = F.element_at(F.array(F.lit("–"), F.lit(" to "), F.lit("-")), F.col("l_linenumber").cast("int") % 3 + 1)
    written = F.concat(F.lit("takes "), low, joint, high, F.lit(" days"))
    found = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", quantities.parse_range(written).alias("r"))
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.get("r", F.lit(0)).alias("low"), F.get("r", F.lit(1)).alias("high"))


@register("""
SELECT n_nationkey, true AS pair, n_name AS value, false AS clock FROM nation
UNION ALL SELECT c_custkey + 1000000, true, c_mktsegment, false FROM customer""")
def kv_statements(spark, sf_dir):
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("v")).union(load(spark, sf_dir, "customer").select(F.col("c_custkey") + 1_000_000, "c_mktsegment"))
    written = F.concat(F.lit("Name of it: "), F.col("v"), F.lit(". "))
    return rows.select("n_nationkey", text.is_key_value(written).alias("pair"), text.value_after_label(written).alias("value"), text.is_key_value(F.concat(F.lit("at 10:"), (F.col("n_nationkey") % 50 + 10).cast("string"))).alias("clock"))


@register("""
SELECT doc_id, CAST(coalesce(list_sum([ceil(length(w) / 7.0) FOR w IN regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')]), 0) + len(regexp_extract_all(coalesce(text, ''), '[^A-Za-z\\s\\x0b]')) AS BIGINT) AS tokens FROM documents""")
def token_estimate(spark, sf_dir):
    """Of every document; a null text is empty."""
    return load(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.coalesce("text", F.lit(""))).cast("long").alias("tokens"))


@register("SELECT doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS folded, rtrim(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' .;,') AS stripped FROM documents")
def strip_text(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"), text.strip(F.col("text")).alias("stripped"))
