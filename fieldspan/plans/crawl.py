"""Queries over shop pages, links, boxes and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldspan.functions import locales, quantities
from fieldspan.operators import html
from fieldspan.plans.common import Register, load
from fieldspan.sources import crawl

register = Register()
_STARS = "['One', 'Two', 'Three', 'Four', 'Five']"


def product(part_key, name, price):
    word = F.element_at(F.array(*map(F.lit, ("One", "Two", "Three", "Four", "Five"))), (part_key % 5 + 1).cast("int"))
    return F.concat(F.lit('<h1> <b>'), name, F.lit('</b></h1><p class="price_color">£'), F.format_string("%.2f", price), F.lit('</p><p class="star-rating '), word, F.lit('"></p><p>In stock ('), part_key.cast("string"), F.when(part_key % 4 == 0, ")").otherwise(" available)"))


@register(f"""
SELECT p_partkey, p_name AS title, CAST(round(p_retailprice, 2) AS DOUBLE) AS price, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_partkey AS INTEGER) END AS stock, CAST(p_partkey % 5 + 1 AS INTEGER) AS rating, {_STARS}[CAST(p_partkey % 5 + 1 AS INTEGER)] || ' stars' AS stars FROM part""")
def book_values(spark, sf_dir):
    made = product(F.col("p_partkey"), F.col("p_name"), F.col("p_retailprice"))
    part = load(spark, sf_dir, "part").select("p_partkey", made.alias("html"))
    stars = F.trim(F.regexp_extract(crawl.star_ratings(F.col("html")), r'star-rating [A-Za-z]+">([^<]*)<', 1))
    return part.select("p_partkey", crawl.book_values(F.col("html")).alias("v"), stars.alias("stars")).select("p_partkey", "v.*", "stars")


@register("""
SELECT s_suppkey, 'https://shop.example/a/' || s_suppkey || '/index.html|https://shop.example/x.html|https://other.example/y' AS products, CASE WHEN s_suppkey % 3 <> 0 THEN 'https://shop.example/a/b/page-' || s_suppkey || '.html' END AS next FROM supplier""")
def catalogue_pages(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    made = F.concat(F.lit('<h3><a class="t" href="../'), key, F.lit('/index.html">A</a></h3><h3><a href="/x.html">B</a></h3><h3> <a href="https://other.example/y">C</a></h3>'), F.when(F.col("s_suppkey") % 3 != 0, F.concat(F.lit('<li class="next"> <a href="page-'), key, F.lit('.html">next</a>'))).otherwise(""))
    found = load(spark, sf_dir, "supplier").select("s_suppkey", crawl.catalogue_page(made, F.lit("https://shop.example/a/b/page-1.html?q=/z")).alias("c"))
    return found.select("s_suppkey", F.array_join("c.products", "|").alias("products"), "c.next")


@register("""
WITH b AS (SELECT c_custkey AS doc, o_orderkey AS ord, CASE WHEN o_orderkey % 4 < 2 THEN 'list_item' ELSE 'paragraph' END AS type, CASE WHEN o_orderkey % 5 = 0 THEN 1 END AS parent FROM orders JOIN customer ON c_custkey = o_custkey),
l AS (SELECT *, type = 'list_item' AND parent IS NULL AS loose FROM b), s AS (SELECT *, CAST(loose AND NOT coalesce(lag(loose) OVER (PARTITION BY doc ORDER BY ord), FALSE) AS INTEGER) AS starts FROM l)
SELECT doc, ord, CASE WHEN loose THEN CAST(sum(starts) OVER (PARTITION BY doc ORDER BY ord) AS BIGINT) END AS list FROM s""")
def loose_lists(spark, sf_dir):
    key = F.col("o_orderkey")
    blocks = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), key.alias("ord"), F.when(key % 4 < 2, "list_item").otherwise("paragraph").alias("type"), F.when(key % 5 == 0, 1).alias("parent"))
    known = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"))
    return crawl.loose_lists(blocks.join(known, "doc", "left_semi")).select("doc", "ord", "list")


@register("""
SELECT l_orderkey, l_linenumber, least(l_linenumber, 3) AS "left", 100 - CAST(l_quantity AS BIGINT) AS top, abs(3 - l_linenumber) AS width, CAST(l_quantity AS BIGINT) AS height, 'Line ' || l_linenumber || ', (a) b.' AS said FROM lineitem""")
def boxes(spark, sf_dir):
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("long")
    box = F.struct(n.alias("l"), q.alias("t"), F.lit(3).alias("r"), F.lit(0).cast("long").alias("b"))
    runs = F.array(F.lit("Line "), n.cast("string"), F.lit(" ,"), F.lit("("), F.lit("a"), F.lit(" ) "), F.lit(""), F.lit("b"), F.lit("."))
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", crawl.top_left(box, F.lit(100)).alias("x"), crawl.join_runs(runs).alias("said")).select("l_orderkey", "l_linenumber", "x.*", "said")


@register("SELECT page_id, '/html/body/article/h1' AS path FROM pages WHERE regexp_matches(html, '<h1[ >]')")
def heading_paths(spark, sf_dir):
    return html.per_page(load(spark, sf_dir, "pages"), "page_id", "html", "path string", lambda page: [(path,) for path, tag in html.paths(html.parse(page)) if tag == "h1"])


@register("""
SELECT n_nationkey, '# ' || n_name || chr(10) || chr(10) || 'Some words.' || chr(10) || chr(10) || '- one' || chr(10) || '- ' || n_nationkey || chr(10) || chr(10) || 'a | ' || n_regionkey || chr(10) || chr(10) || '[Image: map]' AS said FROM nation""")
def rendered(spark, sf_dir):
    made = F.concat(F.lit("<h1>"), F.col("n_name"), F.lit("</h1><p>Some words.</p><ul><li>one</li><li>"), F.col("n_nationkey").cast("string"), F.lit("</li></ul><table><tr><td>a</td><td>"), F.col("n_regionkey").cast("string"), F.lit('</td></tr></table><img src="m.png" alt="map">'))
    return html.per_page(load(spark, sf_dir, "nation").select("n_nationkey", made.alias("html")), "n_nationkey", "html", "said string", lambda page: [(html.render(html.components(html.parse(page))),)])


@register("""
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 5 WHEN event_id % 3 = 1 THEN 3 END AS month, CASE WHEN event_id % 2 = 0 THEN 'en-GB' ELSE 'de' END AS locale FROM events""")
def months_and_locales(spark, sf_dir):
    at = F.col("event_id")
    said = F.when(at % 3 == 0, "from March last until May 2024").when(at % 3 == 1, "März 2020, not mai or juni of a year").otherwise("May of no year")
    tag = F.when(at % 2 == 0, "EN_gb").otherwise("DE")
    return load(spark, sf_dir, "events").select("event_id", quantities.month_nearest_year(said).alias("month"), locales.checked_locale(tag).alias("locale"))


@register("""SELECT event_type, '{"event_type":"' || event_type || '","n":' || count(*) || ',"users":' || count(DISTINCT user_id) || '}' AS json FROM events GROUP BY 1""")
def json_views(spark, sf_dir):
    counted = load(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return counted.select("event_type", F.to_json(F.struct(*counted.columns)).alias("json"))


@register("SELECT page_id, url, 'text/html' AS content_type FROM pages WHERE page_id % 3 <> 0")
def crawler_responses(spark, sf_dir):
    at = F.col("page_id")
    headers = F.when(at % 2 == 0, F.create_map(F.lit("content-type"), F.lit("Text/HTML; charset=utf-8"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    responses = load(spark, sf_dir, "pages").select("page_id", "url", F.when(at % 3 == 0, 404).otherwise(200).alias("status"), headers.alias("headers"), F.col("html").cast("binary").alias("body"))
    found = crawl.from_responses(responses).select("url", "content_type")
    return responses.select("page_id", "url").join(found.distinct(), "url").filter("page_id % 3 <> 0")
