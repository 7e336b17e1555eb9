"""Shop pages as ground truth, listings, samples, crawler responses, and the boxes of laid-out pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.functions.text import sniff_content_type, source

STARS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5}


def _inside(markup: Column, pattern: str) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(markup, pattern, 1), "<[^>]*>", "")), F.lit(""))


def book_values(markup: Column) -> Column:
    """struct<title, price, stock, rating> of a product page, by its markup; what isn't there is null."""
    stars = F.create_map(*[F.lit(x) for kv in STARS.items() for x in kv])
    price = F.regexp_extract(markup, r'(?s)class="price[^"]*"[^>]*>[^0-9<]*([0-9]+(?:\.[0-9]+)?)', 1)
    return F.struct(
        _inside(markup, r"(?s)<h1[^>]*>(.*?)</h1>").alias("title"),
        price.try_cast("double").alias("price"),
        F.regexp_extract(markup, r"\(([0-9]+) available\)", 1).try_cast("int").alias("stock"),
        F.element_at(stars, F.lower(F.regexp_extract(markup, r'class="star-rating ([A-Za-z]+)"', 1))).alias("rating"),
    )


def star_ratings(markup: Column) -> Column:
    """The markup with the word of each star rating's class as visible text."""
    return F.regexp_replace(markup, r'(<[a-z]+[^>]*class="star-rating ([A-Za-z]+)"[^>]*>)', "$1$2 stars ")


def absolute(url: Column, base: Column) -> Column:
    """A link of a page: absolute as it is, from the site's root, or from the page's folder; ``../`` is resolved."""
    root = F.regexp_extract(base, r"^([a-z]+://[^/]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")
    joined = F.when(url.rlike("^[a-z]+://"), url).when(F.startswith(url, F.lit("/")), F.concat(root, url)).otherwise(F.concat(folder, url))
    for _ in range(4):
        joined = F.regexp_replace(joined, r"(?<=[^:/])/[^/]+/\.\./", "/")
    return F.regexp_replace(joined, r"(?<=[^:/])/\./", "/")


def catalogue_page(markup: Column, base: Column) -> Column:
    """struct<products array<string>, next string> of a listing page."""
    links = F.regexp_extract_all(markup, F.lit(r'<h3>\s*<a[^>]*href="([^"]+)"'), F.lit(1))
    following = F.nullif(F.regexp_extract(markup, r'class="next">\s*<a[^>]*href="([^"]+)"', 1), F.lit(""))
    return F.struct(F.transform(links, lambda u: absolute(u, base)).alias("products"), absolute(following, base).alias("next"))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of the least seeded hashes, ties by key: a sampling operator, the same for any partitions."""
    return rows.withColumn("__h", F.xxhash64(F.lit(seed), F.col(key))).orderBy("__h", key).limit(n).drop("__h")


def waves(text: str) -> list[list[str]]:
    """`a,b;c` as [[a, b], [c]]; an empty or repeated name is an error."""
    out = [[name.strip() for name in wave.split(",")] for wave in text.split(";")]
    names = [n for wave in out for n in wave]
    if not all(names) or len(set(names)) < len(names):
        raise ValueError("a wave's families have names, each in one wave")
    return out


def wave_numbers(found: list[list[str]]) -> dict[str, int]:
    return {name: i for i, wave in enumerate(found, 1) for name in wave}


def from_responses(responses: DataFrame) -> DataFrame:
    """Documents of crawler responses with a status below 400 and a body: url, content, content_type, source; the type by header, else by content."""
    header = F.lower(F.trim(F.split_part(F.col("headers")["content-type"], F.lit(";"), F.lit(1))))
    kept = responses.filter((F.col("status") < 400) & (F.length("body") > 0))
    return kept.select("url", F.col("body").alias("content"), F.coalesce(F.nullif(header, F.lit("")), sniff_content_type(F.col("body"))).alias("content_type"), source(F.lit(None).cast("string"), F.col("url")).alias("source"))


def top_left(box: Column, height: Column) -> Column:
    """struct<left, top, width, height> of a box struct<l, t, r, b> whose origin is the page's bottom left."""
    return F.struct(F.least(box["l"], box["r"]).alias("left"), (height - F.greatest(box["t"], box["b"])).alias("top"), F.abs(box["r"] - box["l"]).alias("width"), F.abs(box["t"] - box["b"]).alias("height"))


def join_runs(runs: Column) -> Column:
    """Inline runs of text as one: a space between, none before closing marks or behind opening ones."""
    joined = F.array_join(F.filter(F.transform(runs, lambda r: F.trim(r)), lambda r: r != ""), " ")
    return F.regexp_replace(F.regexp_replace(joined, r"\s+([,.;:!?)\]])", "$1"), r"([(\[])\s+", "$1")


def loose_lists(blocks: DataFrame) -> DataFrame:
    """blocks (doc, ord, type, parent) with list: the number of the run of loose items a block is in, null for all others.

    A run is of items without a parent that follow each other.
    """
    loose = (F.col("type") == "list_item") & F.col("parent").isNull()
    order = Window.partitionBy("doc").orderBy("ord")
    starts = (loose & ~F.coalesce(F.lag(loose).over(order), F.lit(False))).cast("long")
    return blocks.withColumn("__s", starts).withColumn("list", F.when(loose, F.sum("__s").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def ticks(top: float) -> list[float]:
    """From 0 to at least ``top`` in four to eight steps of 1, 2, 2.5 or 5 times a power of ten."""
    if not top > 0:
        return [0.0, 1.0]
    scale = 10.0 ** (len(str(int(top))) - 2) if top >= 1 else 10.0 ** -6
    while True:
        for step in (1, 2, 2.5, 5):
            n = -(-top // (step * scale))
            if n <= 6:
                return [round(i * step * scale, 10) for i in range(int(n) + 1)]
        scale *= 10
