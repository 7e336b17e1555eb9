import pytest
from pyspark.sql import functions as F

from fieldspan.operators import metrics

N = 1_000_000


@pytest.fixture(scope="module")
def many(spark):
    """A million rows out of order, over several partitions and with further columns."""
    key = F.pmod(F.col("id") * 7_368_787 + 11, F.lit(N)).alias("key")
    return spark.range(0, N, 1, 16).select(key, (F.col("id") % 100).cast("double").alias("value"), F.sha2(F.col("id").cast("string"), 256).alias("other"))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_places_of_a_million_rows(spark, many, adaptive):
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        found = metrics.ranked(many, "key").agg(F.count("*"), F.count_distinct("place"), F.count_if(F.col("place") != F.col("key") + 1), F.min("total"), F.max("total"), F.count("other")).first()
        assert tuple(found) == (N, N, 0, N, N, N)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_curve_tenths_and_thin_of_a_million_rows(many):
    curve = metrics.learning_curve(many, "key", {"mean": F.avg("value"), "highest": F.max("key")}).orderBy("bucket").collect()
    assert [r["bucket"] for r in curve] == list(range(1, 61)) and sum(r["size"] for r in curve) == N
    assert all(r["last"] == r["highest"] + 1 == r["first"] + r["size"] - 1 for r in curve)
    tenths = metrics.tenths(many, "key", "key").first()
    assert tenths["first_tenth"] == (N / 10 - 1) / 2 and tenths["last_tenth"] == N - 1 - (N / 10 - 1) / 2
    kept = [r["key"] for r in metrics.thin(many, "key", 120).select("key", "other").orderBy("key").collect()]
    assert len(kept) == 120 and kept[-1] == N - 1


def test_places_of_few_rows_nulls_and_ties(spark):
    rows = spark.createDataFrame([(3, "c"), (None, "n"), (1, "a"), (1, "b")], "key int, name string")
    assert sorted((r["place"], r["key"]) for r in metrics.ranked(rows, "key").collect()) == [(1, None), (2, 1), (3, 1), (4, 3)]
    assert metrics.ranked(rows.limit(0), "key").count() == 0
