from collections import Counter

from fieldspan.llm import mixing


def rows(spark, n=3000):
    docs = [(i, "w " * (i % 40 + 1), "hot" if i % 3 else f"s{i % 7}") for i in range(n)] + [(n, None, None), (n + 1, "a b", None), (None, "a", "hot"), (1, "w w", "hot")]
    return spark.createDataFrame(docs, "doc_id long, text string, source string")


def test_targets_share_all_words(spark):
    found = {r["source"]: r for r in mixing.source_targets(rows(spark)).collect()}
    total = sum(r["source_size"] for r in found.values())
    assert abs(sum(r["target"] for r in found.values()) - total) < 1e-6 * total
    assert all(r["target"] <= 3 * r["source_size"] + 1e-9 for r in found.values())
    order = sorted(k for k in found if k is not None) + [None]
    free = [(k, found[k]["target"] / (i % 3 + 1)) for i, k in enumerate(order) if found[k]["target"] < 3 * found[k]["source_size"]]
    assert max(x for _, x in free) - min(x for _, x in free) < 1e-6 * total


def test_copies(spark):
    df = rows(spark)
    mixed = mixing.mix(df).collect()
    assert len(mixed) == df.count()
    for r in mixed:
        rate = r["target"] / r["source_size"] if r["source_size"] else 0
        assert r["copies"] in (int(rate), int(rate) + 1) and r["copies"] <= 3
    emitted = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.emit(df).collect())
    expected = Counter()
    for r in mixed:
        expected[(r["doc_id"], r["text"], r["source"])] += r["copies"]
    assert emitted == +expected
    assert sorted(map(str, mixing.emit(df).collect())) == sorted(map(str, mixing.emit(df.repartition(5)).collect()))


def test_near_the_target(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "repeat('w ', int(id % 50) + 1) as text", "concat('s', id % 5) as source")
    by = {}
    for r in mixing.mix(docs).selectExpr("source", "target", "copies * (doc_id % 50 + 1) as taken").collect():
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken / target - 1) < 0.05 for target, taken in by.values())


def test_clashing_columns_and_empty(spark):
    df = rows(spark, 10).selectExpr("*", "1 as target", "2 as copies", "3 as source_size")
    assert set(mixing.mix(df).columns) == set(df.columns)
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.emit(empty).count() == 0
    silent = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [r["copies"] for r in mixing.mix(silent).collect()] == [0, 0]
