from fieldspan.operators import resolve


def test_labels_that_differ_stay_apart(spark):
    rows = [
        (1, "a", "SE", {"price": "1"}),
        (1, "b", "SE", {"price": "2"}),
        (1, "c", "SE", {"power": "9"}),
        (1, "d", "GT", {"price": "1"}),
        (1, "e", "GT", {"power": "1"}),
        (2, "a", "SE", None),
    ]
    df = spark.createDataFrame(rows, "doc int, entity string, label string, values map<string,string>")
    found = {(r["doc"], r["entity"]): (r["unit"], r["over"]) for r in resolve.unified(df).collect()}
    assert found == {(1, "a"): ("a", ""), (1, "b"): ("b", ""), (1, "c"): ("c", "a,b"), (1, "d"): ("d", ""), (1, "e"): ("d", ""), (2, "a"): ("a", "")}
    assert resolve.unified(df.limit(0)).count() == 0


def test_kinds_are_closed(spark):
    df = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (2, "x", "y")], "doc int, finer string, coarser string")
    assert sorted(map(tuple, resolve.closed(df).collect())) == [(1, a, b) for a in "abc" for b in "abc" if a != b] + [(2, "x", "y")]


def test_unassigned(spark):
    said = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc int, statement int")
    scopes = spark.createDataFrame([(1, 2, "x"), (1, 2, "y")], "doc int, statement int, label string")
    assert sorted(map(tuple, resolve.unassigned(said, scopes).collect())) == [(1, 1), (2, 1)]
