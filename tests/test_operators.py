"""Judge, entities, generators, sources and streams."""

import json

import pytest
from pyspark.sql import functions as F

from fieldspan.operators import entities, generators, judge
from fieldspan.sources import from_files
from fieldspan.sources.documents import load_corpus, read_curve, read_inputs, write_inputs
from fieldspan.streaming import budgets


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scripted_judge_takes_the_last_rule(spark):
    questions = spark.createDataFrame([(1, "red car", "is it a car?"), (2, "boat", "is it a car?"), (3, "x", "other")], "id int, state string, question string")
    rules = spark.createDataFrame([(1, "car", None, 0.2), (2, "car", "red", 0.9)], "place int, question_has string, state_has string, p double")
    assert rows(judge.scripted(questions, rules).select("id", "p")) == [(1, 0.9), (2, 0.2), (3, 0.0)]


def test_lexical_and_key(spark):
    df = spark.createDataFrame([("The red car", "red boat"), ("a", "")], "s string, q string")
    assert [r["p"] for r in df.select(judge.lexical(F.col("s"), F.col("q")).alias("p")).collect()] == [0.5, 0.0]
    assert all(len(r["k"]) == 16 for r in df.select(judge.request_key(F.col("s"), F.col("q")).alias("k")).collect())


def test_batches(spark):
    df = spark.createDataFrame([(1, i, 40) for i in range(5)] + [(1, 5, 500)], "state_id int, place long, tokens long")
    assert rows(judge.batches(df, 100)) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2), (1, 5, 3)]


def test_evidence(spark):
    df = spark.createDataFrame([("x a \n b. y", "a b."), ("x", "z"), ("x", " ")], "t string, s string")
    assert [r["e"] and (r["e"]["start"], r["e"]["end"]) for r in df.select(judge.evidence(F.col("t"), F.col("s")).alias("e")).collect()] == [(2, 8), None, None]


def test_entities(spark):
    said = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, None), (2, 4, "a"), (2, 5, None)], "doc int, statement int, label string")
    assert rows(entities.by_axis(said)) == [(1, "a", 1, True), (1, "a", 3, False), (1, "b", 2, True), (1, "b", 3, False), (2, "document", 4, True), (2, "document", 5, True)]
    labels = spark.createDataFrame([(1, 1, "x"), (1, 2, "x"), (1, 3, "y")], "doc int, place int, label string")
    assert rows(entities.unique_labels(labels)) == [(1, 1, "x"), (1, 2, "x (2)"), (1, 3, "y")]
    claims = spark.createDataFrame([(1, "a", "h", "1"), (1, "a", "h", "2"), (1, "b", "h", "1")], "doc int, label string, header string, value string")
    assert rows(entities.conflicts(claims)) == [(1, "a")]


def test_generator_spans(spark):
    df = spark.createDataFrame([("a😀12b345", "[0-9]+"), ("", "[0-9]+")], "t string, p string")
    found = [[(s["start"], s["end"], s["raw"]) for s in r["s"]] for r in df.select(generators.spans(F.col("t"), F.col("p")).alias("s")).collect()]
    assert found == [[(2, 4, "12"), (5, 8, "345")], []]


@pytest.mark.parametrize("bad", ["(?=a)", "(?<=a)b", r"(a)\1", r"\C", "a" * 501, "(", "", "a++"])
def test_patterns(bad):
    with pytest.raises(Exception):
        generators.check_pattern(bad)


def test_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<!doctype html><p>x")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4")
    (tmp_path / "c.txt").write_text("x")
    assert rows(from_files(spark, str(tmp_path)).select("content_type")) == [("application/pdf",), ("text/html",), ("text/plain",)]
    (tmp_path / "truth.json").write_text(json.dumps({"pages": [{"path": "a.html", "schema": "S", "records": [{"entity": "e", "values": {"f": "1"}}]}]}))
    assert load_corpus(spark, str(tmp_path)).first()["values"] == {"f": "1"}
    write_inputs(spark.createDataFrame([("a", "t")], "path string, text string"), str(tmp_path / "in"))
    assert rows(read_inputs(spark, str(tmp_path / "in"))) == [("a", "t")]
    (tmp_path / "curve.csv").write_text("batch,accuracy\n1,\n")
    assert read_curve(spark, str(tmp_path / "curve.csv"), ["batch"]).first()["accuracy"] is None
    with pytest.raises(ValueError):
        read_curve(spark, str(tmp_path / "curve.csv"), ["nothing"])


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    events.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)

    def run(df, name, mode):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    windows = run(budgets.windowed(stream, "ts", "1 day", "1 hour", "event_type"), "windows", "complete")
    assert windows.agg(F.sum("n")).first()[0] == events.count()
    allowed = run(budgets.admitted(stream, "user_id", 1, 86_400 * 400), "allowed", "append")
    assert allowed.filter("admitted").count() == events.select("user_id").distinct().count()
    drifted = run(budgets.drift(stream.withColumn("confidence", F.when(F.col("value") >= 5, F.col("value"))), "event_type", 10), "drifted", "update")
    assert drifted.filter("n <= 10").count() == events.select("event_type").distinct().count()


def test_judge_batches_of_every_order(spark, tmp_path):
    import random

    from fieldspan.plans.catalogue import QUERIES

    draw = random.Random(5)
    lines = [(order, draw.randint(1, 40), n, float(draw.randint(1, 80))) for order in (1, 1999, 2000, 2001, 2002, 90_000) for n in range(draw.randint(1, 30))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    wanted = {}
    for order in {x[0] for x in lines}:
        batch = used = 0
        for place, tokens in sorted((p * 100 + n, int(q)) for o, p, n, q in lines if o == order):
            if used and used + tokens > 60:
                batch, used = batch + 1, 0
            used += tokens
            wanted[order, place] = batch
    found = QUERIES["judge_batches"](spark, str(tmp_path)).collect()
    assert {(r["state_id"], r["place"]): r["batch"] for r in found} == wanted and len(found) == len(wanted)
