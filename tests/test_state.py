import dataclasses
import datetime
import typing

import pytest

from fieldspan.operators import evaluation, judge, learning, tables
from fieldspan.sources import crawl, specs
from fieldspan.sources.store import Store, healthy, open_store


def test_store_versions(spark, tmp_path):
    shape = "id string, n int"
    store = open_store(spark, f"parquet:{tmp_path}/state")
    assert store.read("generators", shape).count() == 0 and healthy(store) is None
    store.append("generators", spark.createDataFrame([("a", 1), ("b", 2)], shape), shape)
    store.upsert("generators", spark.createDataFrame([("b", 3), ("c", 4)], shape), shape, ["id"])
    assert sorted(map(tuple, store.read("generators", shape).collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert len(store.versions("generators")) == 2
    (tmp_path / "state" / "generators" / "99999999-broken").mkdir()  # a version that a lost job left
    assert store.read("generators", shape).count() == 3
    with pytest.raises(ValueError):
        Store(spark, str(tmp_path)).write("nothing", spark.range(1))
    with pytest.raises(ValueError):
        open_store(spark, "postgresql://host/db")


def test_specs():
    pytest.importorskip("yaml")
    found = specs.from_yaml("id: g\nfield: power\npattern: '[0-9]+ kW'\nlocales: [en]\n")
    assert found["group"] == 0 and found["locales"] == ["en"]
    for bad in ("[1]", "id: g\nfield: f\n", "id: g\nid: h\nfield: f\npattern: x", "id: g\nfield: f\npattern: '(?=x)'", "a: &x 1\nid: *x\nfield: f\npattern: x", "id: 1\nfield: f\npattern: x", "x" * 20_001):
        with pytest.raises(ValueError):
            specs.from_yaml(bad)
    assert specs.json_schema()["required"] == ["id", "field", "pattern"]


def test_schema_of_a_data_class():
    @dataclasses.dataclass
    class Bike:
        """a bicycle"""

        name: str
        made: datetime.date | None
        gears: list[int]
        frame: typing.Literal["steel", "carbon"] = dataclasses.field(metadata={"group": "body"}, default="steel")

    found = specs.schema_of(Bike)
    assert [(f.name, f.kind, f.required, f.many, f.options) for f in found.fields] == [("name", "str", True, False, ()), ("made", "date", False, False, ()), ("gears", "int", True, True, ()), ("frame", "enum", True, False, ("steel", "carbon"))]
    assert found.description == "a bicycle" and found.fields[3].group == "body"
    with pytest.raises(ValueError):
        specs.schema_of(int)


def test_halves_and_retries():
    def ask(batch):
        if sum(batch) > 4:
            raise OverflowError
        return [x * 2 for x in batch]

    assert judge.in_halves([1, 2, 3, 1, 4], ask, OverflowError) == [2, 4, 6, 2, 8]
    with pytest.raises(OverflowError):
        judge.in_halves([1, 9], ask, OverflowError)
    slept, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "done"

    assert judge.Retry().call(work, OSError, lambda: 0.5, slept.append) == "done" and slept == [0.5, 1.0]
    with pytest.raises(OSError):
        judge.Retry(tries=2).call(lambda: (_ for _ in ()).throw(OSError()), OSError, lambda: 0.5, slept.append)


def test_waves_ticks_and_axes():
    assert crawl.wave_numbers(crawl.waves("a, b;c")) == {"a": 1, "b": 1, "c": 2}
    for bad in ("a;;b", "a;a", ""):
        with pytest.raises(ValueError):
            crawl.waves(bad)
    for top in (0.003, 0.9, 1, 7, 42, 999, 123456):
        found = crawl.ticks(top)
        assert found[0] == 0 and found[-1] >= top and 3 <= len(found) <= 8 and found[-2] < top
    assert crawl.ticks(0) == [0.0, 1.0]
    assert tables.axis_text(["a", "b", "c"], 1) == "a, b, c" and tables.axis_text(["aaaa", "b", "cccc"], 1, 10) == "…, b, cccc"
    assert tables.axis_text(["x" * 20, "y"], 0, 5) == "xxxx…"
    assert evaluation.rounding_slack("kW") == pytest.approx(0.745699872 / 2) and evaluation.rounding_slack("mpg") == 0.0


def test_samples_are_alike_in_any_partitions(spark):
    rows = spark.range(1000)
    a, b = (sorted(r["id"] for r in crawl.seeded_sample(rows.repartition(n), "id", 10).collect()) for n in (1, 7))
    assert a == b and len(a) == 10


def test_replay_carries_state(spark):
    def run(batch, state):
        before = state.first()["n"] if state is not None else 0
        n = batch.count()
        from pyspark.sql import functions as F

        return batch.withColumn("seen", F.lit(before)), spark.createDataFrame([(before + n,)], "n int")

    found = learning.replay(spark.range(25), "id", 10, run).groupBy("batch", "seen").count().orderBy("batch").collect()
    assert [tuple(r) for r in found] == [(1, 0, 10), (2, 10, 10), (3, 20, 5)]


def test_a_baseline_of_another_corpus_is_an_error(spark):
    base = spark.createDataFrame([("c1", "eval", None, 0.5)], "corpus string, mode string, locale string, accuracy double")
    assert evaluation.comparable(base, "c1", "eval").count() == 1 and evaluation.comparable(base, "c1", "eval").first()["mode"] == "eval"
    with pytest.raises(Exception, match="another corpus"):
        evaluation.comparable(base, "c2", "eval").collect()
