"""The stages one by one against plain versions of what each decides."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from fieldspan.llm import mixing, pii, simhash, stages, toxicity
from tests.llm.test_pii import base


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    sf_dir, out = "/root/testdata/sf0.001", tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(out / name))
        docs = spark.read.parquet(str(out / name))
        found.append(docs)
    return found


def test_order_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_dedup", "pii", "mixing", "packing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxic_documents_go(spark, steps):
    docs = steps[0]
    scorer = toxicity.learn(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    wanted = {r["doc_id"] for r in docs.collect() if scorer.score(r["text"]) < toxicity.THRESHOLD}
    assert {r["doc_id"] for r in steps[1].collect()} == wanted and 0 < len(wanted) < docs.count()


def test_one_of_each_group_stays(steps):
    from tests.llm.test_simhash import classes

    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in steps[1].collect()}
    assert sorted(r["doc_id"] for r in steps[2].collect()) == sorted(set(classes(prints).values()))


def test_no_personal_data_is_left(steps):
    assert steps[3].count() == steps[2].count()
    rows = steps[3].collect()
    assert [s for r in rows for s in base(r["text"])] == [] and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert any("[EMAIL]" in r["text"] for r in rows)


def test_mix_and_pieces(steps):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(steps[3]).collect()}
    emitted = [r["doc_id"] for r in steps[4].collect()]
    assert all(emitted.count(k) == n for k, n in taken.items())
    total = steps[5].groupBy("doc_id").sum("length").collect()
    each = {r["doc_id"]: r["doc_tokens"] for r in steps[5].collect()}
    assert all(r["sum(length)"] == each[r["doc_id"]] * taken[r["doc_id"]] for r in total)
    assert pii.KINDS[:4] == pii.BASE_KINDS


def test_run_is_all_stages(spark, steps):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == steps[-1].count()


def test_toxicity_stage_learns_from_every_labelled_row(spark, tmp_path):
    """A word that marks only rows of greater hash, which a sample of the least hashes never met, is rejected too."""
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 5 == 0).alias("bad"), (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) >= 1 << 29).alias("late"))
    rows.select("doc_id", F.col("bad").cast("int").alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    docs = rows.select("doc_id", F.when(~F.col("bad"), "mild calm").when(F.col("late"), "zorkblat calm").otherwise("vile calm").alias("text"))
    kept = {r["text"]: r["count"] for r in stages.reject_toxic(spark, docs, str(tmp_path)).groupBy("text").count().collect()}
    assert kept == {"mild calm": 24_000}
