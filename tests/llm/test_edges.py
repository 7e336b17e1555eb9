"""Every operator and the pipeline on odd rows, on empty tables, and with further columns of clashing names."""

import pytest
from pyspark.sql import functions as F

from fieldspan.llm import langid, licenses, mixing, packing, pii, simhash, stages, toxicity

CLASHING = ["fp", "__fp", "__key", "__row", "__spans", "__source", "__plan", "_col", "fingerprint", "component_id", "root", "node", "least", "lang_pred", "held_out", "n_words", "n_base", "labels", "start", "length", "bucket", "offset", "sequence_id", "spans", "copies", "target", "source_size", "size", "toxic", "gram"]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (5, None), (None, 1), (8, 0), (99, 1)], "doc_id long, toxic int")


def odd(spark, texts):
    return spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")


def operators(labels):
    return {
        "packing": packing.pack,
        "redaction": lambda d: pii.redact(d).select(*[c for c in d.columns]).drop(*CLASHING),
        "emission": lambda d: mixing.emit(d).select(*[c for c in d.columns]).drop(*CLASHING),
        "pii": lambda d: pii.detect(d).select("doc_id", "text", "spans"),
        "simhash": simhash.near_duplicates,
        "representatives": lambda d: simhash.representatives(d).select("doc_id", "text"),
        "langid": lambda d: langid.identify(d, langid.learn(d)),
        "mixing": lambda d: mixing.mix(d).select("doc_id", "text", "source_size", "target", "copies"),
        "licenses": licenses.scan,
        "toxicity": lambda d: toxicity.score(d, toxicity.learn(d, labels)).select("doc_id", "text", "score"),
    }


@pytest.mark.parametrize("name", ["packing", "pii", "redaction", "emission", "simhash", "representatives", "langid", "mixing", "licenses", "toxicity"])
def test_further_columns_change_nothing(spark, texts, labels, name):
    run = operators(labels)[name]
    plain = odd(spark, texts).coalesce(1)
    more = plain.withColumns({c: F.lit("clash") for c in CLASHING})
    found = [sorted(map(str, run(df).collect())) for df in (plain, more)]
    assert found[0] == found[1] and found[0]
    assert run(plain.limit(0)).count() == 0 == run(more.limit(0)).count()


@pytest.mark.parametrize("empty", [True, False])
def test_pipeline_of_odd_and_no_rows(spark, texts, labels, tmp_path, empty):
    docs = odd(spark, texts).withColumn("n_chars", F.length("text").cast("long"))
    (docs.limit(0) if empty else docs).write.parquet(f"{tmp_path}/documents.parquet")
    (labels.limit(0) if empty else labels).write.parquet(f"{tmp_path}/labels.parquet")
    pieces = stages.run_stages(spark, str(tmp_path)).collect()
    assert (len(pieces) == 0) == empty
