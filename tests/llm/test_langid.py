import zlib

from fieldspan.llm import langid


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rows = langid.identify(docs, langid.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_code_lengths_are_those_of_ppm(spark):
    """Against a direct reading of the counts for every symbol of a text."""
    texts = [("ab" * 60 + " abc", "x"), ("ba" * 60 + "c", "y")]
    found = langid.counts(spark.createDataFrame(texts, "text string, lang string"))
    model = langid.Model(found, node=1)

    def slow(lang, text):
        import math

        line, total = langid.symbols(text.encode()), 0.0
        own = [langid.symbols(t.encode()) for t, name in texts if name == lang]
        for at in range(3, len(line)):
            p = 1.0 / langid.K
            for order in range(4):
                context = line[at - order : at].tolist()
                after = [int(s[i]) for s in own for i in range(3, len(s)) if s[i - order : i].tolist() == context]
                if after:
                    n, kinds, seen = len(after), len(set(after)), after.count(int(line[at]))
                    p = seen / (n + kinds) if seen else kinds / (n + kinds) * p
            total -= math.log2(p)
        return total

    for text in ("abab", "bac", "zé", "cab!", ""):
        for i, lang in enumerate(model.langs):
            assert abs(model.lengths(text)[i] - slow(lang, text)) < 1e-3


def test_odd_rows(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").withColumnRenamed("source", "lang_pred")
    rows = langid.identify(df, langid.learn(df)).collect()
    assert len(rows) == len(texts)
    assert all(r["lang_pred"] == "und" for r in rows if r["doc_id"] in (1, 2, 3))
    assert all(r["lang_pred"] != "und" for r in rows if r["doc_id"] in (4, 5, 6))


def test_empty_table_and_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = langid.learn(empty)
    assert langid.identify(empty, model).count() == 0
    one = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.identify(one, model).first()["lang_pred"] == "und"
