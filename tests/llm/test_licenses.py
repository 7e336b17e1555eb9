import random
import re

from fieldspan.llm import licenses


def slow(text):
    """Phrases by position and every run of words against every template."""
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        for i in range(len(words) - len(phrase) + 1):
            if tuple(words[i : i + len(phrase)]) == phrase:
                places.append(i)
                labels.add(label)
    more, best = set(labels), 1.0 if labels else 0.0
    for label, template in licenses.TEMPLATES:
        own = licenses.words(template)
        tokens, width = set(own), len(own) + len(own) // 4
        said = licenses.words(text)
        share = max((len(tokens.intersection(said[at : at + width])) / len(tokens) for at in range(max(1, len(said) - width + 1))), default=0)
        if share >= licenses.THRESHOLD - 1e-12:
            more.add(label)
            best = max(best, share)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), best


def test_brute_force(spark, texts, sf_dir):
    draw = random.Random(2)
    pieces = [t for _, t in licenses.TEMPLATES] + ["cc by", "CC-BY 4.0", "general public\nlicense", "all rights reserved", "the", "license", "mit", "\n", "é", "foo bar", "version 3", "under"]
    made = []
    for k in range(300):
        words = " ".join(draw.choices(pieces, k=draw.randint(0, 9))).split(" ")
        made.append((1000 + k, " ".join(w for w in words if draw.random() > 0.12)))
    rows = [(i, t) for i, t, *_ in texts] + made + [(r["doc_id"] + 5000, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, labels int").repartition(6)
    found = {}
    for r in licenses.scan(df).collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for i, text in rows:
        wanted = slow(text)
        for r in found[i]:
            got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"])
            assert got[:6] == wanted[:6] and abs(got[6] - wanted[6]) < 1e-12


def test_empty_table(spark):
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_wrapped_notices(spark, tmp_path):
    import textwrap

    rows = []
    for label, template in licenses.TEMPLATES:
        for width in (16, 40, 72):
            rows.append((len(rows), label, "Copyright (c) 2020 someone\n\n" + textwrap.fill(template, width) + "\nfoo bar\n"))
    # the words of a template, apart by more than its length
    rows.append((len(rows), "", "released\n" + "x\n" * 9 + "under the mit\n" + "x\n" * 9 + "license"))
    draw = random.Random(4)
    pieces = [w for _, t in licenses.TEMPLATES for w in t.split()]
    for _ in range(150):
        label, template = draw.choice(licenses.TEMPLATES)
        kept = [w for w in template.split() if draw.random() > 0.15]
        kept[draw.randrange(len(kept))] += " " + draw.choice(pieces)
        rows.append((len(rows), None, "".join(w + draw.choice(" \n") for w in [*draw.choices(pieces, k=5), *kept, *draw.choices(pieces, k=5)])))
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in licenses.op8_licenses(spark, str(tmp_path)).collect()}
    for i, label, text in rows:
        *_, base, labels, best = slow(text)
        more = set(filter(None, labels.split(",")))
        assert found[i]["labels"] == ",".join(sorted(more)) and abs(found[i]["score"] - best) < 1e-12
        if label is not None:
            assert (label in more and best == 1.0) if label else not more
