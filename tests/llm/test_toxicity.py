import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.llm import toxicity
from fieldspan.llm.common import table

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def scorer(spark):
    return toxicity.learn(table(spark, SF, "documents"), table(spark, SF, "labels"))


def test_held_out_accuracy(spark, scorer):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    rows = [r for r in toxicity.score(docs, scorer).join(labels, "doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    predicted = [(r["score"] >= toxicity.THRESHOLD) == (r["toxic"] == 1) for r in rows]
    assert sum(predicted) / len(predicted) > 0.95


@pytest.mark.parametrize("noisy, word", [("1d10t", "idiot"), ("m0r0n", "moron"), ("idiooooot", "idiot"), ("s.c.u.m", "scum"), ("p@thet1c", "pathetic"), ("tra$h", "trash")])
def test_restores(scorer, noisy, word):
    assert scorer.channel.restored(f"the {noisy} of") == [word]
    assert scorer.score(f"the {noisy} of") == pytest.approx(scorer.score(f"the {word} of"), abs=0.4)


def test_spaced_letters(scorer):
    assert "stupid" in scorer.channel.restored("the s t u p i d of")


def test_clean_text_is_left_alone(scorer):
    assert scorer.channel.restored("the plain words, of it. all!! here") == []
    assert scorer.score("the plain words of it") < toxicity.THRESHOLD


def test_odd_rows(spark, texts, scorer):
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string").withColumnRenamed("lang", "score")
    rows = toxicity.score(df, scorer).collect()
    assert len(rows) == len(texts) and all(0 <= r["score"] <= 1 for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.learn(docs, labels)
    assert toxicity.score(docs, empty).count() == 0 and empty.score("idiot") < 0.01


@pytest.mark.parametrize("noisy, word", [("idi07", "idiot"), ("idio7", "idiot"), ("idio7,", "idiot"), ("pathe71(", "pathetic")])
def test_restores_the_last_letters(scorer, noisy, word):
    assert scorer.channel.restored(f"the {noisy} of") == [word]
    assert scorer.channel.restored("the word! of, it? (all)") == []


@pytest.mark.parametrize("noisy", ["s t  u p i d", "s\nt\nu\np\ni\nd", "s t\n\nu p \t i d"])
def test_letters_spaced_by_any_white_space(scorer, noisy):
    assert "stupid" in scorer.channel.restored(f"the {noisy} of")


def test_gate_takes_signs_at_the_end():
    for chunk in ("idi07", "idio7", "dumba$$", "a55", '"a55".'):
        assert toxicity.noisy(chunk)
    for chunk in ("word,", "word:", "words.", "what?", "50", "v2"):
        assert not toxicity.noisy(chunk)


@pytest.mark.parametrize("token", ["x" * 200_000, "ab" * 500_000 + "1", "ab" * 500_000 + "1c", "a" * 300_000, "1" * 1_000_000 + "a", "a" + "$" * 1_000_000 + "2", "a1" * 100_000 + "b", "a." * 200_000, "é1" * 100_000, "aaabbb" * 50_000])
def test_long_tokens_take_linear_time(scorer, token):
    began = time.perf_counter()
    assert 0 <= scorer.score(token) <= 1
    assert time.perf_counter() - began < 5


def test_gate_is_what_its_one_pattern_says():
    """The gate against the plain pattern that it replaces, on every short chunk over an alphabet of each class."""
    plain = re.compile(r"[a-z][^\W\d_]*[\W\d_]+[^\W\d_]|[\W\d_]+[a-z]|([^\W\d_])\1\1|[^\W\d_][" + re.escape("".join(toxicity.LEET)) + r"]+[^\w\s]*$")
    for n in range(6):
        for signs in itertools.product("aé1$,2", repeat=n):
            chunk = "".join(signs)
            assert toxicity.noisy(chunk) == bool(plain.search(chunk)), chunk


def cheapest(channel, noisy):
    """The least cost over all paths of the lattice, each written out."""
    best = {}
    paths = [("  ", 0.0)]
    for i in range(len(noisy)):
        letters, drop = channel.options(noisy, i)
        grown = [(text + x, cost + c + channel.cost(text[-2:], x)) for text, cost in paths for x, c in letters]
        grown += [(text, cost + drop) for text, cost in paths] if drop is not None else []
        paths = grown or paths
    for text, cost in paths:
        total = cost + channel.cost(text[-2:], " ")
        best[text[2:]] = min(total, best.get(text[2:], total))
    return best


def test_decoding_is_the_cheapest_of_all_paths(scorer):
    draw = random.Random(5)
    for _ in range(300):
        noisy = "".join(draw.choice("aaiidots10@$!.-") for _ in range(draw.randint(1, 9)))
        every = cheapest(scorer.channel, noisy)
        assert every[scorer.channel.decode(noisy)] == pytest.approx(min(every.values()), abs=1e-9), noisy


def test_learns_from_every_labelled_row(spark):
    """More rows than any sample: each id that isn't held out once, its words counted."""
    n = 30_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "vile zebra").otherwise("mild zebra").alias("text"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 10 == 0).cast("int")).alias("toxic"))
    wanted = [i for i in range(n) if i % 7 and zlib.crc32(str(i).encode()) % 4 != 2]
    rows = toxicity.labelled(docs, labels)
    assert rows.count() == len(wanted) > 10_000
    assert rows.filter("toxic = 1").count() == sum(i % 10 == 0 for i in wanted)
    learned = toxicity.learn(docs, labels)
    assert learned.channel.trigrams["zeb"] == len(wanted)
    assert learned.score("vile") > 0.9 and learned.score("mild") < 0.1


def test_counts_are_the_same_passed_on_in_parts(spark):
    rows = spark.createDataFrame([(f"vile word {c * 4}", 1) for c in "abcdef"] * 3 + [("mild word", 0), (None, 0)] * 9, "text string, toxic int").repartition(3)
    best = toxicity.odds(rows)
    assert best and toxicity.odds(rows, most=1) == best
    assert toxicity.trigrams(rows, best, most=1) == toxicity.trigrams(rows, best)


def is_optimum(scorer, rows):
    x, y = np.zeros((len(rows), len(scorer.weights))), np.array([t for _, t in rows])
    for i, (text, _) in enumerate(rows):
        x[i, scorer.found(text)] = 1
    error = 1 / (1 + np.exp(-(x @ scorer.weights + scorer.base))) - y
    slope = x.T @ error + 0.02 * scorer.weights
    assert abs(error.sum()) < 0.01
    inner = (scorer.weights > 0) & (scorer.weights < 8)
    assert inner.any() and abs(slope[inner]).max() < 0.01
    assert (slope[scorer.weights <= 0] > -0.01).all() and (slope[scorer.weights >= 8] < 0.01).all()


def test_weights_of_few_rows_are_the_optimum_too(spark):
    """Many features that part few rows without an error: the loss is flat far from the optimum."""
    docs, labels = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "labels"))
    is_optimum(toxicity.learn(docs, labels), [tuple(r) for r in toxicity.labelled(docs, labels).collect()])


def test_weights_are_the_optimum_over_all_rows(spark):
    """The slope of the loss, by a plain matrix, is zero at free weights and points outwards at bounds, in however many parts the rows come."""
    words = ["vile", "foul", "mild", "calm"]
    draw = random.Random(3)
    texts = [" ".join(draw.choice(words) for _ in range(draw.randint(1, 5))) for _ in range(400)]
    rows = [(t, int(draw.random() < (0.8 if "vile" in t else 0.5 if "foul" in t else 0.1))) for t in texts]
    df = spark.createDataFrame(rows, "text string, toxic int")
    for parts in (1, 5):
        scorer = toxicity.Scorer(words, toxicity.Channel({}))
        assert 0 < scorer.fit(toxicity.packed(df.repartition(parts), scorer)) < 2000
        is_optimum(scorer, rows)


def test_counts_are_those_by_place(spark, texts):
    draw = random.Random(8)
    every = [t for _, t, _, _ in texts] + ["!! ", "'a", "abc", "\u0130ab 1ab", "\U00010400bcde", " ".join(map(chr, range(0x4E00, 0x9000))), "".join(map(chr, range(0x4E00, 0x9000))), *("".join(draw.choice("aébc 1!\n") for _ in range(draw.randint(0, 60))) for _ in range(300))]
    rows = spark.createDataFrame([(t, i % 2) for i, t in enumerate(every)], "text string, toxic int").repartition(3)
    trigrams, by = Counter(), [Counter(), Counter()]
    for i, text in enumerate(every):
        words = toxicity.plain(text or "")
        by[i % 2].update(toxicity.grams(words))
        padded = words.replace(" ", "  ")
        trigrams.update(padded[j : j + 3] for j in range(len(padded) - 2))
    assert toxicity.trigrams(rows, []) == {g: n for g, n in trigrams.items() if n > 1}
    a, b = len(every) // 2 + 1, len(every) - len(every) // 2 + 1
    odds = {g: math.log(((by[1][g] + 0.5) / a) / ((by[0][g] + 0.5) / b)) * math.sqrt(by[0][g] + by[1][g]) for g in by[0] | by[1] if by[0][g] + by[1][g] >= toxicity.LEAST}
    found = toxicity.odds(rows, 20)
    assert sorted((odds[g] for g in found), reverse=True) == pytest.approx(sorted((w for w in odds.values() if w > 0), reverse=True)[:20])
