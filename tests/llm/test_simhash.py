import random
import re

import numpy as np
import pytest
import xxhash

from fieldspan.llm import simhash


def slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def classes(prints):
    """key -> smallest key linked, by all pairs."""
    keys = sorted(prints)
    values = np.array([prints[k] for k in keys], dtype=np.uint64)
    root = {k: k for k in keys}

    def up(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, k in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 4):
            a, b = sorted((up(k), up(keys[int(j)])))
            root[b] = a
    return {k: up(k) for k in keys}


@pytest.mark.parametrize("text", [None, "", " \n", "A", "a b c", "A b C d", "a\x0bb\x0cc d e", "x y z É é", "😀 " * 50, "a b c d e f g " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == slow(text)


def test_query_is_brute_force(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {k: simhash.fingerprint(t) for k, t in docs.items()}
    wanted = classes(prints)
    found = simhash.op4_simhash(spark, sf_dir).collect()
    assert len(found) == len(docs)
    assert all(r["component_id"] == wanted[r["doc_id"]] and r["fingerprint"] == f"{prints[r['doc_id']]:016x}" for r in found)


@pytest.mark.parametrize("limit", [1, 4, 8192])
def test_links_of_crowded_points(spark, limit):
    """Random walks of few bits: long chains and dense lists, by pairs and by midpoints."""
    draw = random.Random(5)
    points = set()
    for _ in range(12):
        x = draw.getrandbits(64)
        for _ in range(40):
            for b in draw.sample(range(64), draw.randint(0, 5)):
                x ^= 1 << b
            points.add(x)
    wanted = classes({simhash._signed(p): p for p in points})
    df = spark.createDataFrame([(simhash._signed(p),) for p in points], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, limit)).collect()}
    assert {k: found.get(k, k) for k in wanted} == wanted


def test_odd_rows(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, fp string, component_id string")
    found = simhash.near_duplicates(df).collect()
    assert len(found) == len(texts)
    of = {}
    for r in found:
        of.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert of[1] == of[2] == of[3] == {1} and of[4] == {4} and of[None] == {None}


def test_one_of_each_group_stays(spark, texts):
    df = spark.createDataFrame(texts, "doc_id long, text string, fp string, component_id string")
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(4) == 1 and 1 in ids and 2 not in ids and 3 not in ids and ids.count(None) == 1 and {5, 6, 7} <= set(ids)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0
