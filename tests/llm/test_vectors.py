import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspan.llm import ann, topk

ODD = [(20, None), (40, [0.0] * 8), (60, [float("nan")] * 8), (80, [float("inf")] + [0.0] * 7), (100, [None] + [1.0] * 7), (None, [1.0] * 8), (120, [1.0, 2.0]), (140, [])]


def vectors(n=1500, dim=8, seed=3):
    draw = np.random.default_rng(seed)
    made = draw.normal(size=(n, dim)).astype(np.float32)
    made[: n // 3] = made[0]  # a third of all rows tie
    return made


def frame(spark, made, odd=True):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + ([(i + 10_000 if i else i, v) for i, v in ODD] if odd else [])
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)


def exact(values, queries, k):
    scores = values @ values.T
    out = {}
    for q in queries:
        order = sorted((i for i in range(len(values)) if i != q), key=lambda i: (-scores[q, i], i))[:k]
        out[q] = [(i, scores[q, i]) for i in order]
    return out


def test_top_k_is_exact(spark):
    made = vectors()
    own = topk.quantised(frame(spark, made))
    found = {}
    for r in topk.top_k(own, own.filter(F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    ints = np.floor(made.astype(np.float64) * 256)
    wanted = exact(ints, range(0, len(made), 50), 5)
    for q, best in wanted.items():
        assert found[q] == [(i, int(s)) for i, s in best]


def test_ann_recall_and_scores(spark):
    made = vectors(3000, 16)
    own = ann.usable(frame(spark, made))
    rows = ann.nearest(own, own.filter(F.col("vec_id") % 20 == 0)).collect()
    double = made.astype(np.float64)
    wanted = exact(double, range(0, len(made), 20), 20)
    hit = total = 0
    for q, best in wanted.items():
        mine = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21)) and len({r["vec_id"] for r in mine}) == 20
        assert all(abs(r["score"] - double[q] @ double[r["vec_id"]]) < 1e-9 for r in mine)
        hit += sum(r["score"] >= best[-1][1] - 1e-9 for r in mine)
        total += 20
    assert hit / total >= 0.9


def test_fewer_candidates_than_k(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (7, [0.5, 0.5]), (9, [0.5, 0.5])], "vec_id long, embedding array<float>")
    own = ann.usable(df)
    assert [(r["vec_id"], r["rank"]) for r in ann.nearest(own, own.filter("vec_id = 0")).orderBy("rank").collect()] == [(7, 1), (9, 2)]
    own = topk.quantised(df)
    assert [(r["vec_id"], r["score"]) for r in topk.top_k(own, own.filter("vec_id = 0")).orderBy("rank").collect()] == [(7, 32768), (9, 32768)]


@pytest.mark.parametrize("rows", [[], ODD[:5]])
def test_nothing_usable(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    own = ann.usable(df)
    assert ann.nearest(own, own).count() == 0
    own = topk.quantised(df)
    assert topk.top_k(own, own).count() == 0


def test_top_k_of_repeated_ids_is_the_oracle(spark):
    import duckdb
    import pyarrow as pa

    draw = np.random.default_rng(7)
    rows = [(i, [float(x) for x in draw.normal(size=8).astype(np.float32)]) for i in range(200)]
    rows = [r for r in rows for _ in range(7)]  # more often than k
    rows += [(i, [float(x) for x in draw.normal(size=8).astype(np.float32)]) for i in range(0, 200, 10)]  # another vector, of queries too
    own = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    found = topk.top_k(own, own.filter(F.col("vec_id") % 50 == 0)).collect()
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [i for i, _ in rows], "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    assert sorted(map(tuple, found)) == sorted(con.execute(topk.ORACLE).fetchall())
    assert len(found) == 4 * 5


def test_ann_recall_by_id_with_copies(spark):
    draw = np.random.default_rng(11)
    made = draw.normal(size=(4000, 32))
    made = (made / np.linalg.norm(made, axis=1, keepdims=True)).astype(np.float32)
    made[draw.choice(4000, 4000 // 3, replace=False)] = made[0]  # a third of the rows are copies
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(made)] + [(1, [float(x) for x in made[1]])] * 30  # an id more often than k
    own = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1))
    assert len(np.unique(ann.sample(own, 256)[32], axis=0)) == 256
    wanted = exact(made.astype(np.float64).round(12), range(0, 4000, 20), 20)
    # copies tie exactly; a matrix product may part them
    copies = [i for i in range(4000) if (made[i] == made[0]).all()]
    found = {}
    for r in ann.nearest(own, own.filter(F.col("vec_id") % 20 == 0)).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = {True: [], False: []}
    for q, best in wanted.items():
        inside = q in set(copies)
        ids = [i for i in copies if i != q][:20] if inside else [i for i, _ in best]
        assert len(found[q]) == 20 == len(set(found[q]))
        hits[inside].append(len(set(ids) & set(found[q])) / 20)
    assert np.mean(hits[True]) == 1.0 and np.mean(hits[False]) >= 0.9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_ann_recall_of_the_given_table(spark, sf):
    """At least 0.95 of the true 20 nearest by vec_id, on all queries of the table."""
    rows = sorted((r["vec_id"], r["vector"]) for r in ann.usable(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")).collect())
    ids, made = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = {}
    for r in ann.op3_ann(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = []
    for at in np.flatnonzero(ids % 20 == 0):
        scores = (made * made[at]).sum(axis=1)
        scores[at] = -np.inf
        wanted = ids[np.lexsort((ids, -scores))[:20]]
        hits.append(len(found[ids[at]].intersection(wanted.tolist())) / 20)
    assert np.mean(hits) >= 0.95


def test_ann_answers_alike_in_any_partitions(spark):
    own = ann.usable(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    queries = own.filter(F.col("vec_id") % 20 == 0)
    one, many = (sorted(map(tuple, ann.nearest(own.repartition(n), queries, size=300).collect())) for n in (1, 16))
    assert one == many and len(one) == 20 * queries.count()


def test_only_sufficient_entries_are_resolved(spark):
    """The entries resolved hold all that reach the cutoff, and are few on the given table."""
    own = topk.quantised(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = np.array([r["vector"] for r in own.orderBy("vec_id").collect()])
    resolved = 0
    for at in range(0, len(rows), 50):
        lists = [x[0] for x in topk._slices(rows[at : at + 1], rows)]
        scores = sum(lists)
        scores[at] = -np.inf
        for x in lists:
            x[at] = -np.inf
        cutoff = np.sort(scores)[-5]
        places, found = topk.sufficient(lists, cutoff)
        assert np.isin(np.flatnonzero(scores >= cutoff), places).all() and (found == scores[places]).all()
        resolved += len(places)
    print(resolved / (len(range(0, len(rows), 50)) * len(rows)))
    assert resolved < 0.1 * len(range(0, len(rows), 50)) * len(rows)


def test_further_and_clashing_columns(spark):
    plain = frame(spark, vectors(200), odd=False)
    more = plain.withColumns({"query_id": F.lit(7), "rank": F.lit(7), "score": F.lit(7.0), "vector": F.lit("v"), "cutoff": F.lit(1), "hash": F.lit(1)})
    for module, search in ((topk, topk.top_k), (ann, ann.nearest)):
        prepare = topk.quantised if module is topk else ann.usable
        found = [sorted(map(tuple, search(prepare(df), prepare(df).filter("vec_id % 50 = 0")).collect())) for df in (plain, more)]
        assert found[0] == found[1] and found[0]
