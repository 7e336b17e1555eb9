"""Approximate nearest neighbours: a permutation index.

A bounded sample of ``SAMPLE`` distinct vectors, those of the least hashes, fits the
index; its first ``PIVOTS`` of a length are the pivots. Each distinct vector of a
block is indexed once, with the ids of its rows: it is represented by its ``PREFIX``
nearest pivots in order of nearness, and posted in each one's inverted file with
its place there. A query visits the files of its own pivots and adds prefix -
max(place, place) for every posting: half of what a shared pivot takes off
Spearman's footrule distance with absent pivots placed last. A query's cutoff is the
footrule that the nearest ``RERANK`` share of the sample reaches. Every vector that
reaches it, wherever it lies, is then ranked by its inner products in double
precision, summed in one order, so that copies tie. Hence the answer depends
neither on partitions nor on blocks, and the sample itself holds more than k
vectors that reach the cutoff.

Plan: one scan of the hashes of the vectors for the sample (SAMPLE rows at most to the
driver); the queries get their cutoffs and are written in blocks; one scan of the
vectors, in which each task indexes at most blocks.ROWS rows at a time and reads
the queries in blocks; one aggregation of each task's k best. Every distinct vector
is posted. The share that is reranked is constant, so the work of a query grows
with the rows, as for any index on vectors of this many directions.

Defined cases: vectors that are null or zero, or hold null or non-finite
components, and rows without vec_id, take no part; vectors of unequal length don't
meet, and a length of which the sample holds fewer than ``FEW`` is ranked in full; an
id's own rows are never its results; a repeated id is one query, of all its
vectors, and one result, with its highest score; ties go to the smaller vec_id; where
there are fewer than k candidates, all are returned; further columns are left out;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.blocks import against, best, finite, written
from fieldspan.llm.common import table
from fieldspan.llm.topk import ranked

PIVOTS, PREFIX, RERANK, K, EVERY = 256, 64, 0.3, 20, 20
SAMPLE, FEW = 2048, 200
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    vector = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & finite(vector) & F.exists(vector, lambda x: x != 0)
    return vectors.filter(ok).select(F.col("vec_id").cast("long"), vector.cast("array<double>").alias("vector"))


def sample(vectors: DataFrame, size: int = SAMPLE) -> dict[int, np.ndarray]:
    """By length, distinct vectors in order of their hashes: ``size`` in all, or all if there are fewer.

    Only hashes in a range are grouped; the range grows until it holds enough.
    """
    hashed = vectors.select("vector", F.xxhash64("vector").alias("hash"))
    share = min(1.0, 4 * size / max(vectors.count(), 1))
    while True:
        within = hashed.filter(F.pmod("hash", F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))) if share < 1 else hashed
        rows = within.groupBy("hash").agg(F.min("vector").alias("vector")).orderBy(F.pmod("hash", F.lit(1 << 30)), "hash").limit(size).collect()
        if len(rows) == size or share == 1:
            break
        share = min(1.0, 8 * share)
    found: dict[int, list] = {}
    for row in rows:
        found.setdefault(len(row["vector"]), []).append(row["vector"])
    return {n: np.array(v, dtype=np.float64) for n, v in found.items() if len(v) >= FEW or share == 1}


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row's place for each distinct vector, all places by vector, and where each vector's begin and end there."""
    plain = np.ascontiguousarray(rows + 0.0)  # without negative zeros
    _, first, which = np.unique(plain.view(np.dtype((np.void, plain.itemsize * plain.shape[1]))).ravel(), return_index=True, return_inverse=True)
    return first, np.argsort(which, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(which))])


def prefixes(vectors: np.ndarray, chosen: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first, by direction."""
    near = vectors @ (chosen / np.linalg.norm(chosen, axis=1, keepdims=True)).T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def inverted(order: np.ndarray, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By pivot: the rows that are posted there and their prefix - place."""
    rows, places = np.divmod(np.arange(order.size, dtype=np.int64), order.shape[1])
    by_pivot = np.argsort(order.ravel(), kind="stable")
    cuts = np.searchsorted(order.ravel()[by_pivot], np.arange(count + 1))
    return [(rows[by_pivot[a:b]], (order.shape[1] - places[by_pivot[a:b]]).astype(np.int16)) for a, b in zip(cuts, cuts[1:])]


def footrule(files: list[tuple[np.ndarray, np.ndarray]], order: np.ndarray, count: int) -> np.ndarray:
    """Of each of ``count`` posted vectors, what the pivots that it shares with the query take off the distance."""
    posted = np.concatenate([files[pivot][0] for pivot in order])
    taken = np.concatenate([np.minimum(files[pivot][1], len(order) - at) for at, pivot in enumerate(order)])
    return np.bincount(posted, taken, count)


def cutoffs(asked: np.ndarray, known: np.ndarray, chosen: np.ndarray, k: int, prefix: int, rerank: float) -> np.ndarray:
    """The footrule that the nearest share of the sample reaches, for each query; -1 where all are to be ranked."""
    depth, count = min(prefix, len(chosen)), max(4 * k, int(np.ceil(len(known) * rerank)))
    if count >= len(known):
        return np.full(len(asked), -1)
    files, place = inverted(prefixes(known, chosen, depth), len(chosen)), len(known) - count
    return np.array([np.partition(footrule(files, order, len(known)), place)[place] for order in prefixes(asked, chosen, depth)])


def _asked(queries: DataFrame, fitted: Broadcast, k: int, prefix: int, rerank: float) -> DataFrame:
    """The queries with their cutoffs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from fieldspan.llm.blocks import matrices

        for batch in batches:
            found = np.full(batch.num_rows, -1)
            for n, (rows, _, asked) in matrices(batch.column(0), batch.column(1)).items():
                known, chosen = fitted.value.get(n, (None, None))
                if known is not None:
                    found[rows] = cutoffs(asked, known, chosen, k, prefix, rerank)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], ["vec_id", "vector", "cutoff"])

    return queries.select("vec_id", "vector").mapInArrow(run, "vec_id long, vector array<double>, cutoff long")


def _nearest(own, members, cuts, ids, places, asked, query, k, longest) -> tuple[np.ndarray, np.ndarray]:  # noqa: PLR0913
    """Ids and exact scores of the places that can be among the k nearest, an id's own rows left out.

    All places are scored by a matrix product, whose last bits depend on a row's
    place; those within its error of the k-th are scored again, summed in one order.
    """

    def exact(some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = cuts[some + 1] - cuts[some]
        each = members[np.repeat(cuts[some + 1] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())]
        scores = np.repeat((own[some] * asked).sum(axis=1), sizes)
        other = ids[each] != query
        return ids[each][other], scores[other]

    near, take = own[places] @ asked, 2 * k
    while take < len(places):
        found, scores = exact(places[near >= np.partition(near, len(near) - take)[len(near) - take]])
        kept = best(scores, found, k)
        if len(kept) == k:
            return exact(places[near >= scores[kept[-1]] - 1e-11 * longest * np.linalg.norm(asked)])
        take *= 4  # repeated ids hold the places
    return exact(places)


def _search(fitted: Broadcast, k: int, prefix: int):
    from fieldspan.llm.blocks import matrices

    def search(mine: dict, queries: pa.Table, prepared: dict) -> Iterator[pa.RecordBatch]:
        for n, (places, query_ids, asked) in matrices(queries.column("vec_id"), queries.column("vector")).items():
            if n not in mine:
                continue
            _, ids, rows = mine[n]
            least = queries.column("cutoff").to_numpy()[places]
            _, chosen = fitted.value.get(n, (None, ()))
            depth = min(prefix, len(chosen))
            if n not in prepared:
                first, members, cuts = distinct(rows)
                own = rows[first]
                prepared[n] = own, members, cuts, inverted(prefixes(own, chosen, depth), len(chosen)) if depth else [], np.linalg.norm(own, axis=1).max()
            own, members, cuts, files, longest = prepared[n]
            orders = prefixes(asked, chosen, depth) if depth else None
            out_queries, out_ids, out_scores = [], [], []
            for i, query in enumerate(query_ids):
                places = np.arange(len(own)) if least[i] < 0 else np.flatnonzero(footrule(files, orders[i], len(own)) >= least[i])
                found, scores = _nearest(own, members, cuts, ids, places, asked[i], query, k, longest)
                kept = best(scores, found, k)
                out_queries.append(np.full(len(kept), query))
                out_ids.append(found[kept])
                out_scores.append(scores[kept])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in ((out_queries, pa.int64()), (out_ids, pa.int64()), (out_scores, pa.float64()))], ["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, count: int = PIVOTS, prefix: int = PREFIX, rerank: float = RERANK, size: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score; both inputs have vec_id and vector, array<double>."""
    fitted = vectors.sparkSession.sparkContext.broadcast({n: (v, v[:count]) for n, v in sample(vectors, size).items()})
    asked = _asked(queries.dropDuplicates(["vec_id", "vector"]), fitted, k, prefix, rerank)
    found = against(vectors, written(asked), _search(fitted, k, prefix), FOUND)
    return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k, F.col("score")).select("query_id", "rank", "vec_id", "score")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return nearest(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))
