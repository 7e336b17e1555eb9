"""A stated query set against all rows, in blocks.

The queries are written to the shared folder in files of at most ``QUERIES`` rows.
Each task gathers at most ``ROWS`` of its rows and reads one file of queries after
the other, so that the memory of a task is bounded, the driver holds only the
names of the files, and the rows are scanned once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspan.llm.common import cut, scratch

QUERIES, ROWS = 4096, 32_768


def finite(vector: Column) -> Column:
    """Whether a vector is there, with neither null nor non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd


def written(queries: DataFrame, size: int = QUERIES) -> list[str]:
    """The files that hold the queries, as URIs."""
    rows = cut(queries)  # they are counted and written, and computed once
    if not (count := rows.count()):
        return []
    path = f"{scratch(rows.sparkSession, 'queries')}/rows"
    # one task a block: many small partitions would make many small files
    rows.repartition(-(-count // size)).write.option("maxRecordsPerFile", size).parquet(path)
    return sorted(rows.sparkSession.read.parquet(path).inputFiles())


def read(uri: str) -> pa.Table:
    import pyarrow.fs
    import pyarrow.parquet as pq

    files, path = pyarrow.fs.FileSystem.from_uri(uri.replace("file:///", "/") if uri.startswith("file:///") else uri)
    return pq.ParquetFile(files.open_input_file(path)).read()


def matrices(ids: pa.Array, vectors: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of the vectors: their rows, ids and matrix in double precision."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    offsets = vectors.offsets.to_numpy()
    sizes, values, names = np.diff(offsets), vectors.values.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out[n] = rows, names[rows], values[offsets[rows][:, None] + np.arange(n)].astype(np.float64)
    return out


def gathered(batches: Iterator[pa.RecordBatch], size: int = ROWS) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            if rows + part.num_rows > size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            held.append(part)
            rows += part.num_rows
    if rows:
        yield pa.Table.from_batches(held)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best ids, each with its highest score; ties to smaller ids."""
    take = k
    while True:
        if take >= len(scores):
            places = np.arange(len(scores))
        else:
            places = np.flatnonzero(scores >= np.partition(scores, len(scores) - take)[len(scores) - take])
        places = places[np.lexsort((ids[places], -scores[places]))]
        first = np.sort(np.unique(ids[places], return_index=True)[1])
        if len(first) >= k or len(places) == len(scores):
            return places[first[:k]]
        take *= 4  # repeated ids hold the places


def against(rows: DataFrame, files: list[str], search: Callable[..., Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """search(gathered rows, a file's table) for every pair of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in gathered(batches):
            mine = matrices(own.column(0), own.column(1))
            prepared: dict = {}
            for uri in files:
                yield from search(mine, read(uri), prepared)

    return rows.mapInArrow(run, schema)
