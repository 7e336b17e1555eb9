"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fieldspan.operators.storage import cut, drop, scratch, shared_dir

__all__ = ["batch_of", "cut", "drop", "free", "scratch", "shared_dir", "table", "to_batches"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(taken: Iterable[str], name: str) -> str:
    """The name, underscores before it until no column has it, in any case."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name = f"_{name}"
    return name


def to_batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns: list[Any] = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
