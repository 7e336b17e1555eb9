"""SimHash near-duplicates: fingerprints, a byte-position index, components.

Fingerprint: XXH64 of every 4-word shingle, and by bit the majority. Two
fingerprints that differ in at most 4 of 64 bits share at least 4 of their 8
bytes at their positions. So the inverted index posts each distinct fingerprint
under its positional bytes four at a time (70 choices of positions, the keys a
pair that reaches the minimum count must share), tallies the shared bytes of the
pairs that a posting list holds, and verifies their bits.

Linear in what is large: documents only enter by their distinct fingerprints
(a group of copies is one), a posting list returns a spanning forest of its links
and never its pairs, and a list of more than ``LIST`` fingerprints isn't compared
by pairs at all: its members meet at midpoints instead. Two fingerprints within 4
bits have a point within 2 bits of both, so each such member posts the 2,081
points around it, and members that share a point are linked. That is exact too,
and its work is linear in the list. No list is held in memory beyond ``LIST``.

Components: alternating large and small stars over the links, each round cut by a
checkpoint in the shared folder.

Defined cases: a text that is null or has no words has fingerprint zero, linked
like any other; fewer than four words give one shingle, the whole; repeated rows
are kept, and share their component; null doc_ids never name a component unless
all its rows have none; an empty table gives an empty one. Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldspan.llm.common import cut, free, table

SHINGLE, SEED, BITS = 4, 42, 4
SHARED = 8 - BITS
#: Fingerprints of a posting list that are compared by pairs.
LIST = 8192
#: Shingles whose bits are tallied at once.
CHUNK = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxh64_intdigest(joined, SEED)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - shingle] + 1).tolist()]
    ends = [*gaps[shingle - 1 :].tolist(), len(joined)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], ends[at : at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts), bitorder="little").tobytes(), "little")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprints(documents: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


#: The bytes of each choice of positions, as masks, and the number of the choice.
MASKS = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), SHARED)]


def postings(points: DataFrame) -> DataFrame:
    """choice, key, fp: each fingerprint under every choice of positional bytes."""
    masks = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.lit(_signed(m)).cast("long").alias("mask")) for i, m in enumerate(MASKS)])
    listed = points.select("fp", F.explode(masks).alias("at"))
    return listed.select(F.col("at.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("at.mask")).alias("key"), "fp")


def forest(points: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the distinct points just as all pairs within bits do."""
    n = len(points)
    root = np.arange(n)
    step = max(1, (1 << 21) // n)
    for at in range(0, n, step):
        differ = points[at : at + step, None] ^ points[None, :]
        shared = (differ.view(np.uint8).reshape(len(differ), n, 8) == 0).sum(axis=2)  # the tally of the pair
        rows, others = np.nonzero((shared >= 8 - bits) & (np.bitwise_count(differ.view(np.uint64)) <= bits))
        rows += at
        keep = rows < others
        _union(root, rows[keep], others[keep])
    _flatten(root)
    loose = np.flatnonzero(root != np.arange(n))
    return points[root[loose]], points[loose]


def _flatten(root: np.ndarray) -> None:
    while (up := root[root]).tobytes() != root.tobytes():
        root[:] = up


def _union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Hooks the roots of all links on smaller ones until each link has one root."""
    while len(a):
        _flatten(root)
        x, y = root[a], root[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))


def _lists(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Of sorted postings: links of the short lists, and (fp, fp) for members of long ones."""
    held: list[np.ndarray] = []
    size, last = 0, None

    def closed() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if 1 < size <= limit:
            yield forest(np.concatenate(held))

    for batch in batches:
        choice, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(key):
            continue
        edges = np.flatnonzero((key[1:] != key[:-1]) | (choice[1:] != choice[:-1])) + 1
        starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        several = (ends - starts > 1) | (starts == 0) | (ends == len(key))
        for a, b in zip(starts[several].tolist(), ends[several].tolist()):
            name = (choice[a], key[a])
            if name != last:
                found += closed()
                held, size, last = [], 0, name
            own = fp[a:b]
            if size <= limit < size + len(own):
                found += [(x, x) for x in held]
                held = []
            size += len(own)
            if size > limit:
                found.append((own, own))
            else:
                held.append(own)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[i] for f in found]), pa.int64()) for i in (0, 1)], ["a", "b"])
    for a, b in closed():
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


AROUND = np.array([_signed(sum(1 << b for b in chosen)) for n in range(BITS // 2 + 1) for chosen in combinations(range(64), n)], dtype=np.int64)


def midpoints(points: DataFrame) -> DataFrame:
    """Links among points that lie within 4 bits: stars on each shared midpoint."""

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 32):
                own = fp[at : at + 32]
                yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ AROUND).ravel()), pa.array(np.repeat(own, len(AROUND)))], ["point", "fp"])

    posted = points.mapInArrow(around, "point long, fp long")
    least = posted.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("most")).filter("a < most").select("point", "a")
    return posted.join(least, "point").filter("a < fp").select("a", F.col("fp").alias("b")).distinct()


def links(points: DataFrame, limit: int = LIST) -> DataFrame:
    """Links (a < b) whose components are those of all pairs within 4 bits."""
    ordered = postings(points).repartition("choice", "key").sortWithinPartitions("choice", "key")
    found = cut(ordered.mapInArrow(lambda batches: _lists(batches, limit), "a long, b long").distinct())
    near = found.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    long = found.filter("a = b").select(F.col("a").alias("fp"))
    if long.isEmpty():
        return near.distinct()
    return near.union(midpoints(long)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the links (a, b): root is its component's least node.

    Large and small stars in turn, O(log n) rounds in practice. A node of many
    links is aggregated before its shuffle, and its join is split by adaptive
    execution.
    """

    def star(now: DataFrame, both: bool) -> DataFrame:
        pairs = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else now.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = pairs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        joined = pairs.join(least, "a")
        if both:
            return joined.filter("b > a").select(F.col("least").alias("a"), "b").distinct()
        moved = joined.filter("b <> least").select(F.col("least").alias("a"), "b")
        return moved.union(least.select(F.col("least").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()

    now, before = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()), None
    while True:
        now = cut(star(star(now, True), False))
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select("a", "a").distinct())


def near_duplicates(documents: DataFrame, shingle: int = SHINGLE, limit: int = LIST) -> DataFrame:
    """doc_id, fp, component_id for every row of the documents."""
    rows = cut(fingerprints(documents, shingle))
    points = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(points.select("fp"), limit))
    named = points.join(joined, points["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    members = named.join(least, "root").select("fp", "component_id")
    return rows.join(members, "fp").select("doc_id", "fp", "component_id")


def representatives(documents: DataFrame, shingle: int = SHINGLE, limit: int = LIST) -> DataFrame:
    """The documents that stay when each component keeps one row, with all their columns.

    It is the row of the least (doc_id, fingerprint), null ids last; equal pairs
    count as one row. The window's limit works before its shuffle, and the join
    keeps its partitioning.
    """
    names = documents.columns
    fp, own, row = (free(names, n) for n in ("__fp", "__key", "__row"))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(1 << 62)).alias("__key")
    found = near_duplicates(documents, shingle, limit).select(key, "fp", "component_id")
    # rows without any id in their component share no component_id: their fingerprint's root is unknown here, so it names them
    group = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = found.groupBy("component_id", group.alias("none")).agg(F.min(F.struct("__key", "fp")).alias("kept")).select(F.col("kept.__key").alias(own), F.col("kept.fp").alias(fp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            prints = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], [*names, fp])

    from pyspark.sql.types import LongType, StructType

    rows = documents.mapInArrow(run, StructType([*documents.schema.fields]).add(fp, LongType())).withColumn(own, key)
    first = Window.partitionBy(own, fp).orderBy(F.lit(1))
    once = rows.withColumn(row, F.row_number().over(first)).filter(F.col(row) == 1)
    return once.join(kept, [own, fp], "left_semi").select(*names)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
