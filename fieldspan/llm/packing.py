"""Packing by power-of-two decomposition.

A document of n ids is cut into n // length full pieces and one piece for each
bit of the rest, long ones first. Every piece is a sequence of its own, of a
power-of-two length: no sequence crosses documents, none is padded, and sequences
of equal length stand together (``bucket``, the exponent, leads the sequence id).

Plan: one pass over the documents without any shuffle; a task holds one batch of
texts and a bounded cache of encoded words. A sequence id is bucket << 56 |
partition << 36 | number in the partition: unique without any global counter.
It needs an input whose partitions keep their rows when a task runs again, such
as files; after a shuffle, write the table first. More than 2^20 partitions are an
error, as their ids would meet.

Ids are those the tokenizer gives for the whole text. Its pattern never joins
what white space parts, so texts are cut at spaces, and each distinct chunk is
encoded once a worker: lowered chunks of printable Latin-1 characters by the
tokenizer's own model, piece by piece, all others by the whole tokenizer.

Defined cases: a null text is empty; each document ends with the id 1, so an
empty one is the single piece [1]; null and repeated doc_ids are kept as they
are; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.common import table, to_batches

LENGTH = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Chunks whose ids a worker keeps at most; beyond it starts anew.
CACHE = 800_000

PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Latin text without composed or odd cases: what normalisation leaves alone once lowered.
PLAIN = regex.compile(r"[!-~¡-įı-ɏ]+")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(visible)]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.known: dict[str, bytes] = {}

    def _full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        """The ids of a lowered run that the tokenizer's pattern doesn't cut."""
        mapped = piece if piece.isascii() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        return np.array([t.id for t in self.model.tokenize(mapped)], dtype="<u4").tobytes()

    def _kept(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = self.known[piece] = self._piece(piece)
        return found

    def _lowered(self, chunk: str) -> bytes:
        """The ids of a lowered chunk of Latin-1 text without special strings."""
        if chunk.isalpha():
            return self._piece(chunk)
        word = chunk.rstrip(".,")
        if word.isalpha():
            return self._kept(word) + self._kept(chunk[len(word) :])
        if not chunk:
            return b""
        return b"".join(map(self._kept, PIECE.findall(chunk))) if PLAIN.fullmatch(chunk) else self._full(chunk)

    def encode(self, text: str) -> bytes:
        """The ids of a text.

        Latin-1 text is lowered as a whole, where no special string can arise, and
        its distinct chunks are kept; other text is left to the tokenizer chunk by
        chunk.
        """
        chunks = text.replace("\n", " ").split(" ")
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(self._lowered(c.lower()) if c.isascii() and "<|" not in c else self._full(c) for c in chunks)
        if "<|" in text:
            return b"".join(map(self._full, chunks))
        known, chunks = self.known, text.lower().replace("\n", " ").split(" ")
        try:
            return b"".join([known[c] for c in chunks])
        except KeyError:
            pass
        if len(known) >= CACHE:
            known.clear()
        out = []
        for chunk in chunks:
            found = known.get(chunk)
            if found is None:
                found = self._lowered(chunk)
                if len(chunk) <= 64:
                    known[chunk] = found
            out.append(found)
        return b"".join(out)


def lengths(n: int, length: int = LENGTH) -> list[int]:
    """The pieces of n ids: full ones, then the binary digits of the rest."""
    rest = n % length
    return [length] * (n // length) + [1 << b for b in reversed(range(length.bit_length())) if rest >> b & 1]


FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("bucket", pa.int32())]


def pack(documents: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece; with_ids adds its ids, array<int>."""
    if length & (length - 1):
        raise ValueError("the length is a power of two")
    fields = FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else [])
    schema = pa.schema(fields)

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        # the path is the executor's own
        encoder, partition, numbers = Encoder(path or tokenizer_path()), TaskContext.get().partitionId(), [0] * 64
        if partition >> 20:
            raise ValueError("sequence ids have room for 2^20 partitions")
        tail = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encoder.encode(text.as_py() or "") + tail
                start, total = 0, len(data) // 4
                for n in lengths(total, length):
                    bucket = n.bit_length() - 1
                    own = data[4 * start : 4 * (start + n)]
                    row = (doc_id, start, n, zlib.crc32(own), total, bucket << 56 | partition << 36 | numbers[bucket], 0, bucket)
                    yield (*row, np.frombuffer(own, "<i4")) if with_ids else row
                    numbers[bucket] += 1
                    start += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return to_batches(rows(batches), schema, 512 if with_ids else 8192)

    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int" + (", ids array<int>" if with_ids else "")
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, kinds)


def write_buckets(documents: DataFrame, out: str, length: int = LENGTH) -> None:
    """Sequences with their ids as Parquet, a folder for each length."""
    pack(documents, length, with_ids=True).write.partitionBy("bucket").mode("overwrite").parquet(out)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
