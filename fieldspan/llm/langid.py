"""Language identification by prediction by partial matching.

Each language has a byte context tree of order 3. The code length of a symbol in a
context is that of the longest context known to the tree; a symbol unseen there
costs an escape, distinct / (count + distinct), and is coded one order lower, down
to a uniform code. The statistics are frozen, so the lengths of all symbols in all
contexts are computed once: a context with fewer than ``NODE`` occurrences has no
row and uses its suffix, which makes the order variable. So do, in each order, all but
the most frequent 4 * ``NODES`` / languages contexts: the table's size is bounded
whatever the languages and the sample. A text's language is the
one with the shortest code; the score is its share of the posterior.

Bytes are folded to symbols: letters without case, each byte beyond ASCII, and one
symbol for all else, of which repeats aren't coded.

Learning uses only text and lang of rows with a lang that aren't held out, at most
about ``SAMPLE`` a language, those of the least hash. Plan: a scan of ids and
languages for the sampling rates, a scan for the sample's counts (partial sums a
task), and a scan that scores, without any shuffle of text. The model grows with
the languages, not with the documents.

Defined cases: a null text and one without letters are `und` with score 0; very
long texts are coded in chunks; a null doc_id counts as the empty string; repeated
rows are kept; where nothing can be learned, all is `und`; an empty table gives
an empty one. Only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.common import table

SAMPLE, NODE, NODES, FOLDS = 2000, 32, 60_000, 5
CHUNK = 1 << 18
LETTER = regex.compile(r"\p{L}")

FOLD = np.zeros(256, np.int32)
FOLD[97:123] = np.arange(1, 27)
FOLD[65:91] = np.arange(1, 27)
FOLD[128:] = np.arange(27, 155)
K = 155


def remainder(doc_id: Column, by: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def symbols(data: bytes) -> np.ndarray:
    """The folded bytes after three 0s, without repeated 0s."""
    folded = FOLD[np.frombuffer(data, np.uint8)]
    keep = np.ones(len(folded), bool)
    keep[1:] = (folded[1:] > 0) | (folded[:-1] > 0)
    return np.concatenate([np.zeros(3, np.int32), folded[keep]])


def codes(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The context of each symbol and the symbol."""
    return (line[:-3] * K + line[1:-2]) * K + line[2:-1], line[3:]


def sample(documents: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text and lang of the rows to learn from, about ``size`` a language."""
    known = documents.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), FOLDS) != 0))
    counts = {r["lang"]: r["n"] for r in documents.filter(F.col("lang").isNotNull()).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, size / n))).otherwise(share)
    return known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "lang")


def counts(rows: DataFrame) -> pd.DataFrame:
    """lang, code, n: how often each symbol follows each context, as context * K + symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(*(c.to_pylist() for c in batch.columns)):
                context, symbol = codes(symbols(text.encode()))
                by.setdefault(lang, []).append(context.astype(np.int64) * K + symbol)
            for lang, parts in by.items():
                code, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code)), pa.array(code), pa.array(n)], ["lang", "code", "n"])

    counted = rows.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    found = [(r["lang"], r["code"], r["n"]) for r in counted.toLocalIterator()]
    return pd.DataFrame(found, columns=["lang", "code", "n"])


class Model:
    """The frozen code lengths in bits: a table of contexts by symbols by languages."""

    def __init__(self, found: pd.DataFrame, node: int = NODE, nodes: int = NODES) -> None:
        self.langs = sorted(found["lang"].unique())
        size = len(self.langs)
        lang = found["lang"].map({x: i for i, x in enumerate(self.langs)}).to_numpy(dtype=np.int64)
        code, n = found["code"].to_numpy(dtype=np.int64), found["n"].to_numpy(dtype=np.float64)
        symbol, context = code % K, code // K
        levels, rows = [], 0
        self.row = np.zeros((K, K, K), np.int32)
        self.bits = np.zeros((0, size), np.float32)
        if not size:
            return
        below = np.full((1, K, size), 1.0 / K)
        below_row = np.zeros(K**3, np.int64)
        for order in range(4):
            suffix = context % K**order
            totals = np.bincount(suffix, n, minlength=1)
            kept = np.flatnonzero(totals >= (node if order > 1 else 1))
            if len(kept) * size > nodes * 4:
                kept = np.sort(kept[np.argsort(-totals[kept], kind="stable")[: nodes * 4 // size]])
            place = np.full(K**order, -1, np.int64)
            place[kept] = np.arange(len(kept))
            at = place[suffix]
            own = at >= 0
            seen = np.zeros((len(kept), K, size), np.float64)
            np.add.at(seen, (at[own], symbol[own], lang[own]), n[own])
            total, distinct = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
            lower = below[below_row[kept % K ** max(order - 1, 0)]] if order else np.repeat(below, len(kept), axis=0)
            with np.errstate(invalid="ignore", divide="ignore"):
                p = np.where(total == 0, lower, np.where(seen > 0, seen / (total + distinct), distinct / (total + distinct) * lower))
            base = rows
            levels.append((-np.log2(p)).astype(np.float32))
            rows += len(kept)
            full = np.arange(K**3) % K**order
            hit = place[full] >= 0
            self.row.reshape(-1)[hit] = base + place[full][hit]
            # where the lower order finds its probabilities for the next one
            below, below_row = p, np.where(place >= 0, place, 0) if order else np.zeros(1, np.int64)
            if 0 < order < 3 and (place < 0).any():
                missing = np.flatnonzero(place < 0)
                extra = np.unique(missing % K ** (order - 1), return_inverse=True)
                previous = self._lower(levels, order, extra[0])
                below = np.concatenate([p, previous])
                below_row = place.copy()
                below_row[missing] = len(p) + extra[1]
            if order == 2:
                below = below.astype(np.float32)
        self.bits = np.concatenate(levels).reshape(-1, size)

    def _lower(self, levels: list[np.ndarray], order: int, suffixes: np.ndarray) -> np.ndarray:
        """Probabilities of contexts that have no row of their own, from their suffix's row."""
        table_ = np.concatenate(levels)
        return np.exp2(-table_[self.row.reshape(-1)[suffixes]].astype(np.float64))

    def lengths(self, text: str) -> np.ndarray:
        """The code length of the text in each language."""
        line, total = symbols(text.encode()), np.zeros(len(self.langs))
        for at in range(0, max(len(line) - 3, 0), CHUNK):
            context, symbol = codes(line[at : at + CHUNK + 3])
            total += self.bits.take(self.row.reshape(-1)[context] * K + symbol, axis=0).sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0
        bits = self.lengths(text)
        best = int(np.argmin(bits))
        return self.langs[best], float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum())


def learn(documents: DataFrame, size: int = SAMPLE) -> Model:
    return Model(counts(sample(documents, size)))


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            found = [frozen.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    asked = documents.select(F.col("doc_id").cast("long"), (remainder(F.col("doc_id"), FOLDS) == 0).alias("held_out"), F.col("text").cast("string"))
    return asked.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(documents, learn(documents))
