"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A chunk of text that mixes letters with look-alike signs, also as its last ones, with
separators between letters or with letters three times in a row, and a run of single
letters between any white space, are each a lattice: a sign may stand for a letter, a separator and a
repetition for nothing. Viterbi decoding finds the cheapest path under the
channel's costs and a character trigram model. More than 32 signs without a letter
part a chunk into two. Any other text has one path, itself, and isn't decoded. The text and what was restored are scored together by a
logistic model over character n-grams.

Learning uses text and toxic of all labelled rows that aren't held out: the
``FEATURES`` n-grams with the strongest log odds, trigram counts of the texts and,
``BOOST`` times, of those n-grams, and the weights, which are the optimum over all
those rows. Plan: a join with the labels, its rows written once; partial sums a
task for the counts; the rows' features packed in the shared folder, over which each
step of the optimiser sums one gradient a task; one more scan scores. The
driver holds the trigrams and the weights, never rows.

Defined cases: a null text is empty, and empty texts get the model's base score;
rows without label aren't learned from; a label of repeated ids counts for each;
a null doc_id counts as the empty string; repeated rows are kept; where nothing can
be learned the score is 0; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.common import cut, drop, scratch, table
from fieldspan.llm.langid import remainder

FEATURES, GRAM, LEAST, BOOST, FOLDS, HELD = 1024, 5, 4, 2000, 4, 2
THRESHOLD = 0.3
CACHE = 300_000
#: N-grams that a task holds before it passes their counts on.
COUNTED = 1 << 22
#: The penalty of squared weights, their upper bound, and bytes of packed features a task.
RIDGE, MOST, PACKED = 0.02, 8.0, 1 << 24
#: A feature is dense where it stands at least once in so many words.
DENSE = 150
#: What a sign may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "6": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
SEPARATORS = set(" .-_*~'`,:;/\\^#%&=​­")
COST_LEET, COST_DROP_SEPARATOR, COST_DROP_SIGN, COST_DROP_REPEAT, COST_DROP_PAIR = 1.0, 0.2, 6.0, 0.2, 4.0

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_EDGES = " .,:;?!\"'()[]{}<>%&#*~`/\\^=_-"
_SIMPLE = re.compile(r"[a-z]")
_PARTED = re.compile(r"[^\W\d_]*+[\W\d_]++[^\W\d_]")
_NEAR = re.compile(r"[\W\d_][a-z]|([^\W\d_])\1\1")
_LAST = re.compile(r"(?:.*[^\W\d_])?+", re.DOTALL)
_SIGNS = re.compile("[" + re.escape("".join(LEET)) + r"]++[^\w\s]*+$")
#: So many signs without a letter part a chunk.
_LONG = re.compile(r"[\W\d_]{33,}+")
#: Letters that stand for themselves, once.
_STRETCH = re.compile(r"(?:([a-zà-öø-ÿ])(?!\1))++")
_SPACED = re.compile(r"(?<!\S)[\w@$!|+](?:\s+[\w@$!|+]){3,}(?!\S)")


def noisy(chunk: str) -> bool:
    """Whether a chunk is a lattice of more than one path worth decoding.

    A sign stands between an ASCII letter and another letter or before an ASCII
    letter, a letter stands three times in a row, or look-alikes follow the last
    letter. Every pattern is tried at one place or has no repetition: linear in the chunk.
    """
    first = _SIMPLE.search(chunk)
    if (first and _PARTED.match(chunk, first.end())) or _NEAR.search(chunk):
        return True
    last = _LAST.match(chunk).end()
    return last > 0 and _SIGNS.match(chunk, last) is not None


def plain(text: str) -> str:
    """Lower-cased words with a space on either side."""
    return f" {_NOT_LETTERS.sub(' ', text.lower())} "


class Channel:
    """The character model and the decoding of lattices."""

    def __init__(self, trigrams: dict[str, float]) -> None:
        self.trigrams = trigrams
        pairs: dict[str, float] = {}
        ones: dict[str, float] = {}
        for g, n in trigrams.items():
            pairs[g[:2]] = pairs.get(g[:2], 0) + n
            ones[g[2]] = ones.get(g[2], 0) + n
        self.pairs, self.ones, self.total = pairs, ones, sum(ones.values()) + 1
        self.words: dict[str, str] = {}
        self.known: dict[str, float] = {}

    def cost(self, before: str, letter: str) -> float:
        """-log of the letter's probability after two others, backed off to its own."""
        key = before + letter
        found = self.known.get(key)
        if found is None:
            own = (self.ones.get(letter, 0) + 0.1) / (self.total + 10)
            found = self.known[key] = -math.log((self.trigrams.get(key, 0) + 5 * own) / (self.pairs.get(before, 0) + 5))
        return found

    def options(self, noisy: str, i: int) -> tuple[list[tuple[str, float]], float | None]:
        """What sign i may stand for, with the channel's costs, and the cost of its standing for nothing."""
        sign = noisy[i]
        letters = [(sign, 0.0)] if sign.isalpha() else [(x, COST_LEET) for x in LEET.get(sign, "")]
        run = i > 0 and noisy[i - 1] == sign
        triple = run and ((i > 1 and noisy[i - 2] == sign) or noisy[i + 1 : i + 2] == sign)
        if sign in SEPARATORS:
            return letters, COST_DROP_SEPARATOR
        if not sign.isalpha():
            return letters, COST_DROP_REPEAT if triple else COST_DROP_SIGN
        return letters, COST_DROP_REPEAT if triple else COST_DROP_PAIR if run else None

    def decode(self, noisy: str) -> str:
        """The cheapest text of the lattice of a chunk.

        Where one state is left, the letters that follow have one path up to the
        next sign or repetition, and are taken at once.
        """
        states: dict[str, tuple[float, tuple | None]] = {"  ": (0.0, None)}
        i = 0
        while i < len(noisy):
            if len(states) == 1 and (not i or noisy[i - 1] != noisy[i]) and (stretch := _STRETCH.match(noisy, i)):
                ((before, (cost, path)),) = states.items()
                states = {(before + stretch.group())[-2:]: (cost, (stretch.group(), path))}
                i = stretch.end()
                continue
            letters, drop = self.options(noisy, i)
            after: dict[str, tuple[float, tuple | None]] = {}
            for before, (cost, path) in states.items():
                options = [(before[1] + x, cost + c + self.cost(before, x), (x, path)) for x, c in letters]
                if drop is not None:
                    options.append((before, cost + drop, path))
                for state, total, way in options:
                    if state not in after or total < after[state][0]:
                        after[state] = (total, way)
            states = after or states
            i += 1
        path = min(states.items(), key=lambda s: (s[1][0] + self.cost(s[0], " "), s[0]))[1][1]
        out = []
        while path:
            out.append(path[0])
            path = path[1]
        return "".join(reversed(out))

    def _chunk(self, chunk: str) -> str:
        inner = chunk.strip(_EDGES)
        if inner.isalpha() and not _triple(inner):
            return ""
        return " ".join(self.decode(part.rstrip(".,:;?")) for part in _LONG.split(chunk) if noisy(part))

    def restored(self, text: str) -> list[str]:
        """What the noisy chunks of a lower-cased text decode to."""
        known, out = self.words, []
        if len(known) > CACHE:
            known.clear()
        for chunk in text.split():
            found = known.get(chunk)
            if found is None:
                found = self._chunk(chunk)
                if len(chunk) <= 40:
                    known[chunk] = found
            if found:
                out.append(found)
        return out + [self.decode("".join(m.group().split())) for m in _SPACED.finditer(text)]

    def text(self, raw: str | None) -> str:
        """The words of a text, and behind them those restored."""
        lower = (raw or "").lower()
        found = self.restored(lower)
        return plain(lower) + (" ".join(found) + " " if found else "")


_TRIPLE = re.compile(r"(.)\1\1")


def _triple(word: str) -> bool:
    return _TRIPLE.search(word) is not None


def grams(words: str, size: int = GRAM) -> set[str]:
    """The n-grams of letters, with the space before or after for shorter words."""
    return {g for i in range(len(words) - size + 1) if " " not in (g := words[i : i + size])[1:-1]}


class Codes:
    """The GRAM letters of n-grams as one whole number; letters count from 1 as they appear, the space is 0.

    A task has room for ``ROOM`` letters, space included, which is what int64 holds.
    """

    ROOM = int((2**63 - 1) ** (1 / GRAM))

    def __init__(self) -> None:
        self.places, self.letters = np.zeros(0x110000, np.int64), np.array([ord(" ")], np.uint32)

    def add(self, points: np.ndarray) -> bool:
        """Whether there was room for all letters."""
        new = np.unique(points[(self.places[points] == 0) & (points != ord(" "))])
        if len(self.letters) + len(new) > self.ROOM:
            return False
        self.places[new] = np.arange(len(self.letters), len(self.letters) + len(new))
        self.letters = np.append(self.letters, new)
        return True

    def grams(self, points: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """grams() of each of several texts that stand one after another, with a space on either side."""
        at = self.places[points]
        codes, inner = at[: 1 - GRAM].copy(), np.ones(max(len(at) - GRAM + 1, 0), bool)
        for i in range(1, GRAM):
            own = at[i : len(at) - GRAM + 1 + i]
            codes *= self.ROOM
            codes += own
            if i < GRAM - 1:
                inner &= own > 0
        before = np.append(0, np.cumsum(inner))
        # none goes from one text into the next: two spaces stand there
        return [np.unique(x) for x in np.split(codes[inner], before[np.minimum(ends[:-1], len(inner))])]

    def text(self, codes: np.ndarray) -> list[str]:
        parts = np.stack([codes // self.ROOM**i % self.ROOM for i in reversed(range(GRAM))], 1)
        return _parted(self.letters[parts], GRAM)


def _parted(points: np.ndarray, size: int) -> list[str]:
    text = points.astype("<u4").tobytes().decode("utf-32-le")
    return [text[i : i + size] for i in range(0, len(text), size)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _gathered(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[list[str], list[int]]]:
    """The plain texts and labels, in lists of about so many letters."""
    texts, labels, held = [], [], 0
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            texts.append(plain(text.as_py() or ""))
            labels.append(1 if toxic else 0)
            held += len(texts[-1])
            if held > size:
                yield texts, labels
                texts, labels, held = [], [], 0
    if texts:
        yield texts, labels


def labelled(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """text and toxic of all labelled rows that aren't held out."""
    known = labels.filter((remainder(F.col("doc_id"), FOLDS) != HELD) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return documents.select("doc_id", "text").filter(remainder(F.col("doc_id"), FOLDS) != HELD).join(known.hint("shuffle_hash"), "doc_id").select("text", "toxic")


def odds(rows: DataFrame, features: int = FEATURES, most: int = COUNTED) -> list[str]:
    """The n-grams whose presence tells most about the label."""

    def partial(names: list[str], n: np.ndarray, toxic: int) -> pa.RecordBatch:
        own, zero = pa.array(n, pa.int64()), pa.array(np.zeros(len(n), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *((own, zero) if toxic else (zero, own))], ["gram", "toxic", "other"])

    def summed_up(codes: Codes, found: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for toxic, own in enumerate(found):
            if own:
                code, n = np.unique(np.concatenate(own), return_counts=True)
                yield partial(codes.text(code), n, toxic)
                own.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, held = Codes(), 0
        found: list[list[np.ndarray]] = [[], []]
        for texts, labels in _gathered(batches):
            points = _points("".join(texts))
            if not codes.add(points):
                yield from summed_up(codes, found)
                codes, held = Codes(), 0
                if not codes.add(points):
                    for text, toxic in zip(texts, labels):
                        own = sorted(grams(text))
                        yield partial(own, np.ones(len(own), np.int64), toxic)
                    continue
            for own, toxic in zip(codes.grams(points, np.cumsum([len(t) for t in texts])), labels):
                found[toxic].append(own)
                held += len(own)
            if held > most:
                yield from summed_up(codes, found)
                held = 0
        yield from summed_up(codes, found)

    of = rows.agg(F.coalesce(F.sum((F.col("toxic") > 0).cast("long")), F.lit(0)).alias("toxic"), F.count("*").alias("all")).first()
    a, b = of["toxic"] + 1.0, of["all"] - of["toxic"] + 1.0
    summed = rows.mapInArrow(run, "gram string, toxic long, other long").groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    weight = F.log(((F.col("toxic") + 0.5) / a) / ((F.col("other") + 0.5) / b)) * F.sqrt(F.col("toxic") + F.col("other"))
    best = summed.filter(F.col("toxic") + F.col("other") >= LEAST).select("gram", weight.alias("w")).orderBy(F.desc("w"), "gram").limit(features)
    return [r["gram"] for r in best.filter("w > 0").collect()]


def trigrams(rows: DataFrame, boosted: list[str], most: int = COUNTED) -> dict[str, float]:
    def summed_up(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        code, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
        n = np.zeros(len(code), np.int64)
        np.add.at(n, at, np.concatenate([n for _, n in found]))
        points = np.stack([code >> 42, code >> 21 & 0x1FFFFF, code & 0x1FFFFF], 1)
        return pa.RecordBatch.from_arrays([pa.array(_parted(points, 3), pa.string()), pa.array(n)], ["gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for texts, _ in _gathered(batches):
            at = _points("".join(texts).replace(" ", "  ")).astype(np.int64)
            within = np.ones(len(at), bool)
            within[np.cumsum([len(t) + t.count(" ") for t in texts])[:, None] - [1, 2]] = False
            found.append(np.unique(((at[:-2] << 42) + (at[1:-1] << 21) + at[2:])[within[:-2]], return_counts=True))
            held += len(found[-1][0])
            if held > most:
                yield summed_up(found)
                found, held = [], 0
        if found:
            yield summed_up(found)

    counted = rows.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).filter("n > 1")
    out = {r["gram"]: float(r["n"]) for r in counted.toLocalIterator()}
    for gram in boosted:
        padded = ("  " if gram[0] == " " else "") + gram.strip() + (" " if gram[-1] == " " else "")
        for i in range(len(padded) - 2):
            out[padded[i : i + 3]] = out.get(padded[i : i + 3], 0) + BOOST
    return out


class Scorer:
    """Which features a text has, which of them densely, and the logistic model over both."""

    def __init__(self, features: list[str], channel: Channel) -> None:
        self.features, self.channel = features, channel
        self.weights, self.base = np.zeros(2 * len(features)), -30.0
        self.matcher = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"matcher": None}

    def found(self, raw: str | None) -> list[int]:
        if not self.features:
            return []
        if self.matcher is None:
            import ahocorasick

            self.matcher = ahocorasick.Automaton()
            for i, gram in enumerate(self.features):
                self.matcher.add_word(gram, i)
            self.matcher.make_automaton()
        words = self.channel.text(raw)
        counts = Counter(i for _, i in self.matcher.iter(words))
        often = words.count(" ") / DENSE
        return sorted(counts) + [len(self.features) + i for i, n in counts.items() if n >= often]

    def fit(self, packed: DataFrame, rounds: int = 2000) -> int:
        """Logistic regression on how many features a text has (saturating) and which; the rounds it took.

        The weights between 0 and MOST and the base of the most likely labels, less
        the penalty: a concave function with one optimum, which projected
        quasi-Newton steps approach until the next would gain less than a
        billionth of the loss.
        """
        of = packed.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
        if not of["n"] or not self.features:
            return 0
        if of["toxic"] in (0, of["n"]):
            self.base = 30.0 if of["toxic"] else -30.0
            return 0
        size, share = 2 * len(self.features), of["toxic"] / of["n"]
        low, high = np.append(np.zeros(size), -np.inf), np.append(np.full(size, MOST), np.inf)
        at = np.append(np.full(size, 0.25), math.log(share / (1 - share)))
        loss, slope, bend = loss_at(packed, at)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(rounds):
            free = ~(((at <= low) & (slope > 0)) | ((at >= high) & (slope < 0)))
            way = _newton(np.where(free, slope, 0), pairs, bend, free)
            if slope @ way > -1e-9 * loss and pairs:
                pairs = []  # curvatures of other free coordinates may mislead
                way = _newton(np.where(free, slope, 0), pairs, bend, free)
            if slope @ way > -1e-9 * loss:
                return k
            step = 1.0
            while True:
                then = np.clip(at + step * way, low, high)
                found = loss_at(packed, then)
                if found[0] <= loss + 1e-4 * (slope @ (then - at)):
                    break
                step /= 4
                if step < 1e-12:
                    break
            if step < 1e-12:
                if not pairs:
                    return k  # no number nearer to the optimum
                pairs = []
                continue
            moved, turned = then - at, found[1] - slope
            if moved @ turned > 1e-12 * (turned @ turned):
                pairs = [*pairs[-19:], (moved, turned)]
            at, (loss, slope, bend) = then, found
            self.weights, self.base = at[:-1], float(at[-1])
        return rounds

    def score(self, raw: str | None) -> float:
        own = self.found(raw)
        return 1 / (1 + math.exp(-max(min(self.weights[own].sum() + self.base, 30.0), -30.0)))


def packed(rows: DataFrame, scorer: Scorer) -> DataFrame:
    """A row a batch of texts: how many, how many of them toxic, and in binary the labels, the numbers of features and the features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(scorer.found(t.as_py()), np.int32) for t in batch.column(0)]
            toxic = np.array([1 if t else 0 for t in batch.column(1).to_pylist()], np.int8)
            sizes, own = np.array([len(f) for f in found], np.int32), np.concatenate([np.zeros(0, np.int32), *found])
            yield pa.RecordBatch.from_pylist([{"n": len(found), "toxic": int(toxic.sum()), "labels": toxic.tobytes(), "sizes": sizes.tobytes(), "own": own.tobytes()}])

    kept = cut(rows.mapInArrow(run, "n long, toxic long, labels binary, sizes binary, own binary"))
    held = kept.agg(F.coalesce(F.sum(F.length("own")), F.lit(0))).first()[0]
    return kept.coalesce(max(rows.sparkSession.sparkContext.defaultParallelism, -(-held // PACKED)))


def loss_at(rows: DataFrame, at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Of packed rows the loss at weights and base, its slope, and what its second derivatives by coordinate are at most."""
    weights, base, size = at[:-1], at[-1], len(at) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * size + 3)
        for batch in batches:
            for labels, sizes, own in zip(*batch.columns[2:]):
                y, of, column = np.frombuffer(labels.as_py(), np.int8), np.frombuffer(sizes.as_py(), np.int32), np.frombuffer(own.as_py(), np.int32)
                row = np.repeat(np.arange(len(y)), of)
                z = np.bincount(row, weights[column], len(y)) + base
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                error = p - y
                sums[0] += (np.logaddexp(0, z) - y * z).sum()
                sums[1 : size + 1] += np.bincount(column, error[row], size)
                sums[size + 1] += error.sum()
                sums[size + 2 : -1] += np.bincount(column, minlength=size) / 4
                sums[-1] += len(y) / 4
        yield pa.RecordBatch.from_pylist([{"sums": sums.tobytes()}])

    sums = sum(np.frombuffer(r["sums"]) for r in rows.mapInArrow(run, "sums binary").collect())
    ridge = np.append(np.full(size, RIDGE), 0)
    return sums[0] + 0.5 * ridge @ at**2, sums[1 : size + 2] + ridge * at, sums[size + 2 :] + ridge


def _newton(slope: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], bend: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The quasi-Newton step in the free coordinates from the last moves and turns of the slope."""
    way, used = slope.copy(), []
    for moved, turned in reversed(pairs):
        moved, turned = moved * free, turned * free
        if (curve := moved @ turned) > 1e-12 * (turned @ turned):
            share = moved @ way / curve
            way -= share * turned
            used.append((moved, turned, curve, share))
    way = way / bend
    if used:
        way *= used[0][2] / (used[0][1] @ (used[0][1] / bend))
    for moved, turned, curve, share in reversed(used):
        way += (share - turned @ way / curve) * moved
    return -way * free


def learn(documents: DataFrame, labels: DataFrame) -> Scorer:
    spark, path = documents.sparkSession, scratch(documents.sparkSession, "labelled")
    labelled(documents, labels).write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    features = odds(rows)
    scorer = Scorer(features, Channel(trigrams(rows, features)))
    found = packed(rows, scorer)
    drop(spark, path)
    scorer.fit(found)
    return scorer


def score(documents: DataFrame, scorer: Scorer) -> DataFrame:
    """The documents with score; a column of that name is replaced."""
    shared = documents.sparkSession.sparkContext.broadcast(scorer)
    kept = documents.drop("score")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at = shared.value, names.index("text")
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*names, "score"])

    from pyspark.sql.types import DoubleType, StructType

    return kept.mapInArrow(run, StructType([*kept.schema.fields]).add("score", DoubleType()))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = learn(documents, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    found = score(documents, scorer)
    return found.select("doc_id", (remainder(F.col("doc_id"), FOLDS) == HELD).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
