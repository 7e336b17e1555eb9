"""Personal data: patterns propose spans, checksums confirm them, context adjusts the score.

DataFrame functions only. Spark's patterns give no offsets, so a text is both
matched and split by the same pattern: match i starts after i+1 gaps and i
matches. The prefix sums are taken in blocks of ``BLOCK`` matches, hence the work
is near linear in the matches of a text. All quantifiers are possessive or over
disjoint classes and every pattern is anchored at the start of its run, hence it
is linear in the text.

The base kinds are email, ip (parts of at most 255), card (Luhn, 16 to 19 digits)
and phone (8 to 15 digits); their valid spans always stay. Added kinds: iban
(mod-97, 15 to 34 characters), ssn (d3-d2-d4, issued ranges only), secret (32 to
128 hex digits, both digits and letters and at least ``VARIED`` distinct ones) and key
(access keys by their issuers' prefixes), kept if their score reaches ``THRESHOLD``.
Words of the kind's context within ``CONTEXT_CHARS`` characters on either side
raise it; ssn and secret need them. Offsets are code points, the end exclusive.

Defined cases: a null text is empty; empty texts have no spans; rows are kept as
they are, repeated ones too; an empty table gives an empty one. Columns of the
operator replace input columns of their name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspan.llm.common import free, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret", "key")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9](?:[\x20().-]*+[0-9]){7,14}+(?![\x20().-]*+[0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_])[0-9A-Fa-f]{32,128}+(?![A-Za-z0-9_])",
    "key": r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,255}+|sk-[A-Za-z0-9_-]{20,255}+|xox[abprs]-[A-Za-z0-9-]{10,255}+)(?![A-Za-z0-9_-])",
}
#: A cheap test that a text can hold the kind at all.
GATES = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]-[0-9]", "secret": r"[0-9A-Fa-f]{32}", "key": r"AKIA|gh[pousr]_|sk-|xox[abprs]-"}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "secret": 0.3, "key": 0.7}
CONTEXT = {
    "email": r"(?i)\b(e-?mail|contact|write|mail)\b",
    "ip": r"(?i)\b(ip|address|host|server)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|konto)\b",
    "ssn": r"(?i)\b(ssn|social|security|insurance)\b",
    "secret": r"(?i)(?:\b|_)(token|secret|passw(?:or)?d|credentials?|auth|(?:api|private|access)[ _-]?key)\b",
    "key": r"(?i)(?:\b|_)(token|secret|key|auth)\b",
}
CONTEXT_CHARS, CONTEXT_GAIN, THRESHOLD, BLOCK, VARIED = 40, 0.2, 0.5, 64, 8


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda total, x: total + x)


def _starts(lengths: Column, gaps: Column) -> Column:
    """Start of each match, from the lengths of gap + match and of the gaps."""
    count = F.size(lengths)

    def block(first: Column) -> Column:
        own = F.slice(lengths, first, F.lit(BLOCK))
        return let(own, lambda o: F.transform(F.sequence(F.lit(1), F.size(o)), lambda i: _total(F.slice(o, F.lit(1), i - 1))))

    firsts = F.sequence(F.lit(1), F.greatest(count, F.lit(1)), F.lit(BLOCK))
    sums = F.transform(firsts, lambda f: _total(F.slice(lengths, f, F.lit(BLOCK))))
    bases = let(sums, lambda s: F.transform(F.sequence(F.lit(1), F.size(s)), lambda i: _total(F.slice(s, F.lit(1), i - 1))))
    blocks = F.zip_with(firsts, bases, lambda f, b: F.transform(block(f), lambda x: x + b))
    return F.zip_with(F.flatten(blocks), gaps, lambda s, g: s + g)


def located(text: Column, pattern: str) -> Column:
    """array<struct<start int, value string>> of a pattern's matches."""
    empty = F.array().cast("array<struct<start:int,value:string>>")

    def spans(matches: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), F.length)
        starts = let(gaps, lambda g: let(F.zip_with(g, matches, lambda a, m: a + F.length(m)), lambda n: _starts(n, g)))
        return F.zip_with(starts, matches, lambda s, m: F.struct(s.alias("start"), m.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, spans(m)).otherwise(empty))


def luhn(value: Column) -> Column:
    def ok(digits: Column) -> Column:
        def add(total: Column, i: Column) -> Column:
            digit = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
            return total + F.when(i % 2 == 1, digit).otherwise(digit * 2 - F.when(digit > 4, F.lit(9)).otherwise(F.lit(0)))

        return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0

    return let(F.translate(value, " -", ""), ok)


def mod97(value: Column) -> Column:
    def ok(flat: Column) -> Column:
        def add(rest: Column, i: Column) -> Column:
            code = F.ascii(F.substring(flat, i, F.lit(1)))
            return F.when(code < 65, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

        return F.length(flat).between(15, 34) & (F.aggregate(F.sequence(F.lit(1), F.length(flat)), F.lit(0), add) == 1)

    return let(F.translate(value, " ", ""), lambda v: ok(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))))


PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
VALID: dict[str, Callable[[Column], Column]] = {
    "ip": lambda v: v.rlike(rf"^{PART}(?:\.{PART}){{3}}$"),
    "card": luhn,
    "iban": mod97,
    "ssn": lambda v: v.rlike(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"),
    "secret": lambda v: v.rlike("[0-9]") & v.rlike("[A-Fa-f]") & (F.size(F.array_distinct(F.split(F.lower(v), ""))) >= VARIED),
}


def _span(text: Column, kind: str, match: Column) -> Column:
    start = match["start"]
    before = F.substring(text, F.greatest(start - CONTEXT_CHARS, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT_CHARS)))
    end = start + F.length(match["value"])
    near = F.concat(before, F.lit("\n"), F.substring(text, end + 1, F.lit(CONTEXT_CHARS)))
    score = F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_GAIN)).otherwise(F.lit(0.0))
    return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), score.alias("score"))


SPANS = "array<struct<kind:string,start:int,end:int,score:double>>"


def spans_of(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind in order, with their scores."""
    gate = F.contains(text, F.lit("@")) if kind == "email" else text.rlike(GATES[kind])

    def scored(matches: Column) -> Column:
        kept = F.filter(matches, lambda m: VALID[kind](m["value"])) if kind in VALID else matches
        found = F.transform(kept, lambda m: _span(text, kind, m))
        return found if kind in BASE_KINDS else F.filter(found, lambda s: s["score"] >= THRESHOLD)

    return F.when(gate, let(located(text, PATTERNS[kind]), scored)).otherwise(F.array().cast(SPANS)).cast(SPANS)


def detect(documents: DataFrame) -> DataFrame:
    """The documents with spans: array<struct<kind,start,end,score>>, by kind, then start."""
    return documents.withColumn("spans", let(F.coalesce(F.col("text"), F.lit("")), lambda t: F.concat(*[spans_of(t, k) for k in KINDS])))


def redact(documents: DataFrame) -> DataFrame:
    """The documents, each span of their texts replaced by its kind, as in [EMAIL].

    Where spans overlap, they are replaced as one, named by the first.
    """
    kept_type = "array<struct<start:int,end:int,kind:string>>"

    def merge(kept: Column, span: Column) -> Column:
        last = F.element_at(kept, -1)
        row = lambda s, e, k: F.array(F.struct(s.alias("start"), e.alias("end"), k.alias("kind")))
        joined = row(last["start"], F.greatest(last["end"], span["end"]), last["kind"])
        own = row(span["start"], span["end"], span["kind"])
        apart = F.when(F.size(kept) == 0, F.lit(True)).otherwise(last["end"] <= span["start"])
        return F.when(apart, F.concat(kept, own)).otherwise(F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), joined)).cast(kept_type)

    def rebuilt(text: Column, spans: Column) -> Column:
        def piece(i: Column) -> Column:
            own = F.element_at(spans, i)
            stop = F.when(i < F.size(spans), F.get(spans, i)["start"]).otherwise(F.length(text))
            return F.concat(F.lit("["), F.upper(own["kind"]), F.lit("]"), F.substring(text, own["end"] + 1, stop - own["end"]))

        pieces = F.array_join(F.transform(F.sequence(F.lit(1), F.size(spans)), piece), "")
        return F.concat(F.substring(text, F.lit(1), F.element_at(spans, 1)["start"]), pieces)

    columns = documents.columns
    held = free(columns, "__spans")
    ordered = F.array_sort(F.transform(F.col(held), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    merged = F.aggregate(ordered, F.array().cast(kept_type), merge)
    found = documents.withColumn(held, let(F.coalesce(F.col("text"), F.lit("")), lambda t: F.concat(*[spans_of(t, k) for k in KINDS])))
    clean = F.when(F.size(held) > 0, let(merged, lambda m: rebuilt(F.col("text"), m))).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(*columns)


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"), F.col("spans").alias("scored_spans"))
