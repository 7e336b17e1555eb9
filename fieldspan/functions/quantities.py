"""Numbers, money, ranges and dates read from text, as column expressions.

ANSI mode makes invalid casts errors, so each is a try_ form: a text that can't be
read is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldspan.functions.units import CODES, MONTHS, MULTIPLIERS, SYMBOLS

GROUPED = {".": r"\d{1,3}(?:[,'’   ]\d{3})+", ",": r"\d{1,3}(?:[.'’   ]\d{3})+"}


def number_pattern(decimal: str = ".") -> str:
    mark = r"\." if decimal == "." else ","
    return rf"(?:{GROUPED[decimal]}|\d+)(?:{mark}\d+)?"


def _plain(raw: Column, decimal: str) -> Column:
    """The digits of a localised number with a point."""
    if decimal == ".":
        return F.regexp_replace(raw, "[,'’   ]", "")
    return F.regexp_replace(F.regexp_replace(raw, "[.'’   ]", ""), ",", ".")


def parse_number(text: Column, decimal: str = ".") -> Column:
    """The first number of a text, with its sign, as a double."""
    raw = F.regexp_extract(text, rf"([-−]?{number_pattern(decimal)})", 1)
    return F.regexp_replace(_plain(raw, decimal), "−", "-").try_cast("double")


_MULTIPLIER = "|".join(sorted(MULTIPLIERS, key=len, reverse=True))
_CURRENCY = "|".join([*("\\" + s if s == "$" else s for s in SYMBOLS), *CODES])


def money_pattern(decimal: str = ".") -> str:
    """An amount with its currency before or after it, groups: before, number, multiplier, after."""
    number = number_pattern(decimal)
    clean = r"(?![\d\p{L}]|[.,]\d)"
    return rf"(?:({_CURRENCY})\s?({number})(?:\s?(?i:({_MULTIPLIER}))\b\.?)?{clean}|(?<![\d.,])({number})(?:\s?(?i:({_MULTIPLIER}))\b\.?)?\s?({_CURRENCY}){clean})"


def parse_money(text: Column, decimal: str = ".") -> Column:
    """struct<amount decimal(38,9), currency string> of the first amount, or null."""
    pattern = money_pattern(decimal)
    part = lambda i: F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))
    number, times, sign = F.coalesce(part(2), part(4)), F.coalesce(part(3), part(5)), F.coalesce(part(1), part(6))
    powers = F.create_map(*[F.lit(x) for k, v in MULTIPLIERS.items() for x in (k, 10**v)])
    amount = (_plain(number, decimal).try_cast("decimal(24,9)") * F.coalesce(F.element_at(powers, F.lower(times)).cast("decimal(10,0)"), F.lit(1).cast("decimal(10,0)"))).cast("decimal(38,9)")
    symbols = F.create_map(*[F.lit(x) for kv in SYMBOLS.items() for x in kv])
    return F.when(number.isNotNull(), F.struct(amount.alias("amount"), F.coalesce(F.element_at(symbols, sign), sign).alias("currency")))


def parse_range(text: Column, decimal: str = ".") -> Column:
    """[low, high] of the first `a-b`, `a to b` or `between a and b`; a second sign counts only after another joint."""
    number = number_pattern(decimal)
    joint = r"(?:\s*[–—-]\s*|\s+(?:to|and|bis|und|à|et|a|y)\s+)"
    pattern = rf"((?<![\p{{L}}\d])[-−]?{number}){joint}([-−]?{number})"
    read = lambda i: F.regexp_replace(_plain(F.regexp_extract(text, pattern, i), decimal), "−", "-").try_cast("double")
    low, high = read(1), read(2)
    return F.when(low.isNotNull() & high.isNotNull(), F.array_sort(F.array(low, high)))


def four_digit_year(year: Column) -> Column:
    """00-69 are 2000s, 70-99 1900s; longer years stay."""
    n = year.try_cast("int")
    return F.when(F.length(year) > 2, n).when(n < 70, n + 2000).otherwise(n + 1900)


_MONTH_NUMBERS = {m: i + 1 for months in MONTHS.values() for i, m in enumerate(months)} | {m[:3]: i + 1 for i, m in enumerate(MONTHS["en"])}
_NAMES = "|".join(sorted(_MONTH_NUMBERS, key=len, reverse=True))
YMD = r"(?<!\d)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)"
XYZ = r"(?<!\d)\d{1,2}[-/.]\d{1,2}[-/.](?:\d{4}|\d{2})(?!\d)"
DAY_FIRST = rf"(?i)(?<!\d)\d{{1,2}}(?:st|nd|rd|th|\.)?\s+(?:de\s+|of\s+)?(?:{_NAMES})\.?,?\s+(?:de\s+)?\d{{4}}(?!\d)"
MONTH_FIRST = rf"(?i)(?:{_NAMES})\.?\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}}(?!\d)"


def parse_date(text: Column, order: str = "dmy") -> Column:
    """The date of a text: numbers before month names; a four-digit first number means y-m-d.

    Each form is searched once, and what it finds is read by one lambda, so the
    plan stays within a generated method.
    """
    day, month = (0, 1) if order == "dmy" else (1, 0)
    months = F.create_map(*[F.lit(x) for kv in _MONTH_NUMBERS.items() for x in kv])

    def read(raw: Column) -> Column:
        numbers = F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0))
        name = F.lower(F.regexp_extract(raw, rf"(?i)({_NAMES})", 1))

        def made(n: Column) -> Column:
            at = lambda i: F.get(n, F.lit(i))
            named = F.concat_ws("-", at(1), F.element_at(months, name).cast("string"), at(0))
            ymd = F.concat_ws("-", at(0), at(1), at(2))
            xyz = F.concat_ws("-", four_digit_year(at(2)).cast("string"), at(month), at(day))
            return F.when(name != "", named).when(F.length(at(0)) == 4, ymd).otherwise(xyz)

        return F.try_to_date(F.element_at(F.transform(F.array(numbers), made), 1), "y-M-d")

    found = F.array(*[F.regexp_substr(text, F.lit(p)) for p in (YMD, XYZ, DAY_FIRST, MONTH_FIRST)])
    return F.get(F.filter(F.transform(found, read), lambda d: d.isNotNull()), F.lit(0))


def month_nearest_year(text: Column) -> Column:
    """The number of the month name that stands nearest to the text's first year by words, the earlier on a tie; null without both."""
    months = F.create_map(*[F.lit(x) for kv in _MONTH_NUMBERS.items() for x in kv])
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.element_at(months, w).alias("month"), w.rlike(r"^\d{4}$").alias("year")))

    def nearest(all_: Column) -> Column:
        year = F.get(F.filter(all_, lambda p: p["year"]), F.lit(0))["at"]
        named = F.transform(F.filter(all_, lambda p: p["month"].isNotNull()), lambda p: F.struct(F.abs(p["at"] - year).alias("far"), p["at"].alias("at"), p["month"].alias("month")))
        return F.when(year.isNotNull(), F.array_min(named)["month"])

    return F.element_at(F.transform(F.array(placed), nearest), 1)


def years(text: Column) -> Column:
    """Every year from 1900 to 2099 and model year of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\d\p{L}])(?:MY\s?)?((?:19|20)\d{2})(?![\d\p{L}])"), F.lit(1))
    return F.transform(found, lambda y: y.cast("int"))
