"""Locales: canonical tags, conventions as data, currencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: language or tag: decimal mark, date order, gallon, meaning of $, of ¥
CONVENTIONS: dict[str, tuple[str, str, str, str, str]] = {
    "en": (".", "dmy", "uk", "USD", "JPY"),
    "en-US": (".", "mdy", "us", "USD", "JPY"),
    "en-CA": (".", "ymd", "uk", "CAD", "JPY"),
    "en-AU": (".", "dmy", "uk", "AUD", "JPY"),
    "de": (",", "dmy", "uk", "USD", "JPY"),
    "de-CH": (".", "dmy", "uk", "USD", "JPY"),
    "fr": (",", "dmy", "uk", "USD", "JPY"),
    "fr-CA": (",", "ymd", "uk", "CAD", "JPY"),
    "es": (",", "dmy", "uk", "USD", "JPY"),
    "es-MX": (".", "dmy", "us", "MXN", "JPY"),
    "it": (",", "dmy", "uk", "USD", "JPY"),
    "nl": (",", "dmy", "uk", "USD", "JPY"),
    "zh": (".", "ymd", "uk", "USD", "CNY"),
    "ja": (".", "ymd", "uk", "USD", "JPY"),
}
DEFAULT = CONVENTIONS["en"]


def canonical_locale(tag: Column) -> Column:
    """BCP-47 case: language lower, script titled, region upper; `_` is `-`; null if malformed."""
    parts = F.split(F.regexp_replace(F.trim(tag), "_", "-"), "-")

    def cased(part: Column, at: Column) -> Column:
        return (
            F.when(at == 0, F.lower(part))
            .when(F.length(part) == 4, F.concat(F.upper(F.substring(part, 1, 1)), F.lower(F.substring(part, 2, 3))))
            .when(F.length(part) <= 3, F.upper(part))
            .otherwise(F.lower(part))
        )

    ok = F.trim(tag).rlike(r"^[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*$")
    return F.when(ok, F.array_join(F.transform(parts, cased), "-"))


def checked_locale(tag: Column) -> Column:
    """The canonical tag; a malformed one is an error, a null one null."""
    found = canonical_locale(tag)
    return F.when(tag.isNull() | found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("malformed locale: "), tag)))


def language(locale: Column) -> Column:
    return F.split_part(locale, F.lit("-"), F.lit(1))


def conventions(spark: SparkSession) -> DataFrame:
    """locale, decimal, date_order, gallon, dollar, yen: a fixed table to broadcast."""
    return spark.createDataFrame([(k, *v) for k, v in CONVENTIONS.items()], "locale string, decimal string, date_order string, gallon string, dollar string, yen string")


def convention(locale: Column, name: str) -> Column:
    """One convention of a locale: the tag's own, else its language's, else English."""
    at = ("decimal", "date_order", "gallon", "dollar", "yen").index(name)
    table = F.create_map(*[F.lit(x) for k, v in CONVENTIONS.items() for x in (k, v[at])])
    return F.coalesce(F.element_at(table, locale), F.element_at(table, language(locale)), F.lit(DEFAULT[at]))


def scope_matches(scope: Column, value: Column) -> Column:
    """Whether a scope's tags (empty: any) hold a locale: `en` holds en-GB, not the other way; unknown: no."""
    hit = F.exists(scope, lambda s: (value == s) | F.startswith(value, F.concat(s, F.lit("-"))))
    return (F.size(scope) == 0) | F.coalesce(value.isNotNull() & hit, F.lit(False))
