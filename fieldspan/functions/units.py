"""Units, months and multipliers as data, and conversion as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: canonical unit: (dimension, factor to the dimension's base, spellings)
UNITS: dict[str, tuple[str, float, tuple[str, ...]]] = {
    "kW": ("power", 1.0, ("kw", "kilowatt", "kilowatts")),
    "PS": ("power", 0.73549875, ("PS", "ps", "cv", "pk")),
    "bhp": ("power", 0.745699872, ("bhp", "hp")),
    "cc": ("volume", 0.001, ("cc", "cm3", "ccm")),
    "l": ("volume", 1.0, ("l", "litre", "litres", "liter", "liters")),
    "s": ("time", 1.0, ("s", "sec", "secs", "second", "seconds")),
    "min": ("time", 60.0, ("min", "mins", "minute", "minutes")),
    "h": ("time", 3600.0, ("h", "hr", "hour", "hours")),
    "mph": ("speed", 1.609344, ("mph",)),
    "km/h": ("speed", 1.0, ("km/h", "kmh", "kph")),
    "miles": ("length", 1609.344, ("mile", "miles", "mi")),
    "km": ("length", 1000.0, ("km", "kilometre", "kilometres")),
    "m": ("length", 1.0, ("m", "metre", "metres")),
    "cm": ("length", 0.01, ("cm",)),
    "mm": ("length", 0.001, ("mm",)),
    "kg": ("mass", 1.0, ("kg", "kilogram", "kilograms")),
    "g": ("mass", 0.001, ("g", "gram", "grams")),
    "lb": ("mass", 0.45359237, ("lb", "lbs")),
    "g/km": ("emission", 1.0, ("g/km",)),
    "mpg": ("economy", 1.0, ("mpg",)),
    "l/100km": ("economy", 1.0, ("l/100km",)),
}
#: Reciprocal constants between mpg and l/100km, by gallon.
GALLON = {"uk": 282.480936, "us": 235.214583}

MONTHS: dict[str, tuple[str, ...]] = {
    "en": ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"),
    "de": ("januar", "februar", "märz", "april", "mai", "juni", "juli", "august", "september", "oktober", "november", "dezember"),
    "fr": ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"),
    "es": ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre"),
    "it": ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre"),
    "nl": ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"),
}
MULTIPLIERS: dict[str, int] = {
    "k": 3, "thousand": 3, "tausend": 3, "mille": 3, "mil": 3,
    "m": 6, "mn": 6, "mio": 6, "million": 6, "millions": 6, "millionen": 6, "millones": 6,
    "bn": 9, "mrd": 9, "milliarden": 9, "milliard": 9, "milliards": 9,
}
RANGE_WORDS = ("to", "bis", "à", "a", "tot")
SYMBOLS = {"£": "GBP", "€": "EUR", "$": "USD", "¥": "JPY", "₹": "INR"}
CODES = ("GBP", "EUR", "USD", "JPY", "CHF", "SEK", "NOK", "DKK", "PLN", "AUD", "CAD", "INR")


def unit_table(spark: SparkSession) -> DataFrame:
    """spelling, unit, dimension, factor: the lexicon as a fixed-size relation to broadcast."""
    rows = [(s, u, d, f) for u, (d, f, spelled) in UNITS.items() for s in dict.fromkeys((u, *spelled))]
    return spark.createDataFrame(rows, "spelling string, unit string, dimension string, factor double").dropDuplicates(["spelling"])


def _lookup(key: Column, values: dict[str, object]) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.element_at(F.create_map(*pairs), key)


def canonical_unit(found: Column) -> Column:
    """The canonical spelling of a unit, or null; `PS` is read as written, others in any case."""
    exact = {s: u for u, (_, _, spelled) in UNITS.items() for s in (u, *spelled)}
    folded = {s.lower(): u for s, u in exact.items() if s != "PS"}
    text = F.trim(found)
    return F.coalesce(_lookup(text, exact), _lookup(F.lower(text), folded))


def dimension(unit: Column) -> Column:
    return _lookup(unit, {u: d for u, (d, _, _) in UNITS.items()})


def convert(value: Column, from_unit: Column, to_unit: Column, gallon: str = "uk") -> Column:
    """The value in another unit of its dimension, 6 decimals; null where they don't meet.

    mpg and l/100km are reciprocal; a value of 0 has no reciprocal and gives null.
    """
    factor = lambda u: _lookup(u, {k: f for k, (_, f, _) in UNITS.items()})
    reciprocal = (dimension(from_unit) == "economy") & (from_unit != to_unit)
    linear = value * factor(from_unit) / factor(to_unit)
    result = F.when(reciprocal, F.when(value != 0, F.lit(GALLON[gallon]) / value)).otherwise(linear)
    return F.round(F.when(dimension(from_unit) == dimension(to_unit), result), 6)


def convert_range(bounds: Column, from_unit: Column, to_unit: Column, gallon: str = "uk") -> Column:
    """Both bounds converted and sorted: a reciprocal turns them round."""
    return F.array_sort(F.transform(bounds, lambda v: convert(v, from_unit, to_unit, gallon)))
