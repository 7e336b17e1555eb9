"""Text and document scalars as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as people see it, with no-break spaces.
SPACE = r"(?U)\s+"


def strip(value: Column) -> Column:
    """White space collapsed and trimmed, trailing ` .;,` removed."""
    return F.regexp_replace(F.trim(F.regexp_replace(value, SPACE, " ")), r"[ .;,]+$", "")


def fold(value: Column) -> Column:
    """The comparison form of a text: lower case, white space collapsed."""
    return F.lower(F.trim(F.regexp_replace(value, SPACE, " ")))


def media_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def normalise_source(source: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"\.+$", ""), r"^www\.", "")


def source(site: Column, url: Column) -> Column:
    """A document's source: its site, else the host of its URL."""
    return normalise_source(F.coalesce(site, F.try_parse_url(url, F.lit("HOST"))))


def origin(url: Column) -> Column:
    """scheme://host[:port], lower case, default ports dropped."""
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    bare = F.regexp_replace(authority, r"^.*@", "")
    default = F.when(scheme == "http", F.regexp_replace(bare, r":80$", "")).when(scheme == "https", F.regexp_replace(bare, r":443$", "")).otherwise(bare)
    return F.concat(scheme, F.lit("://"), default)


def sniff_content_type(content: Column) -> Column:
    """The media type by the first bytes of binary content, or null."""
    head = F.hex(F.substring(content, 1, 16))
    start = F.lower(F.regexp_replace(F.decode(F.substring(content, 1, 512), "ISO-8859-1"), r"^(ï»¿)?\s*(<!--.*?-->\s*)*", ""))
    return (
        F.when(head.startswith("255044462D"), "application/pdf")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("47494638"), "image/gif")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
        .when(start.rlike(r"^<(!doctype html|html|head|body|title|meta)[\s>/]?"), "text/html")
    )


def type_of_path(path: Column) -> Column:
    """The media type by a file's extension, or null."""
    kinds = {"html": "text/html", "htm": "text/html", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "txt": "text/plain", "json": "application/json"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]), F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)))


def estimate_tokens(text: Column) -> Column:
    """Tokens by pieces: one for each 7 letters of an ASCII word, each digit and each other sign or letter."""
    letters = F.aggregate(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0)), F.lit(0), lambda n, w: n + F.ceil(F.length(w) / 7).cast("int"))
    return letters + F.regexp_count(text, F.lit(r"[^A-Za-z\s]"))


def is_key_value(text: Column) -> Column:
    """Whether a text is one `Label: value`: at most 60 characters and 8 words of label, no clock, ratio or URL."""
    label = F.trim(F.regexp_extract(text, r"^\s*([^:\n]{1,60}?)\s*:(?=\s|$)", 1))
    value = F.trim(F.regexp_extract(text, r"^[^:\n]*:\s*(.*)$", 1))
    return (F.length(label) > 0) & (F.size(F.split(label, r"\s+")) <= 8) & label.rlike(r"\p{L}") & (F.length(value) > 0) & ~text.rlike(r"\b[a-z]+://")


def value_after_label(text: Column) -> Column:
    """What follows the last `: `, without trailing white space and ` .;,`."""
    return F.regexp_replace(F.regexp_extract(text, r"(?s)^.*:\s+(.*)$", 1), r"[\s.;,]+$", "")


def short_id(prefix: str, *parts: Column) -> Column:
    """A stable id: the first 12 hex digits of the parts' SHA-256, NUL between them."""
    joined = F.concat_ws("\u0000", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 12))
