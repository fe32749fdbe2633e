"""Column expressions over bytes and text.

Content is BINARY. Two views of it are used:

* ``as_text``  - the bytes read as UTF-8, for everything that looks at characters;
* ``as_bytes_text`` - one character per byte (ISO-8859-1), for everything that
  must stay exact on a cut character or on bytes that are not UTF-8.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.constants import (
    BINARY_SAMPLE_BYTES,
    BINARY_SHARE,
    NON_PRINTABLE_CLASS,
    SPACE_BYTES_WIDE,
)

# Under (?U) \S is everything but Unicode white space.
_TOKEN = r"(?U)\S+"

_ASCII_SPACES = "\t\n\x0b\x0c\r "
_WIDE_AT_EDGE = rf"\A(?:{SPACE_BYTES_WIDE})|(?:{SPACE_BYTES_WIDE})\z"
_SPACE_BYTE = rf"(?:[\t-\r ]|{SPACE_BYTES_WIDE})"
_SPACES_AT_EDGE = rf"\A{_SPACE_BYTE}++|{_SPACE_BYTE}++\z"


def as_text(content: Column) -> Column:
    return content.cast("string")


def as_bytes_text(content: Column) -> Column:
    return F.decode(content.cast("binary"), "ISO-8859-1")


def from_bytes_text(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def lower_letters(text: Column) -> Column:
    """Lower case letter by letter.

    ``lower`` looks at the letters around a capital sigma and makes two of a dotted
    capital I; these two are mapped first, and only in texts that hold one.
    """
    special = text.contains("Σ") | text.contains("İ")
    mapped = F.translate(text, "Σİ", "σi")
    return F.lower(F.when(special, mapped).otherwise(text))


def lower_query(query: str) -> str:
    """``lower_letters`` of a search text."""
    return "".join("i" if c == "İ" else c.lower() for c in query)


def byte_length(content: Column) -> Column:
    return F.octet_length(content).cast("bigint")


def byte_slice(content: Column, start: Column, length: Column) -> Column:
    """``length`` bytes from the 0-based offset ``start``."""
    return F.substring(content, (start + F.lit(1)).cast("int"), length.cast("int"))


def token_count(text: Column) -> Column:
    """Number of maximal runs of characters that are not white space."""
    return F.regexp_count(text, F.lit(_TOKEN)).cast("bigint")


def newline_count(content: Column) -> Column:
    text = as_text(content)
    without = F.replace(text, F.lit("\n"), F.lit(""))
    return (F.octet_length(text) - F.octet_length(without)).cast("bigint")


def line_count(content: Column) -> Column:
    return newline_count(content) + F.lit(1)


def trim_spaces(content: Column) -> Column:
    """Drop leading and trailing Unicode white space, byte for byte.

    Nearly every edge is ASCII, so the plain trim runs first and the regex only
    where a wide space is left at an edge.
    """
    trimmed = F.btrim(as_bytes_text(content), F.lit(_ASCII_SPACES))
    edges = F.concat(F.left(trimmed, F.lit(3)), F.lit("|"), F.right(trimmed, F.lit(3)))
    wide = edges.rlike(_WIDE_AT_EDGE)
    text = F.when(wide, F.regexp_replace(trimmed, _SPACES_AT_EDGE, "")).otherwise(trimmed)
    return from_bytes_text(text)


def is_binary(content: Column, sample_bytes: int = BINARY_SAMPLE_BYTES) -> Column:
    """More than the allowed share of the first ``sample_bytes`` bytes is not printable."""
    head = as_bytes_text(F.substring(content, 1, sample_bytes))
    printable = F.regexp_replace(head, f"[{NON_PRINTABLE_CLASS}]+", "")
    dropped = F.length(head) - F.length(printable)
    share = dropped.cast("double") / F.length(head).cast("double")
    return F.coalesce(F.when(F.length(head) > 0, share > F.lit(BINARY_SHARE)), F.lit(False))


def has_line_of(content: Column, n_bytes: int) -> Column:
    """True if a line holds at least ``n_bytes`` bytes (line feed not counted)."""
    long_line = as_bytes_text(content).rlike(rf"(?:\A|\n)[^\n]{{{n_bytes}}}")
    return (F.octet_length(content) >= F.lit(n_bytes)) & long_line
