"""Language of a file from its path and its first line."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.constants import (
    LANGUAGE_BY_EXTENSION,
    LANGUAGE_BY_SHEBANG,
    UNKNOWN_LANGUAGE,
)
from sheaf.functions.text import as_text


def extension(path: Column) -> Column:
    """Last suffix of the base name, lower case, dot included; '' if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)\z", 1))


def language_by_extension(path: Column) -> Column:
    # A literal map: a 49-entry lookup inside the projection needs neither a
    # join nor a broadcast, and works unchanged on a stream. It is one SQL expression
    # because a hundred literals made one by one take longer than planning a query.
    entries = ", ".join(f"'{ext}', '{lang}'" for ext, lang in LANGUAGE_BY_EXTENSION.items())
    table = F.expr(f"map({entries})")
    return F.try_element_at(table, extension(path))


def language_by_shebang(content: Column, max_line_bytes: int | None = None) -> Column:
    """Language named in a leading ``#!`` line.

    One line can hold several known names (``sh`` is part of many); the longest
    wins, then the alphabetically first, so the answer does not vary. A line of
    ``max_line_bytes`` or more, if that is given, is not looked at.
    """
    first_line = F.substring_index(as_text(content), "\n", 1)
    names = sorted(LANGUAGE_BY_SHEBANG, key=lambda name: (-len(name), name))
    found = F.coalesce(
        *[F.when(first_line.contains(name), F.lit(LANGUAGE_BY_SHEBANG[name])) for name in names]
    )
    is_shebang = F.substring(content, 1, 2) == F.lit(b"#!")
    if max_line_bytes is not None:
        is_shebang = is_shebang & (F.octet_length(first_line) < max_line_bytes)
    return F.when(is_shebang, found)


def detect_language(
    path: Column, content: Column, known: Column | None = None, max_line_bytes: int | None = None
) -> Column:
    """Known language, else by extension, else by shebang, else ``unknown``."""
    candidates = [
        language_by_extension(path),
        language_by_shebang(content, max_line_bytes),
        F.lit(UNKNOWN_LANGUAGE),
    ]
    if known is not None:
        candidates.insert(0, F.nullif(known, F.lit("")))
    return F.coalesce(*candidates)
