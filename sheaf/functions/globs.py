"""Ignore patterns as regular expressions.

Patterns are a handful of strings given by the caller; they are turned into one
expression when the plan is built, so the test itself is a column predicate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_REGEX_SPECIAL = set(r"\.[]{}()*+-?^$|&~#/ ")


def quote(text: str) -> str:
    """Escape ``text`` so that a Java regex reads it literally."""
    return "".join("\\" + c if c in _REGEX_SPECIAL else c for c in text)


def glob_to_regex(pattern: str, base_name: bool = False) -> str | None:
    """Regex for a whole-string glob, or None if it can match nothing.

    ``*`` and ``?`` do not cross ``/``; ``[...]`` is a class with ranges and a
    leading ``^`` for negation, and may hold ``/``; a backslash quotes the next
    character. With ``base_name`` the subject has no ``/``. A malformed glob
    matches nothing.

    What stands between two stars is taken where it is found first, in an atomic
    group, so a pattern with many stars does not backtrack.
    """
    pieces: list[str] = [""]  # what stands before, between and after the stars
    i, n = 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            pieces.append("")
            continue
        if c == "?":
            pieces[-1] += "[^/]"
            continue
        if c == "[":
            parsed = _glob_class(pattern, i)
            if parsed is None:
                return None
            regex, i = parsed
            pieces[-1] += f"(?!/){regex}" if base_name else regex
            continue
        if c == "\\":
            if i == n:
                return None
            c = pattern[i]
            i += 1
        if c == "/" and base_name:
            return None
        pieces[-1] += quote(c)
    first, *rest = pieces
    if not rest:
        return first
    between = "".join(f"(?>[^/]*?{piece})" for piece in rest[:-1])
    return f"{first}{between}[^/]*{rest[-1]}"


_CLASS = re.compile(
    r"(\^?)"  # negation
    r"((?:(?:\\.|[^\\\]\-])(?:-(?:\\.|[^\\\]\-]))?)+)"  # members and ranges
    r"\]",
    re.DOTALL,
)
_MEMBER = re.compile(r"(\\.|[^\\\]\-])(?:-(\\.|[^\\\]\-]))?", re.DOTALL)


def _glob_class(pattern: str, start: int) -> tuple[str, int] | None:
    found = _CLASS.match(pattern, start)
    if not found:
        return None
    members = []
    for low, high in _MEMBER.findall(found.group(2)):
        low, high = low[-1], (high or low)[-1]
        if low <= high:  # an inverted range matches nothing
            members.append(f"{quote(low)}-{quote(high)}")
    negated = bool(found.group(1))
    if not members:
        return (r"[\s\S]" if negated else r"(?!)"), found.end()
    return f"[{'^' if negated else ''}{''.join(members)}]", found.end()


def scan_ignored(path: Column, patterns: Iterable[str]) -> Column:
    """True for files the scan skips.

    A pattern is a glob on the whole path below the root. A matching directory
    takes everything below it along; ``dir/*`` takes everything below ``dir/``.
    A glob that matches ``.`` matches the root, so it skips every file.
    """
    branches: list[str] = []
    for pattern in patterns:
        if not pattern.strip():
            continue
        regex = glob_to_regex(pattern)
        if regex is not None:
            if re.fullmatch(regex, ".") is not None:
                return F.lit(True)
            branches.append(f"{regex}(?:/|\\z)")
        if pattern.endswith("/*"):
            branches.append(quote(pattern[:-2]) + "/")
    if not branches:
        return F.lit(False)
    return path.rlike(r"\A(?:" + "|".join(branches) + ")")


def tree_ignored(path: Column, patterns: Iterable[str]) -> Column:
    """True for paths the directory tree leaves out.

    Here a pattern with ``*`` is a glob on a base name at any depth, and any other
    pattern is a plain substring of the path.
    """
    ignored = F.lit(False)
    globs: list[str] = []
    for pattern in patterns:
        if not pattern:
            continue
        if "*" not in pattern:
            ignored = ignored | path.contains(pattern)
            continue
        regex = glob_to_regex(pattern, base_name=True)
        if regex is not None:
            globs.append(regex)
    if globs:
        ignored = ignored | path.rlike(r"(?:\A|/)(?:" + "|".join(globs) + r")(?:/|\z)")
    return ignored
