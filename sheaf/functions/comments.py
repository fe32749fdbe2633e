"""Comment stripping as one projection.

A line-by-line state machine looks like it needs the lines as rows, a shuffle by
file and windows over them. It does not: where a block opens and closes can be
said in one regular expression over the whole text, so stripping is a chain of
``regexp_replace`` on the content column. No shuffle, no row explosion, and the
same expression runs on a stream.

The rules it reproduces:

* ``/*`` opens a block to the first ``*/`` on a *later* line, even if ``*/``
  follows on the same line; what follows the closing ``*/`` is kept with the
  closing line's indentation and may open the next block;
* ``//`` cuts the rest of a line wherever it stands (also in strings and URLs);
* a cut line keeps its indentation (spaces and tabs) and is trimmed; if nothing is
  left the line disappears;
* white-space lines, also inside blocks, become one blank line per run;
* leading blank lines become two line feeds, trailing ones vanish;
* a file with a line of ``max_line_bytes`` or more, if that is given, is left alone.

Every repeated group below is possessive, so the regex engine loops instead of
recursing and a block of a million lines does not overflow the stack.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions.constants import SPACE_BYTES_WIDE
from sheaf.functions.text import as_bytes_text, as_text, from_bytes_text, has_line_of


class _Reading(NamedTuple):
    """Regex atoms for one reading of the bytes, for patterns under (?U)."""

    space: str
    space_in_line: str
    word: str
    """A run of characters that are neither white space nor a slash."""


# (?U) makes \s the Unicode white space; a predicate is several times faster here than
# the same set spelt out as a class.
_UTF8 = _Reading(r"\s", r"[\s&&[^\n]]", r"[^\s/]++")
_BYTES = _Reading(
    rf"(?:[\t-\r ]|{SPACE_BYTES_WIDE})",
    rf"(?:[\t\x{{0B}}-\r ]|{SPACE_BYTES_WIDE})",
    rf"(?:(?!{SPACE_BYTES_WIDE})[^\t-\r /])++",
)


def _stripped(text: Column, reading: _Reading) -> Column:
    space, space_in_line, word = reading
    blank = f"{space_in_line}*+"

    has_comments = text.contains("//") | text.contains("/*")

    # One carriage return before a line end belongs to the line end.
    without = F.regexp_replace(text, r"\r(?=\n|\z)", "")
    text = plain = F.when(text.contains("\r"), without).otherwise(text)

    # A block becomes " //" (the cut of its first line), one white-space line if it
    # holds any, and the rest of its closing line, ended by " //" so that the next
    # step trims it or drops it. The space keeps a "/" in front out of the mark. An
    # unclosed block takes the rest of the text.
    block = (
        r"(?U)/\*[^\n]*+"
        rf"(?:(\n{blank})(?=\n)|\n(?![^\n]*?\*/)[^\n]*+)*+"
        rf"\n([ \t]*+)[^\n]*?\*/{blank}([^\n]*?)(?=\n|\z|/\*)"
        r"|/\*[\s\S]*+"
    )
    text = F.regexp_replace(text, block, " //$1\n$2$3 //")

    # Lines that are only a comment go; other lines are cut and trimmed.
    before = rf"((?:{word}|{space_in_line}++(?!//)|/(?!/))*+)"
    text = F.regexp_replace(text, rf"(?mdU)^{blank}//[^\n]*+(?:\n|\z)", "")
    text = F.regexp_replace(text, rf"(?mdU)^([ \t]*+){blank}{before}{blank}//[^\n]*+", "$1$2")

    # Most texts that are not code skip the steps above.
    text = F.when(has_comments, text).otherwise(plain)

    # The leading run of white-space lines; then the runs between lines, which become
    # one, and in the same pass the trailing one, of which a single line feed is left
    # to trim. Patterns start with one fixed character or at the start of the text,
    # which is what the regex engine finds fastest.
    text = F.regexp_replace(text, rf"(?U)\A(?:{blank}\n)++", "\n\n")
    text = F.regexp_replace(text, rf"(?U)\n(?:{space}*+\z|(?:{blank}(\n))++)", "\n$1")
    text = F.rtrim(text, F.lit("\n"))
    return F.regexp_replace(text, rf"(?U)\A{space}*+\z", "")


def strip_comments(content: Column, max_line_bytes: int | None = None) -> Column:
    """``content`` without C-style comments; BINARY in, BINARY out."""
    text = as_text(content)
    as_utf8 = _stripped(text, _UTF8).cast("binary")
    # Bytes that are not UTF-8 must come out as they went in.
    as_bytes = from_bytes_text(_stripped(as_bytes_text(content), _BYTES))
    stripped = F.when(F.is_valid_utf8(text), as_utf8).otherwise(as_bytes)
    if max_line_bytes is None:
        return stripped
    return F.when(has_line_of(content, max_line_bytes), content.cast("binary")).otherwise(stripped)
