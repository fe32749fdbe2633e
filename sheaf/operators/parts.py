"""Counting, searching and stripping files that are several rows.

``parts`` has ``path``, ``part`` (0, 1, ... in order) and ``content``, and the contents of a
path, put together, are the file. Contents are looked at once, where they are. What has
to be known of the parts before or after is a few numbers a part, over which windows run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import comments, text
from sheaf.functions.globs import quote
from sheaf.functions.text import as_text, lower_letters, lower_query
from sheaf.session import new_folder

_LONGEST_LINE = 1 << 30


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _beside(rows: DataFrame, facts: DataFrame, path: str) -> DataFrame:
    """Rows with the facts of their part; there are as many facts as rows, so none are broadcast."""
    return rows.join(facts.hint("merge"), [path, "part"])


def _in_order(path: str) -> Window:
    return Window.partitionBy(path).orderBy("part")


def _before(path: str) -> Window:
    return _in_order(path).rowsBetween(Window.unboundedPreceding, -1)


def _after(path: str) -> Window:
    return _in_order(path).rowsBetween(1, Window.unboundedFollowing)


def count_parts(parts: DataFrame, path: str = "path") -> DataFrame:
    """path, line_count and token_count of files, whose parts may end in the middle of a line.

    A token that goes on in the next part counts there only once; parts are cut between
    characters. A file without contents has one line and no tokens.
    """
    content = F.coalesce(F.col("content"), F.lit(b""))
    first, last = (as_text(side) for side in (F.substring(content, 1, 4), F.substring(content, -4, 4)))
    counts = parts.select(
        path,
        "part",
        text.newline_count(content).alias("newlines"),
        text.token_count(as_text(content)).alias("tokens"),
        (F.octet_length(content) == 0).alias("empty"),
        first.rlike(r"(?U)\A\S").alias("opens"),
        last.rlike(r"(?U)\S\z").alias("closes"),
    )
    # An empty part stands between no two characters.
    goes_on = F.last(F.when(~F.col("empty"), F.col("closes")), ignorenulls=True).over(_before(path))
    joined = counts.withColumn("joint", (F.col("opens") & F.coalesce(goes_on, F.lit(False))).cast("bigint"))
    return joined.groupBy(path).agg(
        (F.sum("newlines") + 1).alias("line_count"), (F.sum("tokens") - F.sum("joint")).alias("token_count")
    )


def grep_parts(parts: DataFrame, query: str, path: str = "path") -> DataFrame:
    """One row per line that contains ``query`` in any case, with its 0-based number.

    A part's inner lines are searched in place. The pieces of lines that parts cut are put
    together by the line's number, which is the count of line feeds before it. A line of
    more than 1 GiB, which no row can hold, is left out.
    """
    body = as_text(F.coalesce(F.col("content"), F.lit(b"")))
    possible = F.lit(query != "" and "\n" not in query)
    newlines = text.newline_count(body)
    head, tail = F.substring_index(body, "\n", 1), F.substring_index(body, "\n", -1)
    between = F.octet_length(body) - F.octet_length(head) - F.octet_length(tail) - 2
    inner = F.when(
        newlines > 1,
        F.substring(body.cast("binary"), F.octet_length(head) + 2, F.greatest(between, F.lit(0))).cast("string"),
    )

    def found(line: Column) -> Column:
        return lower_letters(line).contains(lower_query(query))

    places = F.filter(
        F.transform(F.split(inner, "\n"), lambda line, i: F.struct((i + 1).alias("after"), line.alias("piece"))),
        lambda line: found(line["piece"]),
    )
    none = F.array().cast("array<struct<after:int,piece:string>>")
    rows = _written(
        parts.where(possible).select(
            path,
            "part",
            newlines.alias("newlines"),
            head.alias("head"),
            F.when(newlines > 0, tail).alias("tail"),
            F.when(F.coalesce(found(inner), F.lit(False)), places).otherwise(none).alias("lines"),
        ),
        "grep",
    )
    before = F.coalesce(F.sum("newlines").over(_before(path)), F.lit(0))
    # Only numbers pass through the window; lines are joined to them by part.
    numbers = rows.select(path, "part", "newlines").withColumn("before", before).drop("newlines")
    numbered = _beside(rows, numbers, path)
    inner_lines = numbered.select(path, "before", F.explode("lines").alias("at")).select(
        path, (F.col("before") + F.col("at.after")).alias("line_no"), F.col("at.piece").alias("line")
    )
    ends = F.array(
        F.struct(F.col("before").alias("line_no"), F.col("head").alias("piece")),
        F.struct((F.col("before") + F.col("newlines")).alias("line_no"), F.col("tail").alias("piece")),
    )
    pieces = numbered.select(path, "part", F.inline(ends)).where(F.col("piece").isNotNull())
    sizes = Window.partitionBy(path, "line_no")
    short = pieces.withColumn("bytes", F.sum(F.octet_length("piece").cast("bigint")).over(sizes)).where(
        F.col("bytes") <= _LONGEST_LINE
    )
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "piece"))), lambda p: p["piece"]), "")
    # The split reads bytes that are not UTF-8 as it does in whole files.
    cut = short.groupBy(path, "line_no").agg(F.split(whole, "\n")[0].alias("line")).where(found(F.col("line")))
    return inner_lines.unionByName(cut).withColumn("line_no", F.col("line_no").cast("int"))


# Comments

# A block from its opening to its close on a later line; see ``functions.comments``.
_CLOSED_BLOCK = r"/\*[^\n]*+(?:\n(?![^\n]*?\*/)[^\n]*+)*+\n[^\n]*?\*/"
_EDGE = "X"
"""A line that is no comment and not blank, put around a part's lines."""


def _open_after(lines: Column, opened: bool) -> Column:
    """Whether a block is open after the lines, if one is, or none, before them."""
    reading = F.concat(F.lit("/*\n"), lines) if opened else lines
    return F.regexp_replace(reading, _CLOSED_BLOCK, " ").contains("/*")


def with_block_state(parts: DataFrame, path: str = "path") -> DataFrame:
    """``opened``: whether a block comment is open where the part's lines start.

    A part maps the state before it to the state after it: to one state whatever comes
    before, to the same, or to the other one. Before a part the state is that of the last
    part that fixes it, turned as often as parts since then turn it; so the maps are
    composed by two running windows over a row per part.
    """
    lines = text.as_bytes_text(F.coalesce(F.col("content"), F.lit(b"")))
    marked = lines.contains("/*") | lines.contains("*/")
    shut, open_ = (F.when(marked, _open_after(lines, state)).otherwise(F.lit(state)) for state in (False, True))
    maps = _written(parts.select(path, "part", shut.alias("shut"), open_.alias("open")), "blocks")
    turns = (F.col("shut") & ~F.col("open")).cast("int")
    maps = maps.withColumn("turned", F.sum(turns).over(_in_order(path)))
    # What the last fixing part leaves behind, and the turns up to it.
    fixed = F.when(F.col("shut") == F.col("open"), F.struct(F.col("shut").cast("int").alias("state"), "turned"))
    maps = maps.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(_before(path)))
    maps = maps.withColumn("_turned", F.coalesce(F.lag("turned").over(_in_order(path)), F.lit(0)))
    state = F.coalesce(F.col("_fixed.state"), F.lit(0)) + F.col("_turned") - F.coalesce(F.col("_fixed.turned"), F.lit(0))
    return _beside(parts, maps.select(path, "part", (state % 2 == 1).alias("opened")), path)


def strip_parts(parts: DataFrame, path: str = "path", max_line_bytes: int | None = None) -> DataFrame:
    """path, part and content without C-style comments, of parts made of whole lines.

    In order the contents are what ``strip_comments`` makes of the file. Each part is
    stripped from the state in which its lines start, between two lines that mark its
    edges. Blank lines that meet at an edge, and those at the file's start and end, are
    then settled by what the parts before and after hold.
    """
    stated = with_block_state(parts.select(path, "part", "content"), path)
    body = F.coalesce(F.col("content"), F.lit(b""))
    ended = F.when((F.octet_length(body) > 0) & ~body.cast("string").endswith("\n"), F.concat(body, F.lit(b"\n"))).otherwise(body)
    opening = F.when(F.col("opened"), F.lit(f"{_EDGE} /*\n".encode())).otherwise(F.lit(f"{_EDGE}\n".encode()))
    around = F.concat(opening, ended, F.lit(f"*/{_EDGE}".encode()))
    stripped = comments.strip_comments(around)
    # After the first edge a line feed and a line by turns; the second edge keeps its "*/"
    # where no block was open.
    inside = F.regexp_replace(text.as_bytes_text(stripped), rf"\A{quote(_EDGE)}|\n(?:\*/)?{quote(_EDGE)}\z", "")
    long = text.has_line_of(body, max_line_bytes) if max_line_bytes is not None else F.lit(False)
    rows = _written(
        stated.select(path, "part", text.from_bytes_text(inside).alias("lines"), long.alias("long"), body.alias("body"))
        if max_line_bytes is not None
        else stated.select(path, "part", text.from_bytes_text(inside).alias("lines"), long.alias("long")),
        "stripped",
    )
    lines = F.col("lines").cast("string")
    some = F.octet_length("lines") > 0
    has_text = some & (lines != "\n")
    edges = rows.select(
        path, "part", "long", some.alias("some"), has_text.alias("has_text"),
        F.when(some, lines.endswith("\n")).alias("last_blank"),
    )
    edges = edges.select(
        path,
        "part",
        F.coalesce(F.last("last_blank", ignorenulls=True).over(_before(path)), F.lit(False)).alias("after_blank"),
        F.coalesce(F.max("some").over(_before(path)), F.lit(False)).alias("after_some"),
        F.coalesce(F.max("has_text").over(_after(path)), F.lit(False)).alias("before_text"),
        F.max("long").over(Window.partitionBy(path)).alias("untouched"),
    )
    joined = _beside(rows, edges, path)
    first_blank = (lines == "\n") | lines.startswith("\n\n")
    raw = F.col("lines")
    without_one = F.substring(raw, F.lit(2), F.octet_length(raw))
    # A blank line after a blank line goes; so does the first line's line feed.
    kept = F.when(first_blank & F.col("after_blank"), without_one)
    kept = kept.when(~first_blank & ~F.col("after_some"), without_one).otherwise(raw)
    trimmed = text.from_bytes_text(F.rtrim(text.as_bytes_text(kept), F.lit("\n")))
    content = F.when(F.col("before_text"), kept).otherwise(trimmed)
    if max_line_bytes is not None:
        content = F.when(F.col("untouched"), F.col("body")).otherwise(content)
    return joined.select(path, "part", content.alias("content"))
