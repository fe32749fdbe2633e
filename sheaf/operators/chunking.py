"""Chunks of documents: overlapping byte windows and budgeted packs of segments.

Both are narrow: nothing is shuffled. A document is exploded into blocks of windows, each
with the bytes it spans and the number of its first line, and a block into its windows, so
that the memory a task needs is bounded by one document and one block, however much the
windows overlap. Packs do not overlap; they are found and cut inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.functions.constants import (
    DEFAULT_CHUNK_OVERLAP,
    DEFAULT_CHUNK_SIZE,
    DEFAULT_MAX_TOKENS,
)
from sheaf.options import require_non_negative

# A segment: a tag up to its ">" (and one line feed after it), else a line.
_LINE = r"[^\n]*+\n|[^\n]++"
_SEGMENT = rf"<[^>]*+>\n?|{_LINE}"


_BLOCK_BYTES = 1 << 20
"""Bytes of a block's windows, unless the fewest windows of a block have more."""
_FEWEST, _MOST = 16, 4096
"""Windows of a block."""


class _Windows:
    """Where the windows of documents of some length lie.

    Windows advance by ``size - overlap`` (at least 1). Once the rest is no longer
    than the overlap it becomes the last window. ``length`` is a column of bytes.
    """

    def __init__(self, length: Column, size: int, overlap: int) -> None:
        self._length, self._size = length, F.lit(size).cast("bigint")
        self._step = F.lit(max(1, size - overlap)).cast("bigint")
        self.per_block = min(_MOST, max(_FEWEST, _BLOCK_BYTES // size))
        zero = F.lit(0).cast("bigint")
        if overlap < size:
            # Up to the first multiple of the step from which a full window reaches the end.
            steps = F.ceil((length - self._size) / self._step) + 1
            self._rest = length - F.lit(overlap) if overlap else None
            many = steps + 1 if overlap else steps
        else:
            self._rest = None
            many = F.greatest(zero, length - F.lit(overlap + 1)) + 2
        one = F.least(length, F.lit(1).cast("bigint"))
        self.count = F.when(length > self._size, many).otherwise(one).cast("bigint")
        self.blocks = F.ceil(self.count / F.lit(self.per_block)).cast("bigint")

    def start(self, window: Column, count: Column) -> Column:
        """The 0-based offset of a window of a document that has ``count`` of them."""
        regular = window * self._step
        if self._rest is None:
            return regular
        return F.when((window > 0) & (window == count - 1), self._rest).otherwise(regular)

    def width(self, window: Column, count: Column) -> Column:
        rest = self._length - self.start(window, count)
        return F.when(window == count - 1, rest).otherwise(F.least(self._size, rest))


def _running_totals(values: Column, first: Column) -> Column:
    """``first``, ``first + v0``, ``first + v0 + v1``, ... over an array of bigint.

    Growing an array in a fold copies it at every step, so the fold runs over
    blocks of about sqrt(n) values and the blocks are put together at the end.
    """

    def totals(items: Column, start: Column) -> Column:
        return F.aggregate(
            items, F.array(start), lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
        )

    n = F.size(values)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(n / width).cast("int")),
        lambda b: F.slice(values, b * width + 1, width),
    )
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda a, v: a + v))
    heads = totals(sums, first)
    parts = F.transform(blocks, lambda b, i: F.slice(totals(b, heads[i]), 1, F.size(b)))
    return F.concat(F.flatten(parts), F.array(F.element_at(heads, -1)))


def _with_bytes(content: Column, use: Callable[[Column], Column]) -> Column:
    """``use(content)`` with the bytes fetched from the row once.

    Inside a lambda a BINARY column is copied out of the row at every element; as a
    lambda variable it is the same array each time.
    """
    return F.element_at(F.transform(F.array(content), use), 1)


def chunk_bytes(
    df: DataFrame,
    size: int = DEFAULT_CHUNK_SIZE,
    overlap: int = DEFAULT_CHUNK_OVERLAP,
    key: str = "path",
    content: str = "content",
    gate: str | None = "size",
) -> DataFrame:
    """Cut documents into windows of ``size`` bytes that overlap by ``overlap``.

    Only documents whose ``gate`` column exceeds ``size`` are cut (the original
    size, which differs from the content's after comment stripping); without a
    gate a short document gives one chunk. Each chunk is trimmed and ends with one
    line feed; tokens and lines are counted on the untrimmed bytes. A size of 0 means the
    default size.
    """
    require_non_negative(size=size, overlap=overlap)
    size = size or DEFAULT_CHUNK_SIZE
    # No filter on the content: it would be pushed below whatever computes the content
    # and compute it twice. Empty documents have no windows.
    docs = df if gate is None else df.where(F.col(gate) > F.lit(size))
    count, base = F.col("_count"), F.col("_base")
    windows = _Windows(F.col("_length"), size, overlap)
    first = F.lit(windows.per_block).cast("bigint")
    none = F.array().cast("array<bigint>")

    def upto(n: Column) -> Column:
        """0 to n - 1."""
        return F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(none)

    def lines_between(body: Column) -> Column:
        """Line feeds between each block's start and the next one's."""
        start = lambda b: windows.start(b * first, count)
        return F.transform(
            upto(F.col("_blocks") - 1),
            lambda b: text.newline_count(text.byte_slice(body, start(b), start(b + 1) - start(b))),
        )

    # First the blocks: an index and a line each, beside the document.
    placed = (
        docs.select(key, content, text.byte_length(F.col(content)).alias("_length"))
        .withColumn("_count", windows.count)
        .withColumn("_blocks", windows.blocks)
        .withColumn("_gaps", _with_bytes(F.col(content), lines_between))
        .withColumn("_lines", _running_totals(F.col("_gaps"), F.lit(1).cast("bigint")))
        .select(
            key, content, "_length", "_count",
            F.posexplode_outer(F.when(F.col("_blocks") > 0, F.col("_lines"))).alias("_number", "_line"),
        )
        .where(F.col("_line").isNotNull())
    )
    # A block's bytes are cut out of the document, which is then left behind.
    low = F.col("_number").cast("bigint") * first
    high = F.least(low + first, count)
    at = windows.start(low, count)
    end = windows.start(high - 1, count) + windows.width(high - 1, count)
    blocks = placed.select(
        key, "_length", "_count", "_line", low.alias("_low"), (high - low).alias("_in_block"), at.alias("_base"),
        text.byte_slice(F.col(content), at, end - at).alias("_span"),
    )

    def gaps(body: Column) -> Column:
        """Line feeds between each window's start and the next one's."""
        start = lambda k: windows.start(F.col("_low") + k, count)
        return F.transform(
            upto(F.col("_in_block") - 1),
            lambda k: text.newline_count(text.byte_slice(body, start(k) - base, start(k + 1) - start(k))),
        )

    def window(body: Column, line: Column, place: Column) -> Column:
        number = F.col("_low") + place
        start = windows.start(number, count)
        return F.struct(
            number.cast("int").alias("number"),
            start.alias("start"),
            line.alias("line"),
            text.byte_slice(body, start - base, windows.width(number, count)).alias("raw"),
        )

    cut = (
        blocks.withColumn("_gaps", _with_bytes(F.col("_span"), gaps))
        .withColumn("_lines", _running_totals(F.col("_gaps"), F.col("_line")))
        .select(
            key,
            F.explode_outer(
                _with_bytes(
                    F.col("_span"), lambda body: F.transform("_lines", lambda line, k: window(body, line, k))
                )
            ).alias("_window"),
        )
        .where(F.col("_window.raw").isNotNull())
    )
    raw, line = F.col("_window.raw"), F.col("_window.line")
    but_last = F.substring(raw, F.lit(1), F.octet_length(raw) - 1)
    return cut.select(
        key,
        F.col("_window.number").alias("chunk_idx"),
        F.col("_window.start").alias("start"),
        F.concat(text.trim_spaces(raw), F.lit(b"\n")).alias("content"),
        line.alias("start_line"),
        (line + text.newline_count(but_last)).alias("end_line"),
        text.token_count(text.as_text(raw)).alias("token_count"),
    )


def _cut(reading: Column, at_a_time: int = 1) -> Column:
    """A text cut into segments, line feeds included, or into runs of segments.

    Looking for the ">" of a tag that has none reads the rest of the text, and every
    line may start with such a tag. So the text is first parted at the end of the line
    of its last ">"; behind it only lines are left.
    """

    def pieces(text: Column, piece: str) -> Column:
        some = piece if at_a_time == 1 else f"(?:{piece}){{1,{at_a_time}}}+"
        return F.regexp_extract_all(text, F.lit(some), F.lit(0))

    behind = F.regexp_replace(F.substring_index(reading, ">", -1), r"\A[^\n]*+\n?", "")
    lines = F.when(reading.contains(">"), behind).otherwise(reading)
    tags = F.left(reading, F.length(reading) - F.length(lines))
    return F.concat(pieces(tags, _SEGMENT), pieces(lines, _LINE))


def _measured_blocks(reading: Column, measure: Callable[[Column], Column]) -> Column:
    """Measures of a text's segments, as an array of arrays, some hundred in each."""
    return F.transform(
        _cut(reading, 256),
        lambda block: F.transform(
            F.regexp_extract_all(block, F.lit(_SEGMENT), F.lit(0)), measure
        ),
    )


def split_segments(df: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """One row per segment: its text without the closing line feed, and its bytes.

    Where the rest of the document starts with ``<`` and a ``>`` follows, the segment
    ends there; otherwise it ends at the line feed.
    """
    reading = df.select(key, text.as_bytes_text(F.col(content)).alias("_reading"))
    segments = F.posexplode(_cut(F.col("_reading")))
    cut = reading.select(key, segments.alias("segment_idx", "_segment"))
    segment = F.col("_segment")
    return cut.select(
        key,
        "segment_idx",
        text.as_text(text.from_bytes_text(F.regexp_replace(segment, r"\n\z", ""))).alias("segment"),
        F.length(segment).cast("bigint").alias("size"),
    )


def pack_segments(
    df: DataFrame,
    size: int = DEFAULT_CHUNK_SIZE,
    max_tokens: int = DEFAULT_MAX_TOKENS,
    key: str = "path",
    content: str = "content",
) -> DataFrame:
    """Pack a document's segments greedily into chunks within a size and token budget.

    Before a segment is added the chunk is closed if it has reached ``size`` bytes,
    or if the segment would take it over ``max_tokens``. A chunk holds at least one
    segment; 0 switches a budget off.
    """
    require_non_negative(size=size, max_tokens=max_tokens)
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def measure(segment: Column) -> Column:
        return F.struct(
            F.octet_length(segment).cast("bigint").alias("size"),
            # A line feed can only close a segment, or stand inside a tag.
            text.newline_count(segment).alias("newlines"),
            text.token_count(segment).alias("tokens"),
        )

    def measure_bytes(segment: Column) -> Column:
        return measure(text.from_bytes_text(segment).cast("string"))

    # The cut only looks at ASCII, so it is the same in both readings; the second
    # one is for bytes that are not UTF-8.
    as_text = text.as_text(F.col(content))
    blocks = F.when(F.is_valid_utf8(as_text), _measured_blocks(as_text, measure)).otherwise(
        _measured_blocks(text.as_bytes_text(F.col(content)), measure_bytes)
    )

    def chunk(start: Column, line: Column, totals: Column) -> Column:
        return F.struct(
            start.alias("start"),
            line.alias("line"),
            *[totals[name].alias(name) for name in ("size", "newlines", "tokens")],
        )

    def add(acc: Column, segment: Column) -> Column:
        now = acc["now"]
        full = F.lit(False)
        if size > 0:
            full = full | (now["size"] >= F.lit(size))
        if max_tokens > 0:
            full = full | (now["tokens"] + segment["tokens"] > F.lit(max_tokens))
        closes = (now["size"] > 0) & full
        grown = F.struct(
            now["start"].alias("start"),
            now["line"].alias("line"),
            *[(now[n] + segment[n]).alias(n) for n in ("size", "newlines", "tokens")],
        )
        opened = chunk(now["start"] + now["size"], now["line"] + now["newlines"], segment)
        done = F.concat(acc["done"], F.array(now))
        return F.when(closes, F.struct(done.alias("done"), opened.alias("now"))).otherwise(
            F.struct(acc["done"].alias("done"), grown.alias("now"))
        )

    def add_block(acc: Column, block: Column) -> Column:
        # A fold copies its state at every step. Blocks keep the array of finished
        # chunks out of the state that is carried from segment to segment, and are
        # themselves kept whole until the end, so a chunk is copied once.
        fresh = F.struct(none.alias("done"), acc["now"].alias("now"))
        return F.aggregate(
            block,
            fresh,
            add,
            lambda r: F.struct(
                F.concat(acc["done"], F.array(r["done"])).alias("done"), r["now"].alias("now")
            ),
        )

    fields = "start bigint, line bigint, size bigint, newlines bigint, tokens bigint"
    none = F.array().cast(f"array<struct<{fields}>>")
    start = F.struct(
        F.array().cast(f"array<array<struct<{fields}>>>").alias("done"),
        F.struct(
            zero.alias("start"),
            one.alias("line"),
            *[zero.alias(name) for name in ("size", "newlines", "tokens")],
        ).alias("now"),
    )
    packed = (
        df.select(
            key,
            content,
            F.aggregate(
                blocks,
                start,
                add_block,
                lambda acc: F.when(
                    acc["now"]["size"] > 0, F.concat(F.flatten(acc["done"]), F.array(acc["now"]))
                ).otherwise(none),
            ).alias("_chunks"),
        )
        .select(
            key,
            F.posexplode_outer(
                _with_bytes(
                    F.col(content),
                    lambda body: F.transform(
                        "_chunks",
                        lambda c: F.struct(
                            c.alias("at"), text.byte_slice(body, c["start"], c["size"]).alias("raw")
                        ),
                    ),
                )
            ).alias("chunk_idx", "_chunk"),
        )
        .where(F.col("_chunk.raw").isNotNull())
    )
    raw, at = F.col("_chunk.raw"), F.col("_chunk.at")
    ends_line = F.substring(raw, F.octet_length(raw), F.lit(1)) == F.lit(b"\n")
    return packed.select(
        key,
        "chunk_idx",
        at["start"].alias("start"),
        raw.alias("content"),
        at["line"].alias("start_line"),
        (at["line"] + at["newlines"] - F.when(ends_line, 1).otherwise(0)).alias("end_line"),
        at["tokens"].alias("token_count"),
    )


def overlap_tail(
    df: DataFrame, overlap: int = DEFAULT_CHUNK_OVERLAP, content: str = "content"
) -> DataFrame:
    """Add ``overlap_tail``: the last ``overlap`` bytes, from after their first line feed."""
    require_non_negative(overlap=overlap)
    if overlap == 0:
        return df.withColumn("overlap_tail", F.lit(b""))
    body = F.col(content)
    first = F.greatest(F.lit(0).cast("bigint"), text.byte_length(body) - F.lit(overlap))
    tail = text.as_bytes_text(text.byte_slice(body, first, F.lit(overlap)))
    return df.withColumn(
        "overlap_tail", text.from_bytes_text(F.regexp_replace(tail, r"\A[^\n]*+\n", ""))
    )
