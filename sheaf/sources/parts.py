"""Files of any size as rows of byte ranges.

A row cannot hold 2 GiB, and one task should not read a terabyte. So a file is dealt out as
parts, each read on its own by a ranged request, wherever it lies in the file. Parts are
cut at characters, so that a part can be read as text, or else at line ends.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.sources.tree import (
    _ARROW_LISTING,
    _BYTES_PER_TASK,
    _MOST_BYTES,
    _READ_BYTES_PER_BATCH,
    LISTING_SCHEMA,
    _is_address,
    _send_code_along,
    _stored,
)

PART_BYTES = 64 << 20
_PARTS_PER_TASK = 10_000
_LOOK_AHEAD = 64 << 10
_LONGEST_TAIL = 3  # bytes of a character after its first


def _parts_of(part_bytes: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.coalesce("size", F.lit(0)) / F.lit(part_bytes)))


def list_parts(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """Listed files with ``part`` and ``offset``: a row for every ``part_bytes`` bytes.

    An empty file has one part, and so has a row with an error.
    """
    if part_bytes <= _LONGEST_TAIL:
        raise ValueError(f"a part has more than {_LONGEST_TAIL} bytes")
    number = F.explode(F.sequence(F.lit(0), (_parts_of(part_bytes) - 1).cast("int"))).alias("part")
    rows = files.select("path", "size", "mod_time", "error", number)
    return rows.withColumn("offset", F.col("part") * F.lit(part_bytes).cast("bigint"))


def _opened(root: str, path: str):
    if _is_address(root):
        system, name = _stored(root, path)
        return system.open_input_file(name)
    return open(os.path.join(root, path), "rb")


def _range(file, start: int, length: int) -> bytes:
    file.seek(start)
    return file.read(length)


def _characters(file, start: int, end: int, size: int) -> tuple[int, bytes]:
    """The part's bytes, from the first whole character on to the end of its last one."""
    data = _range(file, start, end - start + _LONGEST_TAIL)

    def boundary(at: int) -> int:
        for k in range(at, min(at + _LONGEST_TAIL, len(data))):
            if data[k] & 0xC0 != 0x80:
                return k
        return min(at + _LONGEST_TAIL, len(data))

    low = boundary(0) if start else 0
    return start + low, data[low : boundary(end - start)] if end < size else data[low : end - start]


def _line_end(file, at: int, size: int, most: int) -> int | None:
    """The place after the first line feed from ``at`` on; None if it is over ``most`` away."""
    start = at
    while at < size and at - start <= most:
        some = _range(file, at, _LOOK_AHEAD)
        found = some.find(b"\n")
        if found >= 0:
            return at + found + 1
        if not some:
            return at
        at += len(some)
    return size if at >= size else None


def _lines(file, start: int, end: int, size: int, most: int) -> tuple[int, bytes]:
    """The lines that start in the part; a line goes with the part it starts in."""
    low = start
    if start:
        found = _line_end(file, start - 1, end, end - start)
        low = end if found is None else found
        if low >= end and (end >= size or _range(file, end - 1, 1) != b"\n"):
            return low, b""
    high = size if end >= size else _line_end(file, end - 1, size, most)
    if high is None or high - low > most:
        raise ValueError("a line is too long for a row")
    return low, _range(file, low, high - low)


def read_parts(
    files: DataFrame,
    root: str,
    part_bytes: int = PART_BYTES,
    whole_lines: bool = False,
    most_bytes: int = _MOST_BYTES,
) -> DataFrame:
    """path, size, mod_time, error, part, offset and content of the parts of listed files.

    In order, the contents are the file. With ``whole_lines`` every part holds the lines
    that start in it, and some parts may be empty; a part whose lines have more than
    ``most_bytes`` gets an error. Each part is read by a request of its own, so files of
    any size are spread over all tasks, none of which reads many more than 10,000 parts.
    """
    _send_code_along()
    schema = pa.schema([*_ARROW_LISTING, ("part", pa.int32()), ("offset", pa.int64()), ("content", pa.binary())])

    def part_of(row: dict) -> tuple[int, bytes]:
        start = row["offset"]
        end = min(row["size"], start + part_bytes)
        with _opened(root, row["path"]) as file:
            if whole_lines:
                return _lines(file, start, end, row["size"], most_bytes)
            return _characters(file, start, end, row["size"])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                row["content"] = None
                if row["error"] is None:
                    try:
                        row["offset"], row["content"] = part_of(row)
                    except (OSError, ValueError, pa.ArrowException) as error:
                        row["error"] = f"read error: {getattr(error, 'strerror', None) or error}"
                size = len(row["content"] or b"")
                if rows and held + size > _READ_BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
                rows.append(row)
                held += size
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    size, count = files.agg(F.sum("size"), F.sum(_parts_of(part_bytes))).first()
    least = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(least, -(-(size or 0) // _BYTES_PER_TASK), -(-(count or 0) // _PARTS_PER_TASK))
    dealt = list_parts(files, part_bytes).repartition(tasks, F.xxhash64("path", "part"))
    return dealt.mapInArrow(read, f"{LISTING_SCHEMA}, part int, offset bigint, content binary")
