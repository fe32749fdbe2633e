"""A directory tree as a Spark data source: ``spark.read.format("file_tree").load(root)``.

Conditions on ``path`` and ``size`` in SQL or on the frame prune the walk itself: a directory
below which no path can meet them is never opened, and a file that does not meet them is
neither a row nor read. The planner opens directories from the top until there are enough
subtrees to deal out; tasks walk these.

As a stream the source gives every file once, when it appears or changes anywhere below the
root. An offset is a time, and a batch the files that changed between two of them, so a
batch that runs again lists the same files, and nothing has to be remembered of those seen.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

from sheaf.sources.tree import (
    _ARROW_LISTING,
    _LISTED_PER_BATCH,
    _MOST_BYTES,
    _READ_BYTES_PER_BATCH,
    LISTING_SCHEMA,
    _failed,
    _Ignore,
    _is_address,
    _local_entries,
    _read,
    _send_code_along,
    _stored_entries,
)

_SUBTREES_PER_PART = 4


def register_tree(spark: SparkSession) -> None:
    """Make the format known to the session, with conditions pushed down to it."""
    _send_code_along()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)


@dataclass(frozen=True)
class _Condition:
    """A condition on one column, and whether paths below a directory may meet it."""

    column: str
    holds: Callable[[object], bool]
    below: Callable[[str], bool]


def _always(_: object) -> bool:
    return True


def _condition(pushed: ds.Filter) -> _Condition | None:
    """The condition a filter stands for; None for one that Spark has to look at.

    Paths are compared by code point, as Spark compares the bytes. ``below`` is given a
    directory with its closing slash, with which all paths below it start.
    """
    column = getattr(pushed, "attribute", ("",))
    if column not in (("path",), ("size",)):
        return None
    name, value = column[0], getattr(pushed, "value", None)
    if isinstance(pushed, ds.IsNotNull):
        return _Condition(name, _always, _always)
    if value is None or (isinstance(pushed, ds.In) and None in value):
        return None
    kinds: dict[type, tuple[Callable, Callable]] = {
        ds.EqualTo: (lambda x: x == value, lambda d: value.startswith(d)),
        ds.In: (lambda x: x in value, lambda d: any(v.startswith(d) for v in value)),
        ds.GreaterThan: (lambda x: x > value, lambda d: d > value or value.startswith(d)),
        ds.GreaterThanOrEqual: (lambda x: x >= value, lambda d: d > value or value.startswith(d)),
        ds.LessThan: (lambda x: x < value, lambda d: d < value),
        ds.LessThanOrEqual: (lambda x: x <= value, lambda d: d < value),
        ds.StringStartsWith: (lambda x: x.startswith(value), lambda d: d.startswith(value) or value.startswith(d)),
        ds.StringEndsWith: (lambda x: x.endswith(value), _always),
        ds.StringContains: (lambda x: value in x, _always),
    }
    if type(pushed) not in kinds:
        return None
    holds, below = kinds[type(pushed)]
    return _Condition(name, holds, below if name == "path" else _always)


@dataclass
class _Subtrees(ds.InputPartition):
    """Directories to list, and whether to go on below each of them."""

    directories: list[tuple[str, bool]]


class _Walk:
    """Listing of a root under ignore patterns and conditions."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = options["path"]
        self.contents = options.get("contents", "false").lower() == "true"
        self.parts = int(options.get("parts", "32"))
        patterns = options.get("patterns", "")
        self.ignored = _Ignore(patterns.split("\n") if patterns else ())
        self.conditions: list[_Condition] = []

    def push(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for pushed in filters:
            condition = _condition(pushed)
            if condition is None:
                yield pushed
            else:
                self.conditions.append(condition)

    def _may_hold(self, directory: str) -> bool:
        return all(c.below(f"{directory}/") for c in self.conditions if c.column == "path")

    def _meets(self, row: tuple) -> bool:
        values = {"path": row[0], "size": row[1]}
        return all(values[c.column] is not None and c.holds(values[c.column]) for c in self.conditions)

    def entries(self, directory: str) -> tuple[list[str], Iterator[tuple]]:
        """The directories that are worth entering, and the rows of a directory."""
        inner: list[str] = []

        def rows() -> Iterator[tuple]:
            find = _stored_entries if _is_address(self.root) else _local_entries
            try:
                for row in find(self.root, directory):
                    if self.ignored(row[0]):
                        continue
                    if row[4]:
                        if self._may_hold(row[0]):
                            inner.append(row[0])
                    elif self._meets(row):
                        yield row[:4]
            except (OSError, pa.ArrowException) as error:
                row = _failed(directory or ".", f"walk error: {getattr(error, 'strerror', None) or error}")
                if self._meets(row):
                    yield row[:4]

        return inner, rows()

    def subtrees(self) -> list[_Subtrees]:
        """The tree in parts: directories are opened from the top until there are enough."""
        open_, done = ([] if self.ignored(".") else [""]), []
        while open_ and len(open_) < _SUBTREES_PER_PART * self.parts:
            inner: list[str] = []
            for k, directory in enumerate(open_):
                if len(inner) + len(open_) - k >= _SUBTREES_PER_PART * self.parts:
                    inner += open_[k:]
                    break
                found, rows = self.entries(directory)
                for _ in rows:
                    pass
                done.append(directory)
                inner += found
            if inner == open_:
                break
            open_ = inner
        dealt = [(d, False) for d in done] + [(d, True) for d in open_]
        return [_Subtrees(dealt[k :: self.parts]) for k in range(min(self.parts, len(dealt)))]

    def rows(self, part: _Subtrees) -> Iterator[tuple]:
        for directory, deep in part.directories:
            left = [directory]
            while left:
                inner, rows = self.entries(left.pop())
                yield from rows
                if deep:
                    left += inner

    def batches(self, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([*_ARROW_LISTING, ("content", pa.binary())] if self.contents else _ARROW_LISTING)
        held: list[tuple] = []
        size = 0
        for row in rows:
            if self.contents:
                row = self._with_content(row)
                size += len(row[4] or b"")
            held.append(row)
            if len(held) == _LISTED_PER_BATCH or size > _READ_BYTES_PER_BATCH:
                yield _batch(held, schema)
                held, size = [], 0
        if held:
            yield _batch(held, schema)

    def _with_content(self, row: tuple) -> tuple:
        path, size, mod_time, error = row
        content = None
        if error is None and size > _MOST_BYTES:
            error = "read error: too large for a row"
        elif error is None:
            try:
                content = _read(self.root, path)
            except (OSError, ValueError, pa.ArrowException) as failure:
                error = f"read error: {getattr(failure, 'strerror', None) or failure}"
        return path, size, mod_time, error, content


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class TreeSource(ds.DataSource):
    """Options: ``path`` (the root), ``patterns`` (one a line), ``parts``, ``contents``, ``settle``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        contents = self.options.get("contents", "false").lower() == "true"
        return f"{LISTING_SCHEMA}, content binary" if contents else LISTING_SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStreamReader:
        return TreeStreamReader(self.options)


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.walk = _Walk(options)

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        yield from self.walk.push(filters)

    def partitions(self) -> list[_Subtrees]:
        return self.walk.subtrees() or [_Subtrees([])]

    def read(self, partition: _Subtrees) -> Iterator[pa.RecordBatch]:
        yield from self.walk.batches(self.walk.rows(partition))


@dataclass
class _Changed(_Subtrees):
    after: int
    until: int


class TreeStreamReader(ds.DataSourceStreamReader):
    """Files by the time of their last change, in microseconds.

    That time is the system's own for a local tree, so files that are moved in or keep an old
    date count as new, and the upload's for a store. A batch ends ``settle`` seconds (1 unless
    set) before now, which has to cover what clocks differ by. What cannot be read as a
    directory entry has no such time and is left out.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.walk = _Walk(options)
        self.settle = int(float(options.get("settle", "1")) * 1_000_000)

    def initialOffset(self) -> dict:
        return {"microseconds": 0}

    def latestOffset(self) -> dict:
        return {"microseconds": time.time_ns() // 1000 - self.settle}

    def partitions(self, start: dict, end: dict) -> list[_Changed]:
        span = start["microseconds"], end["microseconds"]
        return [_Changed(part.directories, *span) for part in self.walk.subtrees()] or [_Changed([], *span)]

    def read(self, partition: _Changed) -> Iterator[pa.RecordBatch]:
        rows = self.walk.rows(partition)
        yield from self.walk.batches(r for r in rows if self._in(r, partition))

    def _in(self, row: tuple, part: _Changed) -> bool:
        if row[3] is not None:
            return False
        if _is_address(self.walk.root):
            changed = int(row[2].timestamp() * 1_000_000)
        else:
            try:
                changed = os.stat(os.path.join(self.walk.root, row[0])).st_ctime_ns // 1000
            except OSError:
                return False  # it is gone
        return part.after < changed <= part.until

    def commit(self, end: dict) -> None:
        pass
