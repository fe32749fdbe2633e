"""Files of a directory tree as a table.

Spark's ``binaryFile`` source leaves out dot files, names that start with ``_`` and empty
files, so directories are listed here. It works in two steps so that neither the driver
nor one task has to hold or read the whole tree:

1. ``scan_tree`` lists level by level: the directories of a level are dealt out to all
   tasks, whose rows are written to the shared folder, and the directories among them are
   the next level. The driver opens no directory; it only counts.
2. ``read_contents`` reads. Size and ignore filters in between keep files from being
   opened at all.

The root is a path that every executor can reach, or the address of a store that Arrow's
file systems know (``s3://``, ``gs://``, ``hdfs://``, ``file://``).
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.globs import glob_to_regex
from sheaf.session import new_folder

LISTING_SCHEMA = "path string, size bigint, mod_time timestamp, error string"
_ARROW_LISTING = pa.schema(
    [
        ("path", pa.string()),
        ("size", pa.int64()),
        ("mod_time", pa.timestamp("us", tz="UTC")),
        ("error", pa.string()),
    ]
)
_ARROW_LEVEL = pa.schema([*_ARROW_LISTING, ("is_directory", pa.bool_())])
_LISTED_PER_BATCH = 10_000
_READ_BYTES_PER_BATCH = 8 * 1024 * 1024
_BYTES_PER_TASK = 128 * 1024 * 1024
_FILES_PER_TASK = 5_000
# A batch's contents have 31-bit offsets.
_MOST_BYTES = (1 << 31) - 1 - 32 * 1024 * 1024


def _send_code_along() -> None:
    """Pickle this package by value, so that executors need no copy of it.

    This holds for the whole process. Shipping the package with ``addArtifacts`` or
    ``--py-files`` is the usual way and does not hurt either.
    """
    cloudpickle.register_pickle_by_value(sys.modules["sheaf"])


class _Ignore:
    """The scan's ignore rule for single entries met on a walk."""

    def __init__(self, patterns: Iterable[str]):
        patterns = [p for p in patterns if p.strip()]
        regexes = [r for r in map(glob_to_regex, patterns) if r is not None]
        self._globs = re.compile("|".join(f"(?:{r})" for r in regexes)) if regexes else None
        self._prefixes = tuple(p[:-1] for p in patterns if p.endswith("/*"))

    def __call__(self, relative: str) -> bool:
        if self._globs is not None and self._globs.fullmatch(relative):
            return True
        return relative.startswith(self._prefixes)


def _is_address(root: str) -> bool:
    return "://" in root


def _failed(path: str, error: str) -> tuple:
    return (path, None, None, error, False)


def _entry(entry: os.DirEntry, relative: str) -> tuple:
    try:
        relative.encode()
    except UnicodeEncodeError:
        shown = os.fsencode(relative).decode("utf-8", "backslashreplace")
        return _failed(shown, "the name is not UTF-8")
    if entry.is_dir(follow_symlinks=False):
        return (relative, None, None, None, True)
    try:
        info = entry.stat()
    except OSError as error:
        return _failed(relative, f"stat error: {error.strerror}")
    if not entry.is_file():
        return _failed(relative, "not a regular file")
    return (relative, info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc), None, False)


def _local_entries(root: str, directory: str) -> Iterator[tuple]:
    with os.scandir(os.path.join(root, directory)) as entries:
        for entry in entries:
            yield _entry(entry, f"{directory}/{entry.name}" if directory else entry.name)


def _stored(root: str, path: str) -> tuple[fs.FileSystem, str]:
    """The store of an address, and what it calls the path; names need no escaping."""
    system, base = fs.FileSystem.from_uri(root)
    return system, f"{base.rstrip('/')}/{path}"


def _stored_entries(root: str, directory: str) -> Iterator[tuple]:
    system, base = _stored(root, directory)
    for info in system.get_file_info(fs.FileSelector(base)):
        relative = f"{directory}/{info.base_name}" if directory else info.base_name
        if info.type == fs.FileType.Directory:
            yield (relative, None, None, None, True)
        elif info.type == fs.FileType.File:
            yield (relative, info.size, info.mtime, None, False)
        else:
            yield _failed(relative, "not a regular file")


def _list_level(directories: DataFrame, root: str, ignored: _Ignore, max_size: int | None) -> DataFrame:
    """The entries of each of the directories; those that are directories are marked."""
    entries = _stored_entries if _is_address(root) else _local_entries

    def rows(directory: str) -> Iterator[tuple]:
        try:
            for row in entries(root, directory):
                large = max_size is not None and row[1] is not None and row[1] > max_size
                if not large and not ignored(row[0]):
                    yield row
        except (OSError, pa.ArrowException) as error:
            yield _failed(directory or ".", f"walk error: {getattr(error, 'strerror', None) or error}")

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for directory in batch.column(0).to_pylist():
                for row in rows(directory):
                    held.append(row)
                    if len(held) == _LISTED_PER_BATCH:
                        yield _batch(held)
                        held = []
        if held:
            yield _batch(held)

    return directories.select("path").mapInArrow(listed, f"{LISTING_SCHEMA}, is_directory boolean")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_LEVEL)]
    return pa.RecordBatch.from_arrays(columns, schema=_ARROW_LEVEL)


def scan_tree(
    spark: SparkSession,
    root: str,
    patterns: Iterable[str] = (),
    max_size: int | None = None,
    parts: int | None = None,
    directories: bool = False,
) -> DataFrame:
    """List the files below ``root``: path, size, mod_time, error.

    Ignored directories are not entered and too large files not listed. What cannot
    be read, a name that is not UTF-8 included, becomes a row with ``error`` and the scan
    goes on. A level is listed in at most ``parts`` tasks; the listing is done when this
    returns and lies in the shared folder. With ``directories`` they are rows as well,
    without a size, and ``is_directory`` tells.
    """
    _send_code_along()
    ignored = _Ignore(patterns)
    folder = new_folder(spark, "listing")
    parts = parts or 4 * spark.sparkContext.defaultParallelism
    start = [] if ignored(".") else [("",)]
    opened, count, level = spark.createDataFrame(start, "path string"), 1, 0
    while count:
        dealt = opened.repartition(min(parts, count))
        _list_level(dealt, root, ignored, max_size).write.parquet(f"{folder}/{level}")
        entries = spark.read.parquet(f"{folder}/{level}")
        opened = entries.where("is_directory")
        count, level = opened.count(), level + 1
    found = spark.read.parquet(*[f"{folder}/{n}" for n in range(level)])
    return found if directories else found.where("NOT is_directory").drop("is_directory")


def _read(root: str, path: str) -> bytes:
    if _is_address(root):
        system, name = _stored(root, path)
        with system.open_input_stream(name) as file:
            return file.read()
    with open(os.path.join(root, path), "rb") as file:
        return file.read()


def read_contents(
    files: DataFrame, root: str, partitions: int | None = None, in_place: bool = False
) -> DataFrame:
    """Add ``content`` to listed files; a file that cannot be read gets an ``error``.

    Files are spread over ``partitions`` tasks, by default one for every 128 MB or 5,000 files listed;
    ``in_place`` reads them in the partitions, and the order, that they are in. A row
    cannot hold a file of 2 GiB or more, which therefore gets an error as well.
    """
    _send_code_along()
    schema = pa.schema([*_ARROW_LISTING, ("content", pa.binary())])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                row["content"] = None
                if row["error"] is None and (row["size"] or 0) > _MOST_BYTES:
                    row["error"] = "read error: too large for a row"
                if row["error"] is None:
                    try:
                        row["content"] = _read(root, row["path"])
                    except (OSError, ValueError, pa.ArrowException) as error:
                        row["error"] = f"read error: {getattr(error, 'strerror', None) or error}"
                size = len(row["content"] or b"")
                if size > _MOST_BYTES:  # it grew since it was listed
                    row["content"], row["error"], size = None, "read error: too large for a row", 0
                # Batches are closed by bytes: contents differ by six orders of magnitude.
                if rows and held + size > _READ_BYTES_PER_BATCH:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
                rows.append(row)
                held += size
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = files.select("path", "size", "mod_time", "error")
    if not in_place:
        if partitions is None:
            total, count = listed.agg(F.sum("size"), F.count(F.lit(1))).first()
            least = files.sparkSession.sparkContext.defaultParallelism
            partitions = max(least, -(-(total or 0) // _BYTES_PER_TASK), -(-count // _FILES_PER_TASK))
        listed = listed.repartition(partitions, F.xxhash64("path", "size"))
    return listed.mapInArrow(read, f"{LISTING_SCHEMA}, content binary")
