"""Row filters and flags on a table of files (path, size, content, ...)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.constants import (
    BINARY_SAMPLE_BYTES,
    DEFAULT_IGNORE_PATTERNS,
    DEFAULT_MAX_FILE_SIZE,
)
from sheaf.functions.globs import scan_ignored, tree_ignored
from sheaf.functions.text import is_binary
from sheaf.options import require_non_negative
from sheaf.session import new_folder


def filter_size(
    df: DataFrame, max_size: int | None = DEFAULT_MAX_FILE_SIZE, size: str = "size"
) -> DataFrame:
    """Drop files larger than ``max_size`` bytes; None keeps them all."""
    require_non_negative(max_size=max_size)
    return df if max_size is None else df.where(F.col(size) <= F.lit(max_size))


def over_size(df: DataFrame, max_size: int = DEFAULT_MAX_FILE_SIZE, size: str = "size") -> DataFrame:
    """What ``filter_size`` leaves out, as one row: how many files, and their bytes."""
    large = df.where(F.col(size) > F.lit(max_size))
    return large.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def filter_ignored(
    df: DataFrame, patterns: Iterable[str] = DEFAULT_IGNORE_PATTERNS, path: str = "path"
) -> DataFrame:
    """Drop files the scan's ignore patterns name, and whole ignored directories."""
    return df.where(~scan_ignored(F.col(path), patterns))


def filter_tree_ignored(
    df: DataFrame, patterns: Iterable[str] = DEFAULT_IGNORE_PATTERNS, path: str = "path"
) -> DataFrame:
    """Drop paths the directory tree leaves out (a different rule from the scan's)."""
    return df.where(~tree_ignored(F.col(path), patterns))


def cap_files(df: DataFrame, n: int, path: str = "path") -> DataFrame:
    """Keep the ``n`` files with the smallest paths; 0 keeps all.

    The cut is found first, on paths alone: they are range-partitioned and counted, and
    only the partition with the n-th path is looked into, so no task holds n paths. Then
    it is a predicate on the path. Of files that share the path of the cut, any are kept.
    """
    require_non_negative(n=n)
    if n == 0:
        return df
    folder = new_folder(df.sparkSession, "cap")
    paths = df.select(F.col(path).alias("path")).where("path IS NOT NULL")
    parts = paths.repartitionByRange("path").withColumn("part", F.spark_partition_id())
    parts.write.parquet(folder)
    placed = df.sparkSession.read.parquet(folder)
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    left = n
    for row in counts:
        if row["n"] >= left:
            break
        left -= row["n"]
    else:
        return df.where(F.col(path).isNotNull())
    inside = placed.where(F.col("part") == row["part"]).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    cut = cut.where((F.col("before") < left) & (F.col("before") + F.col("n") >= left)).first()
    smaller = df.where(F.col(path) < F.lit(cut["path"]))
    return smaller.unionByName(df.where(F.col(path) == F.lit(cut["path"])).limit(left - cut["before"]))


def with_is_binary(
    df: DataFrame, content: str = "content", sample_bytes: int = BINARY_SAMPLE_BYTES
) -> DataFrame:
    return df.withColumn("is_binary", is_binary(F.col(content), sample_bytes))


def processable(is_binary: str = "is_binary", size: str = "size"):
    return ~F.col(is_binary) & (F.col(size) > 0)


def gate_processable(df: DataFrame, content: str = "content") -> DataFrame:
    """Keep binary and empty files as rows, but without content and language."""
    gated = {content: F.when(processable(), F.col(content))}
    if "language" in df.columns:
        gated["language"] = F.when(processable(), F.col("language"))
    return df.withColumns(gated)
