"""Files in the order of their paths, with contents moved once."""

from __future__ import annotations

import json
from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTES_PER_PART = 128 << 20
_WITHIN = (1 << 33) - 1  # the bits that count the rows of a partition in Spark's increasing id


def _rank(key: Column, bounds: list[tuple[str | None, int]]) -> Column:
    """How many of the sorted bounds are not above the key; two short searches a row."""
    width = max(1, isqrt(len(bounds)))
    kind = "array<struct<path: string, tie: bigint>>"

    def array(items: list) -> Column:
        # One literal, which Spark folds into an array once.
        return F.from_json(F.lit(json.dumps([{"path": p, "tie": t} for p, t in items])), kind)

    coarse = F.size(F.filter(array(bounds[width - 1 :: width]), lambda b: b <= key)) * width
    fine = F.slice(array(bounds), coarse + 1, F.lit(width))
    return coarse + F.size(F.filter(fine, lambda b: b <= key))


def in_path_order(
    files: DataFrame, parts: int | None = None, path: str = "path", size: str = "size", position: str = "position"
) -> DataFrame:
    """Files partitioned and sorted by path, with their 0-based place in that order.

    The ranges are found on paths and sizes alone, so contents are read once, go straight to
    their partition, and nothing samples them; the places follow from the counts of the
    ranges. ``parts`` is by default one for every 128 MB of ``size``. Files with one path lie
    in the order of a hash of path and size.
    """
    # A struct's nulls come first, as they do in Spark's sorting.
    tie = F.xxhash64(path, size)
    keys = files.select(F.struct(F.col(path).alias("path"), tie.alias("tie")).alias("key"), F.col(size).alias("size"))
    if parts is None:
        total = keys.agg(F.sum("size")).first()[0] or 0
        parts = max(files.sparkSession.sparkContext.defaultParallelism, -(-total // _BYTES_PER_PART))
    ranges = keys.select("key").repartitionByRange(parts, "key").groupBy(F.spark_partition_id().alias("part"))
    found = sorted(ranges.agg(F.min("key").alias("key"), F.count(F.lit(1)).alias("n")).collect())
    bounds = [(row["key"]["path"], row["key"]["tie"]) for row in found[1:]]
    starts = [0, *accumulate(row["n"] for row in found)][:-1] or [0]
    offsets = F.from_json(F.lit(json.dumps(starts)), "array<bigint>")
    key = F.struct(F.col(path).alias("path"), tie.alias("tie"))
    placed = files.withColumn("_part", _rank(key, bounds)).repartitionById(len(starts), "_part")
    ordered = placed.sortWithinPartitions(key)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))
    return ordered.withColumn(position, F.get(offsets, F.col("_part")) + row).drop("_part")
