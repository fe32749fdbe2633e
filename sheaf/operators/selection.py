"""Selection state and the write buffer, as aggregations by path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def selection_state(toggles: DataFrame, path: str = "path") -> DataFrame:
    """Toggles per file and whether it ends up selected (an odd number of them).

    A count combines before the shuffle, so a file with a third of all toggles
    costs one partial row per task.
    """
    counted = toggles.groupBy(path).agg(F.count(F.lit(1)).alias("toggles"))
    return counted.withColumn("is_selected", F.col("toggles") % 2 == 1)


def apply_ops(
    ops: DataFrame,
    path: str = "path",
    op: str = "op",
    content: str = "content",
    order: tuple[str, ...] = ("ts", "seq"),
) -> DataFrame:
    """The buffer after all operations: the last write per path, unless removed later.

    ``op`` is 'write' or 'remove'; operations without a path are rejected. ``max_by``
    keeps one candidate per path and task before the shuffle, and a remove carries
    no content into it.
    """
    valid = ops.where(F.col(path) != "")
    last = valid.groupBy(path).agg(
        F.max_by(
            F.struct(
                F.col(op).alias("op"), F.when(F.col(op) == "write", F.col(content)).alias("content")
            ),
            F.struct(*order),
        ).alias("_last")
    )
    return last.where(F.col("_last.op") == "write").select(path, F.col("_last.content").alias(content))


def select_contents(files: DataFrame, selected: DataFrame, path: str = "path") -> DataFrame:
    """The selected files.

    No broadcast hint: the selection grows with the files, so Spark broadcasts its
    paths only within its own size limit and otherwise shuffles, with AQE splitting
    skewed partitions of the file side.
    """
    return files.join(selected.select(path), path, "left_semi")
