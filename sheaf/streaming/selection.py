"""Selection state kept up to date from a stream of toggles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.operators.selection import selection_state


def selection_stream(toggles: DataFrame, path: str = "path") -> DataFrame:
    """Running toggle count and selection per file, on a streaming DataFrame.

    The state is one count per file and does not depend on the order of toggles, so
    late ones need no watermark.
    """
    return selection_state(toggles, path)


def write_selection(selection: DataFrame, folder: str, checkpoint: str) -> None:
    """Write the files each micro-batch changed, then stop when nothing is left.

    A batch overwrites its own folder, so a batch run again after a failure leaves
    no second copy.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batches/batch={batch}")

    query = (
        selection.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()


def _latest_base(spark: SparkSession, folder: str) -> int | None:
    """The last batch that a finished base holds, if there is a base."""
    bases = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bases")
    files = bases.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(bases):
        return None
    done = [
        int(status.getPath().getName().partition("=")[2])
        for status in files.listStatus(bases)
        if files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


def read_selection(spark: SparkSession, folder: str, path: str = "path") -> DataFrame:
    """The latest state per file: counts only grow, so it is the largest one written.

    Only the latest base and the batches after it are read.
    """
    batches = spark.read.parquet(f"{folder}/batches")
    base = _latest_base(spark, folder)
    rows = batches if base is None else batches.where(F.col("batch") > base)
    rows = rows.select(path, "toggles")
    if base is not None:
        rows = rows.unionByName(spark.read.parquet(f"{folder}/bases/base={base}").select(path, "toggles"))
    latest = rows.groupBy(path).agg(F.max("toggles").alias("toggles"))
    return latest.withColumn("is_selected", F.col("toggles") % 2 == 1)


def compact_selection(spark: SparkSession, folder: str, path: str = "path") -> None:
    """Write the state as a base, so that reading does not go through all batches again.

    A base counts once it is whole. Batches stay, for a reader that has begun; they are
    pruned by their number.
    """
    last = spark.read.parquet(f"{folder}/batches").agg(F.max("batch")).first()[0]
    if last is not None and last != _latest_base(spark, folder):
        read_selection(spark, folder, path).write.mode("overwrite").parquet(f"{folder}/bases/base={last}")
