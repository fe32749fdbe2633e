"""Tables of documents stored as files Spark reads itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, path: str, spread_by: tuple[str, ...] = ()) -> DataFrame:
    """Read a parquet table.

    ``spread_by`` names the columns of a key, for text work, which is bound by CPU. A
    table no larger than one split, which one task would read whatever the cluster's
    size, is then dealt out to all cores by the key. Any larger table is read as it is:
    its splits keep executors busy, and its texts are not shuffled.
    """
    df = spark.read.parquet(path)
    if spread_by and _size(df) <= _split_size(spark):
        return df.repartition(spark.sparkContext.defaultParallelism, *spread_by)
    return df


def _size(df: DataFrame) -> int:
    """Bytes of the table's files, from their listing."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def _split_size(spark: SparkSession) -> int:
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return int(bytes_of(spark.conf.get("spark.sql.files.maxPartitionBytes")))
