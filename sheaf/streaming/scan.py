"""Documents handled as they arrive.

Filters, flags, languages, comment stripping, counts, chunks and line search are
projections, so they take a streaming DataFrame exactly as they take a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def scan_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType | str,
    format: str = "parquet",
    files: str | None = None,
    max_files_per_trigger: int = 1000,
    table: str | None = None,
) -> DataFrame:
    """New files of ``folder`` as a stream; ``files`` is a glob on their names.

    ``table`` names one table of the folder, which may be a file or a folder of files.
    """
    reader = spark.readStream.schema(schema).format(format)
    if files is not None:
        reader = reader.option("pathGlobFilter", files)
    if table is not None:
        # Spark streams a single file only if it is named by a glob.
        folder = f"{folder}/{{{table}}}"
    return reader.option("maxFilesPerTrigger", max_files_per_trigger).load(folder)


def write_available(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Append what has arrived to a parquet table, exactly once, and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", folder)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
