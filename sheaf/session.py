"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_folder: dict[str, str] = {}


def build_session(master: str | None = None, app_name: str = "sheaf", **conf: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC.

    On a cluster leave ``master`` out and size ``spark.sql.shuffle.partitions``
    for about 128 MB of shuffled data per partition; AQE merges what is too small.
    Files may hold 4 MiB each, so the parquet reader takes fewer rows at a time than
    its default 4096: the largest batch of contents is 1 GiB instead of 16.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.parquet.columnarReaderBatchSize": "256",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Streaming state on disk: it grows with the files, not with the heap.
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state"
        ".RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named in ``spark.checkpoint.dir``.

    Where it is unset a local run gets a folder of its own; a cluster run has to
    name one, because a folder on one machine would lose data with that machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _own_folder:
        _own_folder[context.applicationId] = tempfile.mkdtemp(prefix="sheaf-")
    return _own_folder[context.applicationId]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
