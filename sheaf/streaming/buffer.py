"""The write buffer kept up to date from a stream of writes and removes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sheaf.operators.selection import apply_ops
from sheaf.sources.tree import _send_code_along


BUCKETS = 1024
"""Groups that paths are handled in. A checkpoint is bound to their number."""
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LatestWrite(StatefulProcessor):
    """The last operation of each path of a bucket; gives out what changes the buffer.

    A remove leaves its place in the order behind, so that a write that comes late does not
    bring the content back. Of operations at one place the one that came first counts.
    """

    def __init__(self, kind: str) -> None:
        self._kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._last = handle.getMapState("last", "path string", f"ts bigint, seq bigint, content {self._kind}, held boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest: dict[str, tuple] = {}
        for frame in rows:
            for path, ts, seq, op, text in zip(frame["path"], frame["ts"], frame["seq"], frame["op"], frame["content"]):
                place = (int(ts), int(seq))
                if path not in latest or place > latest[path][0]:
                    latest[path] = place, op == "write", text
        changes = [change for path, last in latest.items() if (change := self._changed(path, *last))]
        if changes:
            columns = dict(zip(("path", "op", "content", "ts", "seq"), zip(*changes)))
            columns["content"] = pd.Series(columns["content"], dtype=object)
            yield pd.DataFrame(columns)

    def _changed(self, path: str, place: tuple[int, int], write: bool, new) -> tuple | None:
        known = self._last.getValue((path,))
        if known is not None and place <= (known[0], known[1]):
            return None
        held = known is not None and bool(known[3])
        self._last.updateValue((path,), (*place, new if write else None, write))
        if write and (not held or new != known[2]):
            return path, "write", new, *place
        if held and not write:
            return path, "remove", None, *place
        return None

    def close(self) -> None:
        pass


def buffer_stream(
    ops: DataFrame,
    path: str = "path",
    op: str = "op",
    content: str = "content",
    order: tuple[str, str] = ("ts", "seq"),
) -> DataFrame:
    """path, op, content, ts (microseconds) and seq of the operations that change the buffer.

    ``ops`` is a stream in any order, with a time and a number to order by. Operations
    without a path, time or number are rejected. The state is one row per path, in RocksDB;
    paths are handled by buckets, since a group costs far more time than a row. A query
    started by other means than ``write_buffer`` has to name RocksDB as its state store.
    """
    _send_code_along()
    kind = ops.schema[content].dataType.simpleString()
    ts, seq = order
    time = F.col(ts).cast("bigint")
    if ops.schema[ts].dataType.typeName() == "timestamp":
        time = F.unix_micros(ts)
    elif ops.schema[ts].dataType.typeName() == "timestamp_ntz":
        time = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{ts}`)")
    rows = ops.select(
        F.col(path).alias("path"),
        time.alias("ts"),
        F.col(seq).cast("bigint").alias("seq"),
        F.col(op).alias("op"),
        F.when(F.col(op) == "write", F.col(content)).alias("content"),
    ).where("path <> '' AND ts IS NOT NULL AND seq IS NOT NULL")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(BUCKETS)))
    return rows.groupBy("bucket").transformWithStateInPandas(
        LatestWrite(kind),
        f"path string, op string, content {kind}, ts bigint, seq bigint",
        outputMode="Update",
        timeMode="None",
    )


def write_buffer(changes: DataFrame, folder: str, checkpoint: str) -> None:
    """Write what each micro-batch changed, then stop when nothing is left.

    A batch overwrites its own folder, so a batch run again leaves no second copy. The
    state is kept in RocksDB, whatever the session's own store is.
    """
    conf = changes.sparkSession.conf
    own = conf.get(_STORE)
    conf.set(_STORE, _ROCKSDB)

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    try:
        query = (
            changes.writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set(_STORE, own)


def read_buffer(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of the buffer: the last change of each path, unless it is a remove."""
    return apply_ops(spark.read.parquet(folder))
