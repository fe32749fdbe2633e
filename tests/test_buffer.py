"""The streamed write buffer equals the one of all operations at once."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from sheaf.operators.selection import apply_ops
from sheaf.streaming.buffer import LatestWrite, buffer_stream, read_buffer, write_buffer

SCHEMA = "path string, op string, content string, ts timestamp, seq bigint"
OPS = "path string, op string, content string, ts bigint, seq bigint"


def random_ops(seed: int, n: int = 120):
    r = random.Random(seed)
    rows = [
        (r.choice(["a", "b", "c/d", "é", "", None]), r.choice(["write", "write", "remove"]), r.choice(["x", "y", "", None]),
         r.randint(0, 30), seq)
        for seq in range(n)
    ]
    r.shuffle(rows)  # late ones among them
    return rows


def changes_of(batches):
    """What a sequential buffer changes in each batch."""
    state, out = {}, []
    for batch in batches:
        shown = {p: s for p, s in state.items()}
        for path, op, content, ts, seq in batch:
            if path and (path not in state or (ts, seq) > state[path][0]):
                state[path] = ((ts, seq), op == "write", content if op == "write" else None)
        for path, (place, held, content) in state.items():
            _, was, old = shown.get(path, (None, False, None))
            if (held, content) != (was, old):
                out.append((path, "write" if held else "remove", content, *place))
    return out


@pytest.mark.parametrize("seed, parts", [(1, 1), (2, 3), (3, 6)])
def test_any_split_into_batches(spark, tmp_path, seed, parts):
    rows = random_ops(seed)
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    cuts = sorted(random.Random(seed).choices(range(len(rows)), k=parts - 1))
    batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
    for batch in batches:  # each batch is a run that goes on from the checkpoint
        spark.createDataFrame(batch, OPS).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(OPS).parquet(folder)
        write_buffer(buffer_stream(stream), out, checkpoint)
        so_far = [r for b in batches[: batches.index(batch) + 1] for r in b]
        want = apply_ops(spark.createDataFrame(so_far, OPS)).collect()
        assert sorted(read_buffer(spark, out).collect(), key=str) == sorted(want, key=str)
    written = spark.read.parquet(out).select("path", "op", "content", "ts", "seq").collect()
    assert sorted(map(tuple, written), key=str) == sorted(changes_of(batches), key=str)


def test_times_and_binary_contents(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    ops = spark.sql(
        """SELECT * FROM VALUES ('a', 'write', x'FF00', TIMESTAMP '2024-01-01 00:00:01.5', 1L),
           ('a', 'remove', null, TIMESTAMP '2024-01-01 00:00:01.4', 2L),
           ('b', 'write', x'01', TIMESTAMP '2024-01-01 00:00:00', 3L), ('b', 'write', x'02', null, 4L)
           AS t(path, op, content, ts, seq)"""
    )
    ops.write.parquet(folder)
    stream = spark.readStream.schema(ops.schema).parquet(folder)
    write_buffer(buffer_stream(stream), out, checkpoint)
    assert {r.path: bytes(r.content) for r in read_buffer(spark, out).collect()} == {"a": b"\xff\x00", "b": b"\x01"}


def test_paths_of_a_bucket_are_handled_together():
    known = {}

    class Handle:
        def getMapState(self, *_):
            return type("State", (), {"getValue": lambda _, k: known.get(k), "updateValue": lambda _, k, v: known.update({k: v})})()

    latest = LatestWrite("string")
    latest.init(Handle())
    rows = [("a", "write", "x", 1, 1), ("b", "write", "y", 1, 2), ("a", "remove", None, 2, 3), ("b", "write", "z", 1, 2)]
    frames = [pd.DataFrame([r], columns=["path", "op", "content", "ts", "seq"]) for r in rows]
    (changed,) = latest.handleInputRows((0,), iter(frames), None)
    assert list(changed.itertuples(index=False, name=None)) == [("b", "write", "y", 1, 2)]
    assert known == {("a",): (2, 3, None, False), ("b",): (1, 2, "y", True)}
    assert list(latest.handleInputRows((0,), iter(frames), None)) == []
