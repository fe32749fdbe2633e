"""Training-order materialisation of token ids as fixed-stride binary shards.

Documents become sequences of at most ``length`` ids; sequences are numbered 0 to N - 1,
and a keyed Feistel permutation with cycle-walking gives each number a slot of its own in
0 to N - 1. Slots are dealt out by range: a shard holds ``per_shard`` of them, one after
another, each of the same number of bytes, so slot s is found by dividing, and a reader
resumes anywhere. No table of the order exists: slot and number are computed from each
other.

A first pass counts each partition's sequences; a second one makes the ids again, numbers
them from its partition's start and sends each sequence to the task that writes its shard.
So texts and ids lie nowhere in between. Both passes must meet the same rows in the same
order, as they do in a table of files; each partition checks that and fails otherwise.
Shards are written under another name and renamed when whole, so a task that is repeated,
or runs twice, replaces what it wrote by the same bytes. The folder may be anything that
Arrow's file systems reach by its address.

A record is ``length`` unsigned ids of 2 or 4 bytes, little-endian, filled up with
``end``; the manifest, a Parquet table, says how many ids of a sequence count.

Defined results: a null text is empty; every document ends in ``end`` and so has a sequence.
Sequences are numbered in the order in which the table is read, so reruns with the same
files and split sizes agree. Repeated rows and rows without doc_id are documents of their
own. An empty table gives no shard and an empty manifest. Columns other than doc_id and
text play no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import text_batches, text_of, written
from sheaf.llm.tokens import counted, default_vocabulary, encoded
from sheaf.session import new_folder

LENGTH = 512
PER_SHARD = 16_384
ROUNDS = 6


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of 0 to n - 1.

    A balanced Feistel network permutes the numbers of the least even count of bits that
    has n numbers, fewer than 4 n; a result of n or more is permuted again until it is below.
    """

    n: int
    key: int

    @property
    def half(self) -> int:
        return max(1, ((max(self.n - 1, 1)).bit_length() + 1) // 2)

    def _keys(self, rounds: int) -> np.ndarray:
        seeds = (hashlib.sha256(struct.pack("<qq", self.key, r)).digest()[:8] for r in range(rounds))
        return np.frombuffer(b"".join(seeds), dtype="<u8")

    def _mixed(self, side: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (side + key) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & np.uint64((1 << self.half) - 1)

    def _walk(self, numbers: np.ndarray, back: bool) -> np.ndarray:
        keys = self._keys(ROUNDS)
        low = np.uint64((1 << self.half) - 1)
        bits = np.uint64(self.half)
        out = np.array(numbers, dtype="u8")
        todo = np.arange(len(out))
        while len(todo):
            left, right = out[todo] >> bits, out[todo] & low
            for key in keys[::-1] if back else keys:
                if back:
                    left, right = right ^ self._mixed(left, key), left
                else:
                    left, right = right, left ^ self._mixed(right, key)
            out[todo] = left << bits | right
            todo = todo[out[todo] >= self.n]
        return out.astype("i8")

    def slot(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, False)

    def number(self, slots: np.ndarray) -> np.ndarray:
        """The inverse of ``slot``."""
        return self._walk(slots, True)


@dataclass(frozen=True)
class Shards:
    """What is needed to find a slot's bytes."""

    folder: str
    sequences: int
    length: int
    per_shard: int
    id_bytes: int
    key: int

    @property
    def stride(self) -> int:
        return self.length * self.id_bytes

    def read(self, first: int, count: int) -> Iterator[np.ndarray]:
        """The records of ``count`` slots from ``first`` on, in training order."""
        slot, end = first, min(self.sequences, first + count)
        while slot < end:
            shard, at = divmod(slot, self.per_shard)
            n = min(end - slot, self.per_shard - at)
            system, path = fs.FileSystem.from_uri(_name(self.folder, shard))
            with system.open_input_file(path) as file:
                file.seek(at * self.stride)
                data = file.read(n * self.stride)
            yield from np.frombuffer(data, dtype=f"<u{self.id_bytes}").reshape(n, self.length)
            slot += n


def _name(folder: str, shard: int) -> str:
    base = folder if "://" in folder or folder.startswith("file:") else "file://" + folder
    return f"{base.rstrip('/')}/shard-{shard:08d}.bin"


def _partitions(
    docs: DataFrame, length: int, files: tuple[str, str | None]
) -> tuple[dict[int, tuple[int, int]], int]:
    """First sequence number and fingerprint of every partition, and the number of sequences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences, mark = 0, 0
        for batch in batches:
            for part in text_batches(batch):
                sizes = counted(part.column(1), *files)
                sequences += int((-(-sizes // length)).sum())
                mark = _mark(mark, part.column(0), sizes.tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId()]), pa.array([sequences]), pa.array([mark])],
            names=["part", "n", "mark"],
        )

    # A row per partition, not per document.
    rows = sorted(docs.mapInArrow(count, "part bigint, n bigint, mark bigint").collect())
    firsts, total = {}, 0
    for part, n, mark in rows:
        firsts[part] = (total, mark)
        total += n
    return firsts, total


def _mark(before: int, doc_ids: pa.Array, sizes: list[int]) -> int:
    return zlib.crc32(repr((doc_ids.to_pylist(), sizes)).encode(), before)


def _sequences(
    docs: DataFrame, firsts: dict[int, tuple[int, int]], order: Permutation, length: int, per_shard: int,
    id_bytes: int, files: tuple[str, str | None], end: int,
) -> DataFrame:
    """number, slot, shard, doc_id, place, n_ids, ids of every sequence."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, expected = firsts[TaskContext.get().partitionId()]
        mark = 0
        for batch in batches:
            for part in text_batches(batch):
                doc, place, size, ids, sizes = [], [], [], [], []
                for doc_id, values in zip(part.column(0).to_pylist(), encoded(part.column(1), *files, end)):
                    data = values.astype(f"<u{id_bytes}")
                    sizes.append(len(data))
                    for k, at in enumerate(range(0, len(data), length)):
                        piece = data[at : at + length]
                        doc.append(doc_id)
                        place.append(k)
                        size.append(len(piece))
                        ids.append(piece.tobytes())
                mark = _mark(mark, part.column(0), sizes)
                number = np.arange(first, first + len(ids))
                first += len(ids)
                slot = order.slot(number)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number, pa.int64()), pa.array(slot), pa.array(slot // per_shard),
                        pa.array(doc, pa.int64()), pa.array(place, pa.int32()), pa.array(size, pa.int32()),
                        pa.array(ids, pa.binary()),
                    ],
                    names=["number", "slot", "shard", "doc_id", "place", "n_ids", "ids"],
                )
        if mark != expected:
            raise RuntimeError("the documents came in another order than when they were counted; write them first")

    return docs.mapInArrow(
        cut, "number bigint, slot bigint, shard bigint, doc_id bigint, place int, n_ids int, ids binary"
    )


def _write(rows: DataFrame, shards: Shards, end: int, parts: int) -> DataFrame:
    """Write whole shards, a range of them per task, and return a row for every sequence."""
    filler = np.full(shards.length, end, dtype=f"<u{shards.id_bytes}").tobytes()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file, system, name = None, None, None, ""

        def close() -> None:
            if file is not None:
                file.close()
                system.move(name + mark, name)

        mark = f".{np.random.SeedSequence().entropy:x}"
        for batch in batches:
            places = []
            for one, ids in zip(batch.column(2).to_pylist(), batch.column(6)):
                if one != shard:
                    close()
                    shard = one
                    system, name = fs.FileSystem.from_uri(_name(shards.folder, one))
                    system.create_dir(name.rpartition("/")[0], recursive=True)
                    file = system.open_output_stream(name + mark)
                data = ids.as_py()
                data += filler[len(data) :]
                file.write(data)
                places.append(zlib.crc32(data))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(places, pa.int64())],
                names=["number", "slot", "shard", "doc_id", "place", "n_ids", "record_crc32"],
            )
        close()

    # Ranges of shards, neighbours in a task; slots are dense, so equal ranges are even.
    last = -(-shards.sequences // shards.per_shard)
    task = F.floor(F.col("shard") * parts / max(1, last)).cast("int")
    spread = rows.repartitionById(parts, task).sortWithinPartitions("slot")
    return spread.mapInArrow(
        put,
        "number bigint, slot bigint, shard bigint, doc_id bigint, place int, n_ids int, record_crc32 bigint",
    )


def materialise(
    docs: DataFrame,
    folder: str | None = None,
    key: int = 0,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    vocabulary: tuple[str, str | None] | None = None,
    id_bytes: int = 2,
    end: int = 0,
) -> tuple[Shards, DataFrame]:
    """Write the shards; returns where they are and the manifest, a row per sequence.

    The manifest has number, slot, shard, doc_id, place, n_ids and the CRC-32 of the record.
    """
    if length < 1 or per_shard < 1 or id_bytes not in (2, 4):
        raise ValueError("length and per_shard must be positive and id_bytes 2 or 4")
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "shards")
    files = vocabulary or default_vocabulary()
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    firsts, total = _partitions(texts, length, files)
    shards = Shards(folder, total, length, per_shard, id_bytes, key)
    order = Permutation(max(total, 1), key)
    rows = _sequences(texts, firsts, order, length, per_shard, id_bytes, files, end)
    parts = max(1, min(-(-total // per_shard), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return shards, written(_write(rows, shards, end, parts), "shard-manifest")


def op7_training_order(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every sequence of every document in the shards."""
    return materialise(spark.read.parquet(f"{folder}/documents.parquet"))[1]
