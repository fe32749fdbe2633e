"""Best-fit packing by linear grouping.

Lengths are whole numbers up to the capacity, so the corpus is described by one count
per length, whatever its size, and the plan is made from those counts:

1. Large lengths, in falling order, are cut into groups of equal cardinality and each is
   rounded up to its group's largest.
2. For the few rounded sizes, configurations of a sequence are chosen, each the fullest
   that holds the largest size left, and used until one of its sizes runs out.
3. Actual documents take the places of the rounded sizes, the longest first.
4. Small lengths, the longest first, go where least room is left over.

The plan speaks of runs of ranks within a length. The documents' ranks are counted by
``ranked``, so no task holds a length, and each document finds its place by its rank.

Defined results: a null text is empty; an item has length 1 or more. Items longer than
the capacity must be cut first (``pieces``). Repeated rows are items of their own. Which
of the items of one length goes where follows a hash of their columns. An empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sheaf.llm.common import ranked, text_batches, written
from sheaf.llm.tokens import default_vocabulary, encoded

CAPACITY = 2048
GROUPS = 8192
SMALL = 8
"""Lengths up to a ``SMALL``-th of the capacity are small."""

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
_ARROW_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None, end: int = 0
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: documents' ids, cut where too long.

    All pieces of a document but the first have the full length.
    """
    files = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                rows: list[tuple] = []
                ids_of = encoded(part.column(1), *files, end)
                for doc_id, ids in zip(part.column(0).to_pylist(), ids_of):
                    first = len(ids) % capacity or capacity
                    bounds = [0, *range(first, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append((doc_id, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _ARROW_PIECES)], schema=_ARROW_PIECES
                )

    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(cut, _PIECES)


def _groups(counts: Mapping[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [length, first rank, count] ...) of groups of equal cardinality."""
    total = sum(counts.values())
    each = max(1, -(-total // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            if not room:
                if not out or out[-1][0] != length:  # groups of one size are one
                    out.append((length, []))
                room = each
            n = min(left, room)
            runs = out[-1][1]
            if runs and runs[-1][0] == length:
                runs[-1][2] += n
            else:
                runs.append([length, rank, n])
            rank, left, room = rank + n, left - n, room - n
    return out


def _fullest(sizes: list[int], left: list[int], start: int, room: int) -> list[int]:
    """Indexes, from ``start`` on, of the sizes left that fill most of ``room``.

    Subset sums as the bits of one integer per item taken; sizes fall with the index, so
    going back from the last item prefers few and large ones.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for i in range(start, len(sizes)):
        if sizes[i] > room:
            continue
        for _ in range(min(left[i], room // sizes[i])):
            wider = (reach | reach << sizes[i]) & mask
            if wider == reach:
                break
            steps.append((i, reach))
            reach = wider
        if reach.bit_length() - 1 == room:
            break
    at, chosen = reach.bit_length() - 1, []
    for i, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(i)
            at -= sizes[i]
    return chosen


def plan(counts: Mapping[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, ...]]:
    """Runs (length, first rank, count, first sequence, offset) that place every item.

    The number of runs depends on the lengths that occur, not on their counts.
    """
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"lengths must be between 1 and {capacity}")
    small = capacity // SMALL
    runs: list[tuple[int, ...]] = []
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left: (first sequence, count)
    sequences = 0
    large = _groups({k: n for k, n in counts.items() if n and k > small}, groups)
    sizes, left = [g[0] for g in large], [sum(r[2] for r in g[1]) for g in large]
    largest = 0
    while True:
        while largest < len(sizes) and not left[largest]:
            largest += 1
        if largest == len(sizes):
            break
        left[largest] -= 1
        chosen = [largest, *_fullest(sizes, left, largest, capacity - sizes[largest])]
        left[largest] += 1
        wanted = {i: chosen.count(i) for i in chosen}
        times = min(left[i] // n for i, n in wanted.items())
        for i, n in wanted.items():
            left[i] -= n * times
        # Documents for each place, as runs; where a run of any place ends, a new stretch begins.
        places, cuts = [], {0, times}
        for i in chosen:
            queue, taken, at = large[i][1], [], 0
            while at < times:
                length, rank, n = queue[0]
                use = min(n, times - at)
                taken.append((at, length, rank))
                cuts.add(at)
                if use == n:
                    queue.pop(0)
                else:
                    queue[0][1:] = [rank + use, n - use]
                at += use
            places.append(taken)
        edges = sorted(cuts)
        for a, b in zip(edges, edges[1:]):
            offset = 0
            for taken in places:
                at, length, rank = taken[bisect.bisect_right(taken, (a, capacity + 1)) - 1]
                runs.append((length, rank + a - at, b - a, sequences + a, offset))
                offset += length
            if offset < capacity:
                rooms[capacity - offset].append((sequences + a, b - a))
        sequences += times

    open_rooms = sorted(rooms)
    for length in sorted((k for k, n in counts.items() if n and k <= small), reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            place = bisect.bisect_left(open_rooms, length)
            if place == len(open_rooms):
                n = -(-todo // (capacity // length))
                rooms[capacity].append((sequences, n))
                bisect.insort(open_rooms, capacity)
                sequences += n
                continue
            room = open_rooms[place]
            first, n = rooms[room].pop()
            use = min(n, todo)
            if use < n:
                rooms[room].append((first + use, n - use))
            elif not rooms[room]:
                del rooms[room], open_rooms[place]
            runs.append((length, rank, use, first, capacity - room))
            rank, todo = rank + use, todo - use
            if room > length:
                if room - length not in rooms:
                    bisect.insort(open_rooms, room - length)
                rooms[room - length].append((first, use))
    return sorted(runs)


def pack(items: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """The rows of ``items``, which have a ``length``, with sequence_id and offset."""
    columns = items.columns
    order = [c for c in columns if c != "length"]
    tie = F.xxhash64(*order) if order else F.lit(0).cast("bigint")
    rows = items.withColumn("__tie", tie).where(F.col("length") > 0)
    placed = ranked(rows, ["length"], ["__tie", *order], "packing-ranks").drop("__tie")
    # At most one row per length: bounded by the capacity.
    counts = {r["length"]: r["n"] for r in placed.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.array(plan(counts, capacity, groups), dtype="i8").reshape(-1, 5)
    wide = int(table[:, 1].max()) + 1 if len(table) else 1
    starts = table[:, 0] * wide + table[:, 1]  # grows with length and rank
    names = list(columns)
    schema = StructType(
        [*items.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(names.index("length")), batch.column(len(names)))
            rank = rank.to_numpy(zero_copy_only=False)
            key = length.to_numpy(zero_copy_only=False).astype("i8") * wide + np.minimum(rank, wide - 1)
            run = table[np.searchsorted(starts, key, "right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    return placed.mapInArrow(place, schema)


def pack_documents(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every document."""
    return pack(written(pieces(docs, capacity, vocabulary), "pieces"), capacity)


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's pieces and their places."""
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet"))
