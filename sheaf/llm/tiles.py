"""Work on tiles: groups of rows of bounded size that meet in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def by_tile(rows: DataFrame, tile: str, work: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """Run ``work`` on the rows of each tile; a tile must fit in a task's memory.

    Rows are dealt out and sorted by tile and then streamed, so that thousands of small
    tiles cost no more than their rows.
    """
    place = rows.columns.index(tile)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            keys = batch.column(place)
            if not len(keys):
                continue
            codes = keys.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(codes)) + 1), len(codes)]
            for a, b in zip(edges, edges[1:]):
                part = batch.slice(a, b - a)
                if held and held[-1].column(place)[0].as_py() != part.column(place)[0].as_py():
                    yield from work(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from work(pa.Table.from_batches(held))

    return rows.repartition(tile).sortWithinPartitions(tile).mapInArrow(stream, schema)


class Forest:
    """Disjoint sets over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        """True if they were apart."""
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True
