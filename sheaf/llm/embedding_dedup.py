"""Near-duplicate embeddings by an inverted multi-index.

Each half of the vectors has a codebook of its own, so K + K centroids make a grid of
K x K cells. A vector lives in the cell of its nearest centroids and visits the cells
that a multi-sequence traversal meets first: those with the least sum of both halves'
distances. How many it visits is measured on the sample for each home cell on its own, as
the number that reaches the target recall both for the real pairs of that cell's vectors,
found by brute force, and for made pairs just at the threshold; no number is too large.
A pair is found if either vector visits the other's cell; its cosine is then checked in
double precision.

Codebooks are fitted on a cover of the sample, in which near copies are represented by
one another, so that a large group of them is not split over many cells. Only codebooks
and the numbers of visits come from a bounded sample; every vector is indexed and visits. Equal vectors are one class with a weight, so copies are counted and
not expanded. Cells are cut into blocks that meet in tiles; a tile counts links and
returns at most a row per vector, never a row per pair.

Defined results: vectors that are null, all zero, or hold null or non-finite components
link with nothing and are components of their own. Vectors of different lengths are not
compared. Repeated rows are copies of each other. Rows without vec_id are compared and
counted like others; the component of none but such rows has a null id. An empty table
gives an empty result. Columns other than the two play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import join_by_key, written
from sheaf.llm.components import components
from sheaf.llm.tiles import by_tile

THRESHOLD = 0.9
SAMPLE = 16_384
"""Most vectors that codebooks are fitted on."""
ROWS_PER_CELL = 128
MOST_CENTROIDS = 256
"""Of each half; bounds the table of cells."""
RECALL = 0.97
"""Aimed at for pairs just at the threshold; others are found more often."""
PARTNERS = 8
"""Most real pairs, and made pairs, that a vector of the sample is measured with."""
BLOCK = 1024
"""Vectors of a block; a tile is two blocks."""


def unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


@dataclass
class MultiIndex:
    """Two codebooks, one for each half of unit vectors, and the visits of each home cell."""

    width: int
    left: np.ndarray
    right: np.ndarray
    visits: np.ndarray | None = None

    def halves(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Of vectors longer than any of the sample the index takes the beginning: it only
        # brings vectors nearer, and the links are checked on all of them.
        kept = vectors[:, : self.width]
        padded = np.zeros((len(vectors), self.width))
        padded[:, : kept.shape[1]] = kept
        cut = self.left.shape[1]
        return padded[:, :cut], padded[:, cut:]

    def traversal(self, vectors: np.ndarray, visits: int) -> np.ndarray:
        """The cells that each vector visits, nearest first.

        With both halves' centroids in order of distance, the pair at places (i, j) has
        (i + 1) * (j + 1) - 1 pairs that come no later, so the first ``visits`` cells of
        the traversal are among the pairs with (i + 1) * (j + 1) <= visits.
        """
        k = len(self.right)
        near = []
        for half, book in zip(self.halves(vectors), (self.left, self.right)):
            away = (book**2).sum(axis=1)[None, :] - 2 * half @ book.T
            order = np.argsort(away, axis=1, kind="stable")[:, :visits]
            near.append((order, np.take_along_axis(away, order, axis=1)))
        (first, d1), (second, d2) = near
        places = np.outer(np.arange(1, first.shape[1] + 1), np.arange(1, second.shape[1] + 1))
        i, j = np.nonzero(places <= visits)
        sums = d1[:, i] + d2[:, j]
        best = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(first[:, i] * k + second[:, j], best, axis=1)

    def ranks(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells come before the given one in each vector's traversal."""
        k = len(self.right)
        d1, d2 = (
            (book**2).sum(axis=1)[None, :] - 2 * half @ book.T for half, book in zip(self.halves(vectors), (self.left, self.right))
        )
        rows = np.arange(len(vectors))
        bound = d1[rows, cells // k] + d2[rows, cells % k]
        d2 = np.sort(d2, axis=1)
        return np.array([np.searchsorted(b, s - a).sum() for a, b, s in zip(d1, d2, bound)], dtype="i8")

    def visited(self, vectors: np.ndarray, rows: int = 256) -> list[np.ndarray]:
        """The cells of each vector, as many as its home cell asks for; the home is the first."""
        need = self.visits[self.traversal(vectors, 1)[:, 0]]
        order = np.argsort(need, kind="stable")
        cells: list[np.ndarray] = [None] * len(vectors)
        for start in range(0, len(order), rows):
            at = order[start : start + rows]
            for i, found in zip(at, self.traversal(vectors[at], int(need[at[-1]]))):
                cells[i] = found[: need[i]].astype("i4")
        return cells


def _codebook(points: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    book = points[random.choice(len(points), k, replace=False)].copy()
    for _ in range(10):
        nearest = ((book**2).sum(axis=1)[None, :] - 2 * points @ book.T).argmin(axis=1)
        counts = np.bincount(nearest, minlength=k)
        sums = np.zeros_like(book)
        np.add.at(sums, nearest, points)
        book[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return book


def _cover(points: np.ndarray, threshold: float, random: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Places of points such that every point links with one, and some links of every point."""
    covered = np.zeros(len(points), dtype=bool)
    chosen, pairs = [], [np.zeros((0, 2), dtype="i8")]
    for start in range(0, len(points), 512):
        linked = points[start : start + 512] @ points.T >= threshold
        for i, row in enumerate(linked, start):
            row[i] = False
            if not covered[i]:
                chosen.append(i)
                covered |= row
            partners = np.flatnonzero(row)
            if len(partners) > PARTNERS:
                partners = random.choice(partners, PARTNERS, replace=False)
            pairs.append(np.stack([np.full(len(partners), i), partners], axis=1))
    return np.array(chosen), np.concatenate(pairs)


def _needed(index: MultiIndex, a: np.ndarray, b: np.ndarray, recall: float) -> tuple[np.ndarray, int]:
    """Visits per home cell, 0 without pairs, that find the pairs (a, b), and those of all pairs as one.

    Each home cell's visits grow until its own pairs are found, so no cell pays for another.
    """
    visits = np.zeros(len(index.left) * len(index.right), dtype="i8")
    if not len(a):
        return visits, 1
    homes = [index.traversal(x, 1)[:, 0] for x in (a, b)]
    ab, ba = index.ranks(a, homes[1]), index.ranks(b, homes[0])
    least = np.minimum(ab, ba)
    every = int(np.quantile(least, recall, method="higher")) + 1
    order = np.argsort(homes[0], kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(homes[0][order])) + 1)
    for group in groups:
        visits[homes[0][group[0]]] = np.quantile(least[group], recall, method="higher") + 1
    while True:
        found = (ab < visits[homes[0]]) | (ba < visits[homes[1]])
        behind = [homes[0][g[0]] for g in groups if found[g].mean() < recall]
        if not behind:
            return visits, every
        visits[behind] += visits[behind] // 4 + 1


def fit(vectors: list[np.ndarray], rows: int, threshold: float, recall: float = RECALL, seed: int = 3) -> MultiIndex:
    """An index for ``rows`` vectors, from unit vectors of a sample.

    Visits are measured per home cell on the sample's real pairs, and on made ones: a vector
    turned in a random direction by just the angle of the threshold. A cell takes the larger
    number; one that the sample does not reach takes that of all made pairs.
    """
    random = np.random.default_rng(seed)
    width = max(2, max(len(v) for v in vectors))
    points = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        points[i, : len(v)] = v
    distinct = random.permutation(np.unique(points, axis=0))
    chosen, real = _cover(distinct, threshold, random)
    cover = distinct[chosen]
    k = int(np.clip(np.sqrt(rows / ROWS_PER_CELL), 1, min(MOST_CENTROIDS, len(cover))))
    cut = width // 2
    index = MultiIndex(width, _codebook(cover[:, :cut], k, random), _codebook(cover[:, cut:], k, random))
    tried = np.repeat(distinct, PARTNERS, axis=0)
    if len(tried) > 4 * SAMPLE:
        tried = tried[random.choice(len(tried), 4 * SAMPLE, replace=False)]
    away = random.normal(size=tried.shape)
    away -= np.einsum("ij,ij->i", away, tried)[:, None] * tried
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-12)
    made = threshold * tried + np.sqrt(max(0.0, 1 - threshold**2)) * away
    by_made, least = _needed(index, tried, made, recall)
    by_real, _ = _needed(index, distinct[real[:, 0]], distinct[real[:, 1]], recall)
    index.visits = np.minimum(np.maximum(np.maximum(by_made, by_real), least), k * k)
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, from their bytes."""
    values = column.to_pylist()
    return unit(np.frombuffer(b"".join(values), dtype="<f8").reshape(len(values), -1))


def _visits(classes: DataFrame, index: MultiIndex) -> DataFrame:
    """node, weight, width, home, cells, vector of every class."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            widths = np.array([len(v) for v in vectors], dtype="i4")
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                raw = np.array([vectors[i] for i in at], dtype="<f8")
                cells = index.visited(unit(raw))
                few = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        few.column(0),
                        few.column(1),
                        pa.array(np.full(len(at), width, dtype="i4")),
                        pa.array([c[0] for c in cells], pa.int32()),
                        pa.array(cells, pa.list_(pa.int32())),
                        pa.array([row.tobytes() for row in raw], pa.binary()),
                    ],
                    names=["node", "weight", "width", "home", "cells", "vector"],
                )

    return classes.select("node", "weight", "vector").mapInArrow(
        visit, "node bigint, weight bigint, width int, home int, cells array<int>, vector binary"
    )


def _tiles(visits: DataFrame) -> DataFrame:
    """Rows of homes and visitors, each in every tile where its block meets another."""
    homes = visits.select("width", F.col("home").alias("cell"))
    visitors = visits.select("width", F.explode("cells").alias("cell"))
    # One row per cell: bounded by the codebooks and the lengths that occur.
    sizes = homes.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("homes")).join(
        visitors.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("visitors")), ["width", "cell"]
    )
    sizes = written(
        sizes.select(
            "width",
            "cell",
            F.ceil(F.col("homes") / BLOCK).cast("int").alias("home_blocks"),
            F.ceil(F.col("visitors") / BLOCK).cast("int").alias("visitor_blocks"),
        ),
        "cells",
    )
    kinds = []
    for visitor in (False, True):
        cell = F.explode("cells") if visitor else F.col("home")
        own, other = ("visitor_blocks", "home_blocks") if visitor else ("home_blocks", "visitor_blocks")
        rows = visits.select("*", cell.alias("cell")).join(F.broadcast(sizes), ["width", "cell"])
        mine = F.pmod(F.xxhash64("node", F.lit(visitor)), F.col(own)).cast("int")
        rows = rows.select("*", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("their"))
        order = ["width", "cell", "their", "mine"] if visitor else ["width", "cell", "mine", "their"]
        kinds.append(
            rows.select(
                F.concat_ws("/", *order).alias("tile"), F.lit(visitor).alias("visitor"),
                "cell", "node", "weight", "home", "cells", "vector",
            )
        )
    return kinds[0].unionByName(kinds[1])


def _links(threshold: float):
    """For a tile: what each vector's count grows by, and the least node it hangs on."""

    def work(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        is_visitor = tile.column("visitor").to_numpy(zero_copy_only=False).astype(bool)
        if is_visitor.all() or not is_visitor.any():
            return
        node = tile.column("node").to_numpy()
        weight = tile.column("weight").to_numpy()
        home = tile.column("home").to_numpy()
        cell = tile.column("cell")[0].as_py()
        vectors = _matrix(tile.column("vector").combine_chunks())
        h, v = np.flatnonzero(~is_visitor), np.flatnonzero(is_visitor)
        linked = vectors[v] @ vectors[h].T >= threshold
        linked &= node[v][:, None] != node[h][None, :]
        rows, columns = linked.any(axis=1), linked.any(axis=0)
        if not rows.any():
            return
        v, h = v[rows], h[columns]
        linked = linked[rows][:, columns]
        others, place = np.unique(home[v], return_inverse=True)
        # Which homes of visitors each home vector visits itself.
        visited = tile.column("cells").combine_chunks().take(pa.array(h))
        owner = np.repeat(np.arange(len(h)), visited.value_lengths().to_numpy())
        flat = visited.flatten().to_numpy()
        at = np.minimum(np.searchsorted(others, flat), len(others) - 1)
        met = others[at] == flat
        back = np.zeros((len(others), len(h)), dtype=bool)
        back[at[met], owner[met]] = True
        grown_v = linked @ weight[h]
        grown_h = np.zeros(len(h), dtype="i8")
        # A pair in one cell is met in both orders, and so is one whose home vector visits
        # the visitor's cell too; any other pair is met only here.
        for i, other in enumerate(others):
            if other == cell:
                continue
            own = place == i
            grown_h += weight[v[own]] @ (linked[own] & ~back[i][None, :])
        low_v, low_h = node[v].copy(), node[h].copy()
        big = np.iinfo("i8").max
        while True:
            new_v = np.minimum(low_v, np.where(linked, low_h[None, :], big).min(axis=1))
            new_h = np.minimum(low_h, np.where(linked, new_v[:, None], big).min(axis=0))
            if (new_v == low_v).all() and (new_h == low_h).all():
                break
            low_v, low_h = new_v, new_h
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([node[v], node[h]])),
                pa.array(np.concatenate([grown_v, grown_h])),
                pa.array(np.concatenate([low_v, low_h])),
            ],
            names=["node", "links", "low"],
        )

    return work


def near_duplicates(
    rows: DataFrame,
    key: str = "vec_id",
    embedding: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """key, n_links, component_id, kept of every row."""
    vector = rows[embedding].cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    base = written(
        rows.select(
            rows[key].alias("id"),
            F.monotonically_increasing_id().alias("row"),
            F.when(usable, vector).alias("vector"),
        )
        # Zeros of either sign are one value; the text of a 128-bit hash stands for the vector.
        .withColumn("vector", F.transform("vector", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)))
        .withColumn(
            "copy",
            F.when(
                F.col("vector").isNotNull(),
                F.concat(F.hex(F.xxhash64("vector")), F.lit(":"), F.hex(F.xxhash64("vector", F.lit(1)))),
            ),
        ),
        "vectors",
    )
    usable_rows = base.where("copy IS NOT NULL")
    classes = written(
        usable_rows.groupBy("copy").agg(
            F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"),
            F.min("id").alias("least_id"), F.first("vector").alias("vector"),
        ),
        "vector-classes",
    )
    found = classes.count()
    if found:
        share = min(1.0, SAMPLE / found)
        chosen = classes.where(F.pmod(F.xxhash64("copy"), F.lit(1 << 40)) <= share * float(1 << 40))
        taken = chosen.select("vector").limit(SAMPLE).toArrow().column(0).to_pylist()
        if not taken:
            taken = classes.select("vector").limit(SAMPLE).toArrow().column(0).to_pylist()
        sample = [unit(np.array([v]))[0] for v in taken]
        index = fit(sample, found, threshold, recall)
        met = written(
            by_tile(_tiles(written(_visits(classes, index), "visits")), "tile", _links(threshold),
                    "node bigint, links bigint, low bigint"),
            "links",
        )
    else:
        met = rows.sparkSession.range(0).selectExpr("id AS node", "id AS links", "id AS low")
    labels = components(met.where("node != low"), "node", "low")
    counts = met.groupBy("node").agg(F.sum("links").alias("links"))
    joined = classes.select("copy", "node", "weight", "least_id").join(counts, "node", "left")
    joined = joined.join(labels, "node", "left").select(
        "copy", "weight", "least_id",
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("component"),
    )
    joined = written(joined, "vector-components")
    least = written(
        joined.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n")),
        "component-ids",
    )
    by_class = join_by_key(joined, least, "component", found).select(
        "copy", "n_links", "component_id", F.col("weight").alias("n")
    )
    by_class = written(by_class, "vector-results")
    linked = join_by_key(usable_rows.select("id", "copy"), by_class, "copy", base.count())
    alone = base.where("copy IS NULL").select(
        "id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")
    )
    every = linked.select("id", "n_links", "component_id").unionByName(alone)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))
    return every.select(F.col("id").alias(key), "n_links", "component_id", kept.alias("kept"))


def op2_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links and components of every embedding."""
    return near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"))
