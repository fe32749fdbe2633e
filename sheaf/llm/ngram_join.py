"""N-gram Jaccard join in size-banded tiles with bitmap signatures.

Two sets of similarity t or more differ in few elements against their size. Cut by hash
into one part more than that, two such sets have a part in common that is equal and not
empty; the hashes of a set's parts are its keys, and sets that share a key may link. What
hangs together by keys is a cluster. Nothing is lost: every link lies within a cluster.
Parts made of common shingles only, as passages leave them that many documents share, are
no keys unless a set has too few others; which shingles are common is counted over all
documents and only decides how large clusters get, not what is found.

Clusters are compared in tiles. A large cluster is cut into bands of size, because sets
whose sizes differ too much cannot link, and bands into blocks by hash; every two blocks
of a band or of neighbouring bands meet in a tile. In a tile, bitmaps of the sets bound
the overlap from above by bit counts, and pairs that may still link are intersected as
sorted arrays, unless they already hang together. A tile returns the links that join its
sets, fewer than it has sets, and never all pairs.

Sets that are equal are one class, so copies are neither compared nor expanded.

Keys and tiles are dealt out in rounds, each with a share of them by hash, so that what is
moved at a time is a fraction of the table; keys and sets are deleted after their last
round.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased. With
fewer words than a shingle has, the whole sequence is the one shingle. A null or wordless
text has the empty set, links with nothing and is a component of its own. Repeated rows
are copies. A component's id is its smallest doc_id, null being left out unless it has no
other. An empty table gives an empty result. Columns other than doc_id and text play no
part.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.bloom import bloom_of
from sheaf.llm.common import join_by_key, scratch, text_batches, text_hash, text_of, written
from sheaf.llm.components import components
from sheaf.llm.shingles import mix, shingle_set, shingles
from sheaf.llm.tiles import Forest, by_tile

WORDS = 5
PERCENT = 80
"""Links need ``100 * intersection >= PERCENT * union``."""
LEVEL = 1.25
"""Ratio of the sizes of a level of keys."""
COMMON_SHARE = 1e-6
"""A shingle that is more than this share of all is common, so under a million are."""
BLOCK_SETS = 1024
BLOCK_ELEMENTS = 1_000_000
"""Most sets of a block, and elements they have on average."""
BROADCAST_COPIES = 1_000_000
"""Up to so many row numbers of copies, 8 MB, go to all tasks; beyond, keys are joined."""
BROADCAST_ROWS = 100_000
"""Up to so many candidates, some 20 MB of numbers and tiles, go to all tasks; more are joined."""
KEY_PARTS = 8
"""Keys are kept in so many columns by their first bits, one for each round."""
ROUND_SHINGLES = 1_000_000
"""A round is no smaller than what so many shingles, 8 MB, come to."""


@functools.lru_cache(maxsize=1)
def _levels() -> np.ndarray:
    """First sizes of the levels, up to sets of 2**40 elements."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * LEVEL)))
    return np.array(out)


def keys_of(elements: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    """Keys of a set: sets that may link have one in common.

    A pair is looked for at the level of its larger set, so a set has keys at its own level
    and at those of the larger sets it can link with. At a level whose sizes end at s, sets
    that link differ in at most d = 2 * s * (100 - percent) / (100 + percent) elements. If
    more than d parts of either set hold an element that is not common, one of these is
    untouched. A set with fewer such parts takes all its parts, and with fewer than that
    altogether its elements too; this settles pairs of two such sets.
    """
    n = len(elements)
    levels = _levels()
    rare = common[np.minimum(np.searchsorted(common, elements), len(common) - 1)] != elements if len(common) else np.ones(n, bool)
    first = int(np.searchsorted(levels, n, "right")) - 1
    last = int(np.searchsorted(levels, n * 100 // percent, "right")) - 1
    keys = []
    for level in range(first, last + 1):
        most = int(levels[level + 1]) - 1
        differ = 2 * most * (100 - percent) // (100 + percent)
        if not differ:
            continue  # only equal sets link
        parts = differ + 2 + differ // 8
        # Elements are sorted, so the parts are stretches of them.
        part = (elements >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        tag = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        every = mix(np.add.reduceat(mix(elements ^ tag), starts) + mix(part[starts] + tag))
        telling = np.logical_or.reduceat(rare, starts)
        keys.append(every[telling] if telling.sum() > differ else every)
        if len(starts) <= differ:
            keys.append(mix(elements + mix(tag[None])))
    return np.concatenate(keys) if keys else np.zeros(0, dtype="u8")


def _sets(part: pa.RecordBatch, column: int, words: int) -> list[np.ndarray]:
    return [shingle_set((t or "").encode(), words) for t in part.column(column).to_pylist()]


def common_shingles(docs: DataFrame, words: int, share: float = COMMON_SHARE) -> np.ndarray:
    """Sorted hashes of shingles that are more than ``share`` of all, in order of the hash.

    A task counts its documents some megabytes at a time and reports what is that frequent
    there, so at most ``1 / share`` of a stretch; the sum over all stretches decides. At
    most ``1 / share`` shingles come back, whatever the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, 16 << 20):
                texts = [(t or "").encode() for t in part.column(0).to_pylist()]
                found, times = np.unique(
                    np.concatenate([shingles(t, words) for t in texts]), return_counts=True
                )
                often = times > max(2.0, share * times.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.append(found[often].view("i8"), 0)),
                        pa.array(np.append(times[often], 0)),
                        pa.array(np.append(np.zeros(often.sum(), "i8"), times.sum())),
                    ],
                    names=["shingle", "times", "every"],
                )

    told = docs.select(text_of(docs).alias("text")).mapInArrow(count, "shingle bigint, times bigint, every bigint")
    sums = written(told.groupBy("shingle").agg(F.sum("times").alias("times"), F.sum("every").alias("every")), "common")
    every = sums.agg(F.sum("every")).first()[0] or 0
    often = sums.where(F.col("times") > F.lit(max(2.0, share * every))).select("shingle").toArrow()
    return np.sort(often.column(0).to_numpy().view("u8"))


def _keyed(docs: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """doc_id, text_hash, row, n_shingles, class (null for the empty set), keys in ``KEY_PARTS`` columns."""
    names = [f"keys{k}" for k in range(KEY_PARTS)]

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                sets = _sets(part, 3, words)
                keys = [keys_of(s, percent, common) if len(s) else np.zeros(0, "u8") for s in sets]
                classes = [hashlib.md5(s.tobytes()).hexdigest() if len(s) else None for s in sets]
                values = np.concatenate(keys) if keys else np.zeros(0, "u8")
                owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                place = (values >> np.uint64(32)) * np.uint64(KEY_PARTS) >> np.uint64(32)
                lists = []
                for k in range(KEY_PARTS):
                    own = place == k
                    ends = np.concatenate([[0], np.cumsum(np.bincount(owner[own], minlength=len(keys)))])
                    lists.append(pa.ListArray.from_arrays(pa.array(ends.astype("i4")), pa.array(values[own].view("i8"))))
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:3],
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(classes, pa.string()),
                        *lists,
                    ],
                    names=["doc_id", "text_hash", "row", "n_shingles", "class", *names],
                )

    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        text_hash(docs).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
        text_of(docs).alias("text"),
    )
    schema = "doc_id bigint, text_hash bigint, row bigint, n_shingles bigint, class string"
    return rows.mapInArrow(key, ", ".join([schema, *[f"{name} array<bigint>" for name in names]]))


def _candidates(classes: DataFrame, keyed: DataFrame, rounds: int = 1) -> DataFrame:
    """a, b: sets with a key in common, as stars around the first set of a key.

    The columns of keys are taken in ``rounds`` rounds. No key is in two of them.
    """
    first = classes.select(F.col("node").alias("row"))
    copies = keyed.where("class IS NOT NULL").select("row").join(first, "row", "left_anti")
    copies = written(copies, "copies")
    if copies.count() <= BROADCAST_COPIES:
        once = keyed.join(F.broadcast(copies), "row", "left_anti")
    else:
        once = keyed.join(first, "row", "left_semi")
    columns = [c for c in keyed.columns if c.startswith("keys")]
    stars = []
    for k in range(min(rounds, len(columns))):
        own = F.concat(*columns[k::rounds])
        keys = once.select("row", F.explode(own).alias("key"))
        # Combined before the shuffle, so a key that a third of all sets have is no task of its own.
        shared = keys.groupBy("key").agg(F.min("row").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
        with scratch(shared, "shared-keys") as shared:
            total = shared.agg(F.sum("n")).first()[0] or 0
            found = join_by_key(keys, shared, "key", total, merge=True).where("a != row")
            stars.append(written(found.select("a", F.col("row").alias("b")).distinct(), "stars"))
    return functools.reduce(DataFrame.unionByName, stars)


def _placed(members: DataFrame, percent: int) -> DataFrame:
    """Members with the tiles each of them is in; ``cluster``, ``node`` and ``n`` are given."""
    # Just over the widest ratio of sizes, so that rounding cannot part two that may link.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100.0 / percent * 1.001))).cast("int")
    members = written(members.withColumn("band", band), "members")
    bands = members.groupBy("cluster", "band").agg(
        F.count(F.lit(1)).alias("sets"), F.sum("n").alias("elements")
    )
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK_SETS, F.col("elements") / BLOCK_ELEMENTS)).cast("int")
    # A cluster has as many bands as sizes between 1 and its largest allow.
    clusters = bands.groupBy("cluster").agg(
        F.sum("sets").alias("n_sets"),
        F.sum("elements").alias("elements"),
        F.map_from_entries(F.collect_list(F.struct("band", blocks))).alias("blocks"),
    )
    clusters = written(clusters.withColumnRenamed("n_sets", "members"), "clusters")
    rows = join_by_key(members, clusters, "cluster", members.count(), "members")
    whole = (F.col("members") <= BLOCK_SETS) & (F.col("elements") <= BLOCK_ELEMENTS)

    def count(step: int):
        return F.coalesce(F.element_at("blocks", F.col("band") + step), F.lit(0))

    mine = F.pmod(F.xxhash64("node"), count(0)).cast("int")

    def meet(step: int):
        others = F.when(count(step) > 0, F.sequence(F.lit(0), count(step) - 1)).otherwise(
            F.array().cast("array<int>")
        )

        def tile(other):
            if step == 0:
                ends = [F.col("band"), F.least(mine, other), F.greatest(mine, other)]
            elif step > 0:
                ends = [F.col("band"), mine, F.lit("up"), other]
            else:
                ends = [F.col("band") - 1, other, F.lit("up"), mine]
            return F.concat_ws("/", F.col("cluster"), *ends)

        return F.transform(others, tile)

    tiles = F.when(whole, F.array(F.col("cluster").cast("string"))).otherwise(
        F.concat(meet(0), meet(1), meet(-1))
    )
    return rows.select("doc_id", "text_hash", "node", "n", tiles.alias("tiles"))


_ROWS = 128


def _compare(percent: int):
    """For a tile: links that join its sets, as a, b."""

    def work(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        node = tile.column("node").to_numpy()
        _, once = np.unique(node, return_index=True)
        if len(once) < 2:
            return
        stored = tile.column("elements").combine_chunks()
        sets = [np.frombuffer(stored[int(i)].as_buffer(), dtype="u8") for i in once]
        node = node[once]
        n = np.array([len(s) for s in sets])
        order = np.argsort(n, kind="stable")
        sets, n, node = [sets[i] for i in order], n[order], node[order]
        bits = int(min(4096, 1 << int(max(8, (2 * int(n.max())).bit_length()))))
        maps = np.zeros((len(sets), bits), dtype="f4")
        for i, s in enumerate(sets):
            maps[i, (s & np.uint64(bits - 1)).astype("i8")] = 1
        ones = maps.sum(axis=1)
        forest, links = Forest(len(sets)), []
        for low in range(0, len(sets), _ROWS):
            high = min(len(sets), low + _ROWS)
            # Only sets that are no smaller, and not too large.
            end = int(np.searchsorted(n, n[high - 1] * 100 // percent, "right"))
            a, b = slice(low, high), slice(low, end)
            both = maps[a] @ maps[b].T
            # A bit that only one of them has stands for an element that only it has.
            most = np.minimum((n - ones)[a, None], (n - ones)[None, b]) + both
            need = percent * (n[a, None] + n[None, b])
            for i, j in np.argwhere((100 + percent) * most >= need):
                i, j = int(i) + low, int(j) + low
                if j <= i or forest.find(i) == forest.find(j):
                    continue
                shared = _overlap(sets[i], sets[j])
                if 100 * shared >= percent * (int(n[i]) + int(n[j]) - shared):
                    forest.join(i, j)
                    links.append((node[i], node[j]))
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return work


def _overlap(small: np.ndarray, large: np.ndarray) -> int:
    """Elements that two sorted arrays have in common."""
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def _with_sets(docs: DataFrame, placed: DataFrame, words: int) -> DataFrame:
    """node, tiles, elements: the sets of the placed documents, made from their texts.

    A filter of bounded size keeps most other documents from being moved, and the join
    keeps the rest out.
    """
    own = F.xxhash64("doc_id", "text_hash")
    n = placed.count()
    wanted = bloom_of(placed.select(own.alias("hash")), "hash", n)
    if n <= BROADCAST_ROWS:
        placed = F.broadcast(placed)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch):
                passing = wanted.passes(part.column(2).to_numpy(zero_copy_only=False))
                few = part.filter(pa.array(passing))
                sets = [s.tobytes() for s in _sets(few, 3, words)]
                yield pa.RecordBatch.from_arrays(
                    [*few.columns[:2], pa.array(sets, pa.binary())], names=["own_id", "own_hash", "elements"]
                )

    texts = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), text_hash(docs).alias("text_hash"), text_of(docs).alias("text")
    ).select("doc_id", "text_hash", own.alias("hash"), "text")
    sets = texts.mapInArrow(make, "own_id bigint, own_hash bigint, elements binary")
    on = sets["own_id"].eqNullSafe(placed["doc_id"]) & (sets["own_hash"] == placed["text_hash"])
    return sets.join(placed, on).select("node", "tiles", "elements")


def _links(docs: DataFrame, placed: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links that join the placed documents, found tile by tile.

    A round moves half as many elements as the sets have, however many tiles a set is in.
    """
    moved, own = placed.agg(F.sum(F.col("n") * F.size("tiles")), F.sum("n")).first()
    rounds = max(1, math.ceil((moved or 0) / max(ROUND_SHINGLES, (own or 0) / 2)))
    links = []
    with scratch(_with_sets(docs, placed, words), "sets") as sets:
        for k in range(rounds):
            tiles = F.filter("tiles", lambda tile: F.pmod(F.xxhash64(tile), F.lit(rounds)) == k)
            rows = sets.select(F.explode(tiles).alias("tile"), "node", "elements")
            links.append(written(by_tile(rows, "tile", _compare(percent), "a bigint, b bigint"), "tile-links"))
    return functools.reduce(DataFrame.unionByName, links)


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, and whether the row is the one to keep.

    Of a component one row is kept: one with its smallest doc_id.
    """
    if words < 1 or not 50 <= percent <= 100:
        raise ValueError("words must be positive and percent between 50 and 100")
    with scratch(_keyed(docs, words, percent, common_shingles(docs, words)), "shingle-keys") as every:
        keyed = written(every.select("doc_id", "text_hash", "row", "n_shingles", "class"), "shingle-rows")
        classes = keyed.where("class IS NOT NULL").groupBy("class").agg(
            F.min("row").alias("node"),
            F.min_by(F.struct("doc_id", "text_hash"), "row").alias("from"),
            F.first("n_shingles").alias("n"),
            F.count(F.lit(1)).alias("copies"),
        )
        classes = written(classes, "shingle-classes")
        size = classes.agg(F.sum("n")).first()[0] or 0
        rounds = min(KEY_PARTS, max(1, math.ceil(size / ROUND_SHINGLES)))
        stars = _candidates(classes, every, rounds)
    clusters = components(stars)
    members = clusters.join(classes, "node").select(
        F.col("component").alias("cluster"), "node", "n", "from.doc_id", "from.text_hash"
    )
    links = _links(docs, written(_placed(members, percent), "placed"), words, percent)
    labels = components(links)

    total = keyed.count()
    named = classes.join(labels, "node", "left").select(
        "class", F.col("copies"), F.coalesce("component", "node").alias("component")
    )
    named = written(named, "class-components")
    by_row = written(
        join_by_key(keyed.select("doc_id", "text_hash", "row", "n_shingles", "class"), named, "class", total, "copies"),
        "row-components",
    )
    # The smallest doc_id, and of its rows one, whichever.
    least = by_row.groupBy("component").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"),
        F.count(F.lit(1)).alias("n"),
    )
    least = written(least, "least-ids")
    linked = join_by_key(by_row, least, "component", total).select(
        "doc_id", "text_hash", "n_shingles", F.col("least.doc_id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("kept"),
    )
    alone = keyed.where("class IS NULL").select(
        "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return linked.unionByName(alone)


def op8_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents by 4-word shingles and a similarity of 0.85."""
    rows = ngram_components(spark.read.parquet(f"{folder}/documents.parquet"), words=4, percent=85)
    return rows.select("doc_id", "n_shingles", "component_id")
