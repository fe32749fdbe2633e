"""Spelling variants: words one edit apart, by dense tiles of code points.

Two words are one edit apart if what they have in common at the front and at the end
reaches the longer one's length less one. So with m the longer one's length they share
their first m // 2 code points or their last m - m // 2. Every word is put under both
keys, for m its own length and one more, and only words under one key are compared. That
loses no pair, and a pair found under both keys counts under the first.

Words under a key are compared as matrices of code points, padded at the end for the
common front and at the front for the common end, block against block. A key with more
words than a block is cut into blocks by hash, and every two of them meet in a tile of
their own. A tile gives each of its words the number of words near it and the best of
these; pairs are never rows. What a task holds is bounded by two blocks, whatever the
vocabulary; the work on a key grows with the square of its words, which is the price of
a dense comparison.

Roots follow forms by doubling: the form of a form is its word's next one.

Defined results: words are maximal runs of the letters of ``_letters`` within a text,
with A-Z lower-cased. A null or empty text has none. Bytes that are not UTF-8 count as
U+FFFD and so end a word. Repeated rows count again. Ties in n are won by the word that
is first in code-point order. A table without words gives an empty result. Columns other
than doc_id and the text play no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import text_batches, text_of, written
from sheaf.llm.spans import text_bytes, words_of

LENGTH = 7
"""Code points of the shortest word."""
TIMES = 2
"""A word has to occur so often."""
RATIO = 10
"""A form has to occur so many times as often as the word."""
BLOCK = 1024
"""Most words of a block, on average; fewer where they are long."""
SMALL = 48
"""Keys with no more words are compared many at a time."""
_CELLS = 1 << 24
"""Code points of the matrices that are in hand at a time, but for a block of longer words."""
SLICE_BYTES = 8 << 20


def _letters(data: np.ndarray) -> np.ndarray:
    """Bytes of A-Z, a-z and U+00C0 to U+00FF; the latter are C3 and a byte that follows it."""
    low = data | 0x20
    marked = (low >= 97) & (low <= 122)
    lead = data == 0xC3
    marked |= lead
    marked[1:] |= lead[:-1]
    return marked


def _lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data | 0x20, data)


def _counts(ids: list, texts: pa.Array, length: int, every: int | None) -> pa.RecordBatch:
    """word and n of some texts."""
    data, starts = text_bytes(texts)
    words, code, text = words_of(_lowered(data), starts, _letters)
    points = pa.compute.utf8_length(words).to_numpy()
    long = points[code] >= length
    code, text = code[long].astype("i8"), text[long]
    pairs, times = np.unique(text * max(1, len(words)) + code, return_counts=True)
    text, code = np.divmod(pairs, max(1, len(words)))
    totals: dict[str, int] = {}
    if every and len(pairs):
        raw = words.cast(pa.binary()).to_pylist()
        opening = [None if i is None else zlib.crc32(f"{i}:".encode()) for i in ids]
        sums = np.array(
            [1 if (o := opening[t]) is None else zlib.crc32(raw[c], o) for t, c in zip(text.tolist(), code.tolist())],
            dtype="i8",
        )
        hit = sums % every == 0
        for c, h, n in zip(code[hit].tolist(), sums[hit].tolist(), times[hit].tolist()):
            word = raw[c].decode()
            at = h % len(word)
            if len(word) > length:
                word = word[:at] + word[at + 1 :]
                totals[word] = totals.get(word, 0) + n
        code, times = code[~hit], times[~hit]
    n = np.bincount(code, weights=times, minlength=len(words)).astype("i8")
    some = np.flatnonzero(n)
    return pa.record_batch(
        [
            pa.concat_arrays([words.take(pa.array(some)), pa.array(totals.keys(), pa.string())]),
            pa.array(np.concatenate([n[some], np.array([*totals.values()], dtype="i8")])),
        ],
        names=["word", "n"],
    )


def word_counts(docs: DataFrame, length: int = LENGTH, times: int = TIMES, every: int | None = None) -> DataFrame:
    """word and n of the words of at least ``length`` code points that occur ``times`` times.

    With ``every``, a word of a document loses a code point where the crc32 of
    ``<doc_id>:<word>`` is a multiple of it: the code point at that number, modulo the
    word's length. A word of a row without doc_id keeps all.
    """
    texts = docs.select(docs["doc_id"].alias("id"), F.make_valid_utf8(text_of(docs)).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, SLICE_BYTES):
                yield _counts(part.column(0).to_pylist(), part.column(1), length, every)

    counted = texts.mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def _keyed(words: DataFrame) -> DataFrame:
    """side, m, part, word and n: every word under its four keys."""
    size = F.char_length("word")
    m = F.explode(F.array(size, size + 1)).alias("m")
    half = (F.col("m") / 2).cast("int")
    sides = F.array(
        F.struct(F.lit("p").alias("side"), F.substring("word", F.lit(1), half).alias("part")),
        F.struct(F.lit("s").alias("side"), F.substring("word", F.char_length("word") - F.col("m") + half + 1, F.col("m") - half).alias("part")),
    )
    return words.select("word", "n", m).select("word", "n", "m", F.inline(sides))


def _tiles(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """side, m, part, low, high, mine, word, n: what is compared, by the tile it meets in.

    A tile is a key and two of its blocks; ``mine`` is 1 for words of the second block. Keys
    under which there is nothing to compare are left out.
    """
    key = ["side", "m", "part"]
    rows = written(_keyed(words), "spelling-keys")
    whole = F.char_length("word") == F.col("m")
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("words"), F.count(F.when(whole, 1)).alias("longer"))
    sizes = sizes.where((F.col("words") > 1) & (F.col("longer") > 0))
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(float(_CELLS)) / F.col("m"))))
    sizes = sizes.select(*key, F.ceil(F.col("words") / most).cast("int").alias("blocks"))
    rows = rows.join(sizes, key)
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.select(
        "side", "m", "part", low.alias("low"), high.alias("high"),
        (F.col("mine") > low).cast("int").alias("mine"), "word", "n",
    )


class _Words:
    """Words as matrices of code points, padded on either side."""

    def __init__(self, words: pa.Array) -> None:
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), dtype="<u4")
        self.size = pa.compute.utf8_length(words).to_numpy().astype("i8")
        width = int(self.size.max(initial=0))
        # 0 pads, so a word's own U+0000 counts as another code point.
        points = points + np.uint32(1)
        kind = "u1" if points.max(initial=0) < 256 else "u4"
        row = np.repeat(np.arange(len(words)), self.size)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.front = np.zeros((len(words), width), dtype=kind)
        self.front[row, place] = points
        # Columns of ``back`` count from the end.
        self.back = np.zeros((len(words), width), dtype=kind)
        self.back[row, np.repeat(self.size, self.size) - 1 - place] = points


def _common(a: np.ndarray, b: np.ndarray, known: int, most: int) -> np.ndarray:
    """How many leading columns rows of a and b share; ``known`` are known to be shared.

    Shapes are those of numpy's broadcasting, so this is a tile or a list of pairs.
    """
    shape = np.broadcast_shapes(a.shape[:-1], b.shape[:-1])
    alike = np.ones(shape, dtype=bool)
    count = np.full(shape, known, dtype="i4" if most > 200 else "u1")
    for k in range(known, most):
        alike &= a[..., k] == b[..., k]
        if not alike.any():
            break
        count += alike
    return count


def _near(words: _Words, i: np.ndarray, j: np.ndarray, side: str, m: int) -> np.ndarray:
    """Whether words i and j, of which the longer has m code points, count as near here."""
    half = m // 2
    if side == "p":
        front = _common(words.front[i], words.front[j], half, m)
        back = _common(words.back[i], words.back[j], 0, m - half)
        return front.astype("i4") + back >= m - 1
    front = _common(words.front[i], words.front[j], 0, half)
    back = _common(words.back[i], words.back[j], m - half, m)
    # With the whole first half in common the pair counts under that.
    return (front < half) & (front.astype("i4") + back >= m - 1)


def _dense(
    words: _Words, rows: np.ndarray, split: bool, mine: np.ndarray, side: str, m: int
) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs of a tile of one block, or two, with a word of m code points in each."""
    found = []

    def compare(i: np.ndarray, j: np.ndarray, same: bool) -> None:
        if len(i) and len(j):
            near = _near(words, i[:, None], j[None, :], side, m)
            a, b = np.nonzero(np.triu(near, 1) if same else near)
            found.append((i[a], j[b]))

    long = words.size[rows] == m
    if split:
        first, second = mine == 0, mine == 1
        compare(rows[first & long], rows[second], False)
        compare(rows[first & ~long], rows[second & long], False)
    else:
        compare(rows[long], rows[long], True)
        compare(rows[long], rows[~long], False)
    if not found:
        return rows[:0], rows[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _small(words: _Words, first: np.ndarray, size: np.ndarray, side: str, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Near pairs within each of many short stretches of rows, a diagonal at a time."""
    rows = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    last = np.repeat(first + size, size)
    left, right = [rows[:0]], [rows[:0]]
    for step in range(1, int(size.max(initial=1))):
        some = rows + step < last
        rows, last = rows[some], last[some]
        i, j = rows, rows + step
        long = (words.size[i] == m) | (words.size[j] == m)
        i, j = i[long], j[long]
        near = _near(words, i, j, side, m)
        left.append(i[near])
        right.append(j[near])
    return np.concatenate(left), np.concatenate(right)


def _compared(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Near words of each word, of whole tiles with one side and one m."""
    side, m = part.column("side")[0].as_py(), part.column("m")[0].as_py()
    text = part.column("word").combine_chunks().cast(pa.string())
    n = part.column("n").to_numpy()
    mine = part.column("mine").to_numpy()
    split = part.column("low").to_numpy() != part.column("high").to_numpy()
    first = _edges(part, ("part", "low", "high"))
    size = np.diff(np.append(first, len(n)))
    words = _Words(text)
    small = (size <= SMALL) & ~split[first]
    found = [_small(words, first[small], size[small], side, m)]
    for a, s in zip(first[~small].tolist(), size[~small].tolist()):
        found.append(_dense(words, np.arange(a, a + s), split[a], mine[a : a + s], side, m))
    i = np.concatenate([x for pair in found for x in pair])
    j = np.concatenate([x for pair in found for x in pair[::-1]])
    if not len(i):
        return
    # The best near word of each: the most frequent, then the first in code-point order.
    used = np.unique(i)
    names = text.take(pa.array(used)).cast(pa.binary()).to_pylist()
    place = np.empty(len(n), dtype="i8")
    place[used[sorted(range(len(used)), key=names.__getitem__)]] = np.arange(len(used))
    order = np.lexsort((place[j], -n[j], i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.diff(i, prepend=-1))
    best = j[start]
    yield pa.record_batch(
        [
            text.take(pa.array(i[start])),
            pa.array(np.diff(np.append(start, len(i)))),
            text.take(pa.array(best)),
            pa.array(n[best]),
        ],
        names=["word", "n_near", "best", "best_n"],
    )


def _edges(part: pa.Table, columns: tuple[str, ...]) -> np.ndarray:
    """Where a row differs from the one before in one of the columns."""
    edge = np.zeros(len(part), dtype=bool)
    edge[:1] = True
    for name in columns:
        coded = part.column(name).combine_chunks().dictionary_encode().indices.to_numpy()
        edge[1:] |= coded[1:] != coded[:-1]
    return np.flatnonzero(edge)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by side, m and tile; whole tiles are worked on, some thousand words at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        rows = sum(map(len, held))
        if rows * batch.column(1)[0].as_py() < _CELLS // 16:
            continue
        part = pa.Table.from_batches(held)
        tiles = _edges(part, ("side", "m", "part", "low", "high"))
        # The last tile may go on.
        yield from _by_length(part.slice(0, tiles[-1]))
        held = part.slice(tiles[-1]).combine_chunks().to_batches()
    if held:
        yield from _by_length(pa.Table.from_batches(held))


def _by_length(part: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(part):
        return
    first = _edges(part, ("side", "m"))
    for a, b in zip(first, np.append(first[1:], len(part))):
        whole = part.slice(a, b - a)
        m = whole.column("m")[0].as_py()
        tiles = np.append(_edges(whole, ("part", "low", "high")), len(whole))
        low = 0
        while low < len(tiles) - 1:
            most = tiles[low] + max(1, _CELLS // m)
            high = max(low + 1, int(np.searchsorted(tiles, most, "right")) - 1)
            yield from _compared(whole.slice(tiles[low], tiles[high] - tiles[low]))
            low = high


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best and best_n of the words that have another one edit away.

    ``words`` has ``word``, distinct and of one code point at least, and ``n``.
    """
    tiles = _tiles(words, block)
    key = ["side", "m", "part", "low", "high"]
    met = tiles.repartition(*key).sortWithinPartitions(*key)
    found = met.mapInArrow(_compare, "word string, n_near bigint, best string, best_n bigint")
    best = F.min(F.struct(-F.col("best_n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.col("best.word").alias("best"), (-F.col("best.col1")).alias("best_n")
    )


def roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form): where forms lead, by doubling.

    A form's n is at least ``RATIO`` times its word's, so no chain returns, and their
    lengths, which rounds halve, grow with the logarithm of the largest n.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(
            now.join(ahead, "root", "left").select(
                "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
            ),
            "roots",
        )
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def spelling_groups(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of a table of distinct words and their n."""
    words = written(words, "spelling-words")
    near = near_words(words, block)
    sure = F.col("best_n") >= ratio * F.col("n")
    rows = written(
        words.join(near, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(sure, F.col("best")).alias("form"), F.when(sure, F.col("best_n")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(rows.where(F.col("form").isNotNull()))
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Every word of the corpus with its likely spelling, some of them mistyped."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return spelling_groups(word_counts(docs, every=31))
