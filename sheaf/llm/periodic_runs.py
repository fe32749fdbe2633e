"""Maximal periodic runs of words, by suffix trees and Lyndon roots.

A run with smallest period q and at least twice that length starts each of its periods
with a Lyndon word under one of the two orders of its words: the longest Lyndon word that
starts there. The longest Lyndon word at a place ends before the next place whose suffix
is smaller, so every place gives one candidate period under either order. A candidate is
extended to the right by the longest common extension of two suffixes, and to the left
by that of two suffixes of the reversal. Both come from suffix trees built by Ukkonen's
algorithm: an Euler tour with a sparse table of minima finds the lowest common ancestor
of two leaves in constant time, and its depth is the extension.

Every word of a run of ``least`` words is covered by a short stretch (``least // 2``
words) that occurs twice in the document: the first copies reach the run's last period
and the second copies begin after its first. So a stretch of words that no such repeat
covers is folded into one symbol that occurs nowhere else, which no run can hold and none
can cross. No run is lost or cut short, and the trees are as large as what repeats.

Documents are rows of their own and never meet, so nothing is shuffled. Memory is a few
megabytes a batch, and about a kilobyte for each word of the document in hand that is
covered by repeats.

Defined results: words are stretches of anything but ASCII white space. A null, empty or
wordless text has no words, no runs and an empty collapsed text. Bytes that are not UTF-8
count as U+FFFD. Repeated rows are documents of their own. Columns other than the key and
the text play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import text_batches, text_of
from sheaf.llm.shingles import mix
from sheaf.llm.spans import joined_by_space, text_bytes, words_of

LEAST = 12
"""Words of the shortest run."""
SLICE_BYTES = 4 << 20


def _word_bytes(data: np.ndarray) -> np.ndarray:
    return (data != 32) & ((data < 9) | (data > 13))


class SuffixTree:
    """Ukkonen's tree of a list of symbols whose last one occurs nowhere else."""

    def __init__(self, symbols: list[int]) -> None:
        n = len(symbols)
        self.n = n
        base = max(symbols) + 1
        start, end, link = [0], [0], [0]
        child: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, symbol in enumerate(symbols):
            waiting += 1
            made = 0
            while waiting:
                if not length:
                    edge = i
                key = node * base + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if made:
                        link[made] = node
                        made = 0
                else:
                    first = start[below]
                    size = end[below] - first
                    if length >= size:
                        edge += size
                        length -= size
                        node = below
                        continue
                    if symbols[first + length] == symbol:
                        length += 1
                        if made and node:
                            link[made] = node
                        break
                    # The edge parts: its upper piece becomes a node with two children.
                    part = len(start)
                    child[key] = part
                    start += (first, i)
                    end += (first + length, n)
                    link += (0, 0)
                    child[part * base + symbol] = part + 1
                    start[below] = first + length
                    child[part * base + symbols[first + length]] = below
                    if made:
                        link[made] = part
                    made = part
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self._walk(np.array(start), np.array(end), child, base)

    def _walk(self, start: np.ndarray, end: np.ndarray, child: dict[int, int], base: int) -> None:
        """Euler tour in order of the symbols: depths, leaves' places and ranks."""
        nodes, n = len(start), self.n
        keys = np.fromiter(child.keys(), dtype="i8", count=len(child))
        ends = np.fromiter(child.values(), dtype="i8", count=len(child))
        order = np.argsort(keys)
        parents = keys[order] // base
        heirs = ends[order].tolist()
        low = np.searchsorted(parents, np.arange(nodes))
        at, stop = low.tolist(), np.append(low[1:], len(heirs)).tolist()
        sizes = (end - start).tolist()
        depth = [0] * nodes
        tour: list[int] = [0]
        leaf_at = [0] * n
        rank = [0] * n
        path = [0]
        ranked = 0
        while path:
            node = path[-1]
            k = at[node]
            if k == stop[node]:
                path.pop()
                if path:
                    tour.append(depth[path[-1]])
                continue
            at[node] = k + 1
            heir = heirs[k]
            deep = depth[heir] = depth[node] + sizes[heir]
            if at[heir] == stop[heir]:
                leaf = n - deep
                leaf_at[leaf] = len(tour)
                rank[leaf] = ranked
                ranked += 1
                tour += (deep, depth[node])
            else:
                path.append(heir)
                tour.append(deep)
        self.rank = rank
        self._leaf_at = np.array(leaf_at)
        level = np.array(tour, dtype="i4")
        self._minima = [level]
        step = 1
        while len(level) > step:
            level = np.minimum(level[:-step], level[step:])
            self._minima.append(level)
            step *= 2

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols the suffixes at i and at j, which differ, have in common."""
        a, b = self._leaf_at[i], self._leaf_at[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(b - a + 1)[1] - 1
        out = np.zeros(len(a), dtype="i8")
        for k in np.unique(level):
            some = level == k
            row = self._minima[k]
            out[some] = np.minimum(row[a[some]], row[b[some] - (1 << int(k)) + 1])
        return out


def next_past(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each place the next one of smaller rank, and of larger; the end if there is none."""
    n = len(rank)
    smaller, larger = [n] * n, [n] * n
    falling: list[int] = []
    rising: list[int] = []
    for i, r in enumerate(rank):
        while rising and rank[rising[-1]] > r:
            smaller[rising.pop()] = i
        while falling and rank[falling[-1]] < r:
            larger[falling.pop()] = i
        rising.append(i)
        falling.append(i)
    return smaller, larger


def runs_of(symbols: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, length, period) of all maximal runs of ``least`` symbols, by start and period."""
    n = len(symbols)
    if n < max(2, least):
        return np.zeros((0, 3), dtype="i8")
    own = np.unique(symbols, return_inverse=True)[1] + 1
    ahead = SuffixTree([*own.tolist(), 0])
    back = SuffixTree([*own[::-1].tolist(), 0])
    found = []
    for after in next_past(ahead.rank):
        i = np.arange(n)
        j = np.array(after[:n])
        # A run starts at or before i and holds two periods, all within the document.
        some = (j <= n) & (2 * (j - i) <= n)
        i, j = i[some], j[some]
        right = ahead.extension(i, j)
        left = np.zeros(len(i), dtype="i8")
        inner = i > 0
        left[inner] = back.extension(n - i[inner], n - j[inner])
        start, length, period = i - left, j - i + left + right, j - i
        whole = (length >= 2 * period) & (length >= least)
        found.append(np.stack([start[whole], length[whole], period[whole]], axis=1))
    every = np.unique(np.concatenate(found), axis=0)
    return every[np.lexsort((every[:, 2], every[:, 0]))]


def covered(codes: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """Which words are part of a stretch of ``size`` words that occurs twice in its text.

    Stretches are compared by a hash of 64 bits, so a few others may be marked as well.
    """
    n = len(codes)
    marks = np.zeros(n + 1, dtype="i8")
    if n >= size:
        one = mix(codes.astype("u8") + np.uint64(1))
        whole = np.zeros(n - size + 1, dtype="u8")
        for k in range(size):
            whole = whole * np.uint64(0x9E3779B97F4A7C15) + one[k : n - size + 1 + k]
        place = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
        whole = mix(whole[place] ^ mix(text[place].astype("u8") + np.uint64(1 << 40)))
        order = np.argsort(whole)
        same = whole[order[1:]] == whole[order[:-1]]
        twice = np.unique(place[np.concatenate([order[1:][same], order[:-1][same]])])
        np.add.at(marks, twice, 1)
        np.add.at(marks, twice + size, -1)
    return np.cumsum(marks)[:n] > 0


def folded(codes: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words to keep, and one symbol of its own for each stretch between; their places."""
    first = np.flatnonzero(keep | np.concatenate([[True], keep[:-1]]))
    symbols = codes[first].astype("i8")
    rest = ~keep[first]
    symbols[rest] = -1 - np.arange(rest.sum())
    return symbols, first


def _text_runs(codes: np.ndarray, keep: np.ndarray, least: int) -> np.ndarray:
    if not keep.any():
        return np.zeros((0, 3), dtype="i8")
    symbols, place = folded(codes, keep)
    runs = runs_of(symbols, least)
    runs[:, 0] = place[runs[:, 0]]
    return runs


_SCHEMA = "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"


def periodic_runs(docs: DataFrame, key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """key, n_words, runs (start, length, period; by start and period) and collapsed text.

    The collapsed text has one space between words and of each run its first period only.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    texts = docs.select(docs[key].alias("key"), F.make_valid_utf8(text_of(docs)).alias("text"))
    name = texts.schema["key"].dataType.simpleString()
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_batches(batch, SLICE_BYTES):
                counts, runs, collapsed = _of_texts(part.column(1), least)
                places = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype("i4")
                flat = np.concatenate([*runs, np.zeros((0, 3), dtype="i8")])
                lists = pa.ListArray.from_arrays(
                    pa.array(places), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(struct))
                )
                yield pa.record_batch([part.column(0), pa.array(counts), lists, collapsed], [key, "n_words", "runs", "collapsed"])

    return texts.mapInArrow(search, f"`{key}` {name}, {_SCHEMA}")


def _of_texts(texts: pa.Array, least: int) -> tuple[np.ndarray, list[np.ndarray], pa.Array]:
    """Of each text the number of words, the runs and the collapsed text."""
    data, starts = text_bytes(texts)
    words, code, text = words_of(data, starts, _word_bytes)
    counts = np.bincount(text, minlength=len(texts))
    ends = np.cumsum(counts)
    marked = covered(code, text, least // 2)
    runs = [np.zeros((0, 3), dtype="i8")] * len(texts)
    dropped = np.zeros(len(code) + 1, dtype="i8")
    for k in np.unique(text[marked]):
        low, high = ends[k] - counts[k], ends[k]
        found = runs[k] = _text_runs(code[low:high], marked[low:high], least)
        np.add.at(dropped, low + found[:, 0] + found[:, 2], 1)
        np.add.at(dropped, low + found[:, 0] + found[:, 1], -1)
    stay = np.cumsum(dropped)[:-1] == 0
    return counts, runs, joined_by_space(words, code[stay], text[stay], len(texts))


def planted(docs: DataFrame) -> Column:
    """The text of a document; one in ten is made to repeat itself from some word on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text_of(docs), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        tail = F.slice(w, a + 1, p)
        # The first period, as often as it takes, and then as much of it as is left.
        rest = F.slice(F.flatten(F.array_repeat(tail, F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
        return F.array_join(F.concat(F.slice(w, F.lit(1), a), rest), " ")

    changed = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit(""))), 1)
    return F.when(h % 10 == 0, changed).otherwise(text_of(docs))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document its runs, the longest, and digests of all and of what is left."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = periodic_runs(docs.select("doc_id", planted(docs).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"])))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = rows.withColumn("longest", longest)
    start, length, period = -F.col("longest.col2"), F.col("longest.length"), -F.col("longest.col3")
    return rows.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
