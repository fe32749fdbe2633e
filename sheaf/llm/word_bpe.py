"""Byte-level BPE by a global shuffle of distinct words; decoding by the token-byte table.

A pre-token's ids do not depend on what stands around it, so no pre-token is encoded
twice. Documents are dealt with in blocks of bounded size. A block's pre-tokens are
exploded into one row for each that is distinct in the block, with its code; the
positions stay with the block as the sequence of codes, document by document. Rows of
all blocks are shuffled and sorted by word, so each distinct word is encoded once. Its ids
are exploded with their places, and the table of the tokens' bytes, whose size is that of
the vocabulary, is joined to them, which decodes the word. Ids and bytes go back to the
blocks the word came from, where the codes put them in place.

Documents are read and cut twice, once for their words and once for their codes, because
keeping either in between takes more disk than the texts themselves. They have to come
in the same order both times, as from files; each block checks that they did.

What the pattern's classes hold (letters, numbers, white space) is asked of the encoding
library itself, one question for all code points, so that no other Unicode version can
disagree. Cutting is then a matter of where classes change.

Defined results: a null text is an empty one and has no ids. Bytes that are not UTF-8
become U+FFFD, as ``make_valid_utf8`` has it, before they are encoded. Repeated rows are
documents of their own. Strings of special tokens are ordinary text. A long run without
a break is one word, however long. Columns other than the key and the text play no part.
An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import text_batches, text_of
from sheaf.llm.spans import cut, text_bytes

BLOCK_BYTES = 64 << 20
"""Text of a block, but for a longer document."""
SLICE_BYTES = 4 << 20
"""Text that is cut at a time, and about as many bytes that are put together at a time."""

_AT_ONCE = 1 << 18
"""Words whose places are worked out together."""
_ROWS_BACK = 4 << 20
"""Ids that are gathered before they go back to their blocks."""

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def _merges(ranks: str) -> dict[bytes, int]:
    with open(ranks, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def _encoding(ranks: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_merges(ranks), special_tokens={}
    )


@functools.lru_cache(maxsize=1)
def class_ranges() -> tuple[tuple[int, int, int], ...]:
    """(first, last, class) of all code points that are letters, numbers or white space.

    An encoding whose pattern is one class returns the bytes of that class's characters.
    """
    import tiktoken

    points = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    every = "".join(map(chr, points))
    singles = {bytes([i]): i for i in range(256)}
    out = []
    for kind, pattern in ((_SPACE, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        asked = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=singles, special_tokens={})
        found = np.frombuffer(bytes(asked.encode_ordinary(every)).decode().encode("utf-32-le"), dtype="<u4")
        first = np.flatnonzero(np.diff(found, prepend=-2) != 1)
        last = np.append(first[1:], len(found)) - 1
        out += [(int(found[a]), int(found[b]), kind) for a, b in zip(first, last)]
    return tuple(out)


@functools.lru_cache(maxsize=1)
def _classes(ranges: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    table = np.full(0x110000, _OTHER, dtype="u1")
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    return table


def pre_tokens(data: np.ndarray, starts: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens start, with the end, of texts that stand in a row.

    A pre-token is a run of one class with the space before it, white space without its
    last character where something follows, that character, or one of the endings
    ``'s 't 're 've 'm 'll 'd``, which has to start at an apostrophe of its own.
    """
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
    n = len(points)
    if n == len(data):
        place = np.arange(n + 1)
        first = starts[:-1]
    else:
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        first = np.searchsorted(place, starts[:-1])
    kind = classes[points]
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    run = opens[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    begins = run.copy()
    after = np.flatnonzero(run & (kind != _SPACE) & ~opens[:n])
    after = after[kind[after - 1] == _SPACE]
    begins[after - 1] = True
    begins[after[points[after - 1] == 32]] = False
    quote = np.flatnonzero((points[: n - 1] == 39) & begins[: n - 1])
    quote = quote[~opens[quote + 1]]
    one = points[quote + 1]
    more = np.minimum(quote + 2, n - 1)
    two = np.where((quote + 2 < n) & ~opens[quote + 2], points[more], 0)
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    for ends, size in ((quote[short], 2), (quote[long], 3)):
        begins[ends + 1] = False
        rest = ends + size
        begins[rest[rest < n]] = True
    return np.append(place[:n][begins], len(data))


class _Block:
    """Documents whose words share one dictionary."""

    def __init__(self, number: int) -> None:
        self.number, self.bytes = number, 0
        self.hash = hashlib.blake2b(digest_size=8)
        self.keys: list[pa.Array] = []
        self.sizes: list[np.ndarray] = []
        self.words: list[pa.DictionaryArray] = []

    def add(self, keys: pa.Array, texts: pa.Array, classes: np.ndarray) -> None:
        data, starts = text_bytes(texts)
        bounds = pre_tokens(data, starts, classes)
        self.bytes += len(data)
        self.hash.update(data)
        self.keys.append(keys)
        self.sizes.append(np.diff(np.searchsorted(bounds, starts)).astype("i4"))
        self.words.append(cut(data, bounds).dictionary_encode())

    def coded(self) -> tuple[pa.Array, list[np.ndarray]]:
        """The block's distinct words, the most frequent first, and each slice's codes."""
        parts = pa.chunked_array(self.words).unify_dictionaries().chunks
        words = parts[0].dictionary
        codes = [p.indices.to_numpy() for p in parts]
        counts = sum(np.bincount(c, minlength=len(words)) for c in codes)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), dtype="i4")
        rank[order] = np.arange(len(words))
        return words.take(pa.array(order)), [rank[c] for c in codes]

    def check(self) -> int:
        return int.from_bytes(self.hash.digest(), "little", signed=True)

    def word_rows(self) -> Iterator[pa.RecordBatch]:
        words, _ = self.coded()
        for low in range(0, len(words), 1 << 16):
            some = words.slice(low, 1 << 16)
            n = len(some)
            yield pa.record_batch(
                [
                    pa.array(np.full(n, self.number)), pa.array(np.full(n, self.check())),
                    pa.array(np.arange(low, low + n, dtype="i4")), some,
                ],
                names=["block", "check", "code", "word"],
            )

    def document_rows(self) -> Iterator[pa.RecordBatch]:
        for keys, sizes, code in zip(self.keys, self.sizes, self.coded()[1]):
            yield pa.record_batch(
                [
                    pa.array([self.number]), pa.array([self.check()]),
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([packed(sizes)]), pa.array([packed(code)]),
                ],
                names=["block", "check", "keys", "sizes", "codes"],
            )


def packed(numbers: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed, after their count."""
    planes = numbers.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.frombuffer(planes, dtype="u1").reshape(4, n).T.copy().view("<u4").ravel()


def _cut_up(docs: DataFrame, key: str, rows: Callable[[_Block], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """What ``rows`` makes of each block; blocks are the same whenever docs are read."""
    text = F.make_valid_utf8(text_of(docs))
    texts = docs.select(docs[key].alias("key"), text.alias("text"), F.spark_partition_id().alias("part"))
    ranges = class_ranges()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _classes(ranges)
        block = None
        for batch in batches:
            for part in text_batches(batch, SLICE_BYTES):
                if block is None:
                    block = _Block(part.column(2)[0].as_py() << 32)
                elif block.bytes + part.nbytes > BLOCK_BYTES:
                    yield from rows(block)
                    block = _Block(block.number + 1)
                block.add(part.column(0), part.column(1), classes)
        if block:
            yield from rows(block)

    return texts.mapInArrow(work, ddl)


def pre_token_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """block, check, code and word: the distinct pre-tokens of every block."""
    return _cut_up(docs, key, _Block.word_rows, "block bigint, check bigint, code int, word string")


def encode_words(rows: DataFrame, ranks: str) -> DataFrame:
    """place, id and at of the ids of every distinct word of ``pre_token_rows``.

    A word's rows follow one another; the one of place 0 has in ``at`` the blocks and codes
    of the word.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks).encode_ordinary
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not len(batch):
                continue
            rows = pa.Table.from_batches([*held, batch] if batch else held) if batch or held else None
            if rows is None:
                return
            rows = rows.combine_chunks()
            word = rows.column("word").chunk(0).dictionary_encode()
            # Sorted by word, so a word's rows are together; the last word's may go on.
            first = np.flatnonzero(np.diff(word.indices.to_numpy(), prepend=-1))
            done = int(first[-1]) if batch else len(rows)
            held = rows.slice(done).to_batches() if batch else []
            first = first[first < done]
            if not len(first):
                continue
            ids = [encode(w) for w in rows.column("word").chunk(0).take(pa.array(first)).to_pylist()]
            size = np.array([len(i) for i in ids])
            start = np.cumsum(size) - size
            count = np.zeros(size.sum(), dtype="i8")
            count[start] = np.diff(np.append(first, done))
            at = pa.StructArray.from_arrays(
                [rows.column(c).chunk(0).slice(0, done) for c in ("block", "check", "code")], ["block", "check", "code"]
            )
            yield pa.record_batch(
                [
                    pa.array((np.arange(size.sum()) - np.repeat(start, size)).astype("i4")),
                    pa.array(np.fromiter(itertools.chain.from_iterable(ids), dtype="i4", count=size.sum())),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype("i4")), at),
                ],
                names=["place", "id", "at"],
            )

    together = rows.repartition("word").sortWithinPartitions("word")
    return together.mapInArrow(encoded, "place int, id int, at array<struct<block:bigint,check:bigint,code:int>>")


def token_table(spark: SparkSession, ranks: str) -> DataFrame:
    """id and bytes of every token: as many rows as the vocabulary file has."""
    lines = spark.createDataFrame(
        pa.table({"id": pa.array(_merges(ranks).values(), pa.int32()), "bytes": pa.array(_merges(ranks).keys(), pa.binary())})
    )
    return lines.select("id", "bytes")


def decode(rows: DataFrame, key: str, ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """key and decoded (binary) of rows with an array of ids; each key stands in one row.

    A null or empty array decodes to no bytes; an id that no token has is left out.
    """
    tokens = token_table(rows.sparkSession, ranks or default_ranks())
    placed = rows.select(key, F.posexplode_outer(ids).alias("place", "id"))
    # The table has a row per token of the vocabulary, whatever the corpus.
    known = placed.join(F.broadcast(tokens), "id", "left")
    whole = F.sort_array(F.collect_list(F.struct("place", F.coalesce("bytes", F.lit(b"")).alias("bytes"))))
    return known.groupBy(key).agg(whole.alias("parts")).select(
        key, F.aggregate("parts", F.lit(b""), lambda done, part: F.concat(done, part["bytes"])).alias("decoded")
    )


def _sent_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``encode_words`` with the tokens' bytes, as a row per block with all its words."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= _ROWS_BACK:
            part = pa.Table.from_batches(held)
            first = np.flatnonzero(part.column("place").to_numpy() == 0)
            yield from _by_block(part.slice(0, first[-1]))
            held = part.slice(first[-1]).combine_chunks().to_batches()
            rows = sum(map(len, held))
    if held:
        yield from _by_block(pa.Table.from_batches(held))


def _by_block(part: pa.Table) -> Iterator[pa.RecordBatch]:
    if not len(part):
        return
    part = part.combine_chunks()
    place = part.column("place").to_numpy()
    first = np.flatnonzero(place == 0)
    size = np.diff(np.append(first, len(place)))
    if not np.array_equal(place, np.arange(len(place)) - np.repeat(first, size)):
        raise ValueError("the ids of a word came out of order")
    raw = part.column("bytes").chunk(0).cast(pa.binary())
    length = pa.compute.binary_length(raw).to_numpy()
    ids = Ragged(part.column("id").to_numpy().astype("<u4"), size)
    bytes_of = Ragged(np.frombuffer(b"".join(raw.to_pylist()), dtype="u1"), np.add.reduceat(length, first))
    at = part.column("at").chunk(0)
    word = np.repeat(np.cumsum(place == 0) - 1, pa.compute.list_value_length(at).to_numpy())
    block, check, code = (at.flatten().field(k).to_numpy() for k in range(3))
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.diff(block[order], prepend=-1))
    for low, high in zip(edges, np.append(edges[1:], len(order))):
        some = order[low:high]
        yield pa.record_batch(
            [
                pa.array([block[some[0]]]), pa.array([check[some[0]]]), pa.array([packed(code[some])]),
                pa.array([packed(ids.sizes[word[some]])]), pa.array([packed(ids.laid(word[some]))]),
                pa.array([packed(bytes_of.sizes[word[some]])]),
                pa.array([pa.compress(bytes_of.laid(word[some]).tobytes(), codec="zstd", asbytes=True)]),
            ],
            names=["block", "check", "words", "id_sizes", "ids", "byte_sizes", "bytes"],
        )


def encode(docs: DataFrame, key: str = "doc_id", ranks: str | None = None) -> DataFrame:
    """key, n_tokens, ids (little-endian unsigned 32-bit) and decoded (binary) of each row.

    ``decoded`` is what the ids decode to by the tokens' bytes.
    """
    ranks = ranks or default_ranks()
    coded = encode_words(pre_token_rows(docs, key), ranks)
    # The table has a row per token of the vocabulary, whatever the corpus.
    known = coded.join(F.broadcast(token_table(docs.sparkSession, ranks)), "id")
    back = known.select("place", "id", "bytes", "at").mapInArrow(
        _sent_back,
        "block bigint, check bigint, words binary, id_sizes binary, ids binary, byte_sizes binary, bytes binary",
    )
    kind = docs.schema[key].dataType.simpleString()
    texts = _cut_up(
        docs, key, _Block.document_rows, f"block bigint, check bigint, keys array<{kind}>, sizes binary, codes binary"
    )
    # Null arrays in a row are slow to hand to Python, so words have an empty one.
    rows = back.withColumn("keys", F.array().cast(f"array<{kind}>")).unionByName(texts, allowMissingColumns=True)
    rows = rows.repartition("block").sortWithinPartitions("block", F.asc_nulls_first("codes"))
    columns = ["block", "check", "words", "id_sizes", "ids", "byte_sizes", "bytes", "keys", "sizes", "codes"]
    named = functools.partial(_put_together, key)
    return rows.select(columns).mapInArrow(named, f"`{key}` {kind}, n_tokens bigint, ids binary, decoded binary")


def _put_together(key: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by block, words before documents."""
    block, table = None, _Table()
    for batch in batches:
        for i in range(len(batch)):
            row = batch.slice(i, 1)
            if row.column("block")[0].as_py() != block:
                block, table = row.column("block")[0].as_py(), _Table()
            if row.column("codes")[0].is_valid:
                yield from table.documents(row, key)
            else:
                table.add(row)


class Ragged:
    """Rows of different lengths in one array, that can be taken and laid end to end."""

    def __init__(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.values, self.sizes = values, sizes.astype("i8")
        self.place = np.cumsum(self.sizes) - self.sizes

    def numbered(self, order: np.ndarray) -> None:
        """From now on row k is the one that was ``order[k]``."""
        self.sizes, self.place = self.sizes[order], self.place[order]

    def laid(self, rows: np.ndarray) -> np.ndarray:
        out = [self.values[:0]]
        for low in range(0, len(rows), _AT_ONCE):
            some = rows[low : low + _AT_ONCE]
            n = self.sizes[some]
            before = np.cumsum(n) - n
            out.append(self.values[np.repeat(self.place[some] - before, n) + np.arange(n.sum())])
        return np.concatenate(out)


class _Table:
    """A block's words: their ids and bytes."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.checks: set[int] = set()
        self.ids: Ragged | None = None

    def add(self, row: pa.RecordBatch) -> None:
        self.checks.add(row.column("check")[0].as_py())
        words, id_sizes, ids, sizes = (unpacked(row.column(c)[0].as_py()) for c in ("words", "id_sizes", "ids", "byte_sizes"))
        raw = pa.decompress(row.column("bytes")[0].as_py(), decompressed_size=int(sizes.sum()), codec="zstd", asbytes=True)
        self.parts.append((words, id_sizes, ids, sizes, np.frombuffer(raw, dtype="u1")))

    def documents(self, row: pa.RecordBatch, key: str) -> Iterator[pa.RecordBatch]:
        sizes = unpacked(row.column("sizes")[0].as_py()).astype("i8")
        codes = unpacked(row.column("codes")[0].as_py())
        if self.ids is None:
            none = np.zeros(0, dtype="<u4")
            words, id_sizes, ids, byte_sizes, raw = (
                np.concatenate(c) for c in zip(*(self.parts or [(none, none, none, none, none.view("u1"))]))
            )
            order = np.argsort(words)
            self.ids, self.raw = Ragged(ids, id_sizes), Ragged(raw, byte_sizes)
            self.ids.numbered(order)
            self.raw.numbered(order)
            self.parts = []
        if len(codes) and self.checks != {row.column("check")[0].as_py()}:
            raise ValueError("documents came in another order the second time; encode a written table")
        before = np.concatenate([[0], np.cumsum(sizes)])
        ids_at = np.concatenate([[0], np.cumsum(self.ids.sizes[codes])])[before]
        raw_at = np.concatenate([[0], np.cumsum(self.raw.sizes[codes])])[before]
        ids, raw = self.ids.laid(codes), self.raw.laid(codes)
        yield pa.record_batch(
            [
                row.column("keys").flatten(), pa.array(np.diff(ids_at)),
                _binary(ids.view("u1"), ids_at * 4), _binary(raw, raw_at),
            ],
            names=[key, "n_tokens", "ids", "decoded"],
        )


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    places = pa.py_buffer(bounds.astype("i4"))
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, places, pa.py_buffer(np.ascontiguousarray(data))])


def op13_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Of every document: how many ids, and digests of the ids and of what they decode to."""
    rows = encode(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
