import bisect
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheaf.llm.packing import op1_packing, pack, pack_documents, plan
from sheaf.llm.tokens import default_vocabulary, encoder
from tests.llm.cases import documents, odd_documents


def places(runs):
    return [(length, first + i, start + i, offset) for length, first, n, start, offset in runs for i in range(n)]


def check(counts, capacity, runs):
    found = places(runs)
    assert Counter((length, rank) for length, rank, _, _ in found) == Counter(
        (length, rank) for length, n in counts.items() for rank in range(n)
    )
    filled: dict[int, list] = {}
    for length, _, sequence, offset in found:
        filled.setdefault(sequence, []).append((offset, length))
    for inside in filled.values():
        at = 0
        for offset, length in sorted(inside):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@given(st.dictionaries(st.integers(1, 64), st.integers(0, 40), max_size=30), st.integers(1, 40))
@settings(max_examples=200, deadline=None)
def test_plan_places_every_item_once(counts, groups):
    check(counts, 64, plan(counts, 64, groups))


def best_fit_decreasing(lengths, capacity):
    """Sequences that plain best-fit decreasing needs."""
    rooms, used = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, length)
        if at == len(rooms):
            used += 1
            bisect.insort(rooms, capacity - length)
        else:
            bisect.insort(rooms, rooms.pop(at) - length)
    return used


def test_plan_is_as_good_as_best_fit_decreasing():
    rng = np.random.default_rng(5)
    for lengths in (
        rng.integers(1, 2049, 20_000),
        np.minimum(2048, rng.exponential(500, 20_000).astype(int) + 1),
        rng.integers(600, 1100, 5_000),
    ):
        values, n = np.unique(lengths, return_counts=True)
        used = check(dict(zip(values.tolist(), n.tolist())), 2048, plan(dict(zip(values.tolist(), n.tolist()))))
        assert used <= 1.003 * best_fit_decreasing(lengths.tolist(), 2048) + 1


def test_plan_does_not_grow_with_counts():
    small = plan({700: 30, 500: 50, 90: 70})
    large = plan({700: 30 * 10**6, 500: 50 * 10**6, 90: 70 * 10**6})
    assert len(large) <= len(small) + 50


def test_lengths_outside_the_capacity():
    with pytest.raises(ValueError):
        plan({2049: 1})
    assert plan({}) == []


def test_ids_are_those_of_the_vocabulary_file(spark):
    vocabulary, ranks = default_vocabulary()
    fast, plain = encoder(vocabulary, ranks), encoder(vocabulary)
    rng = random.Random(2)
    chars = [chr(c) for c in (*range(0, 0x250), *range(0x2010, 0x2060), 0x3042, 0x4E00, 0x1F600, 0x301)]
    texts = ["".join(rng.choices(chars, k=rng.randint(0, 60))) for _ in range(2000)]
    texts += ["<|endoftext|>", "don't we'll  a\n\n b", "\x85\xa0 x", " " * 50, "a" * 3000, "\x1c\x1d\x1e\x1f"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for text in texts:
        assert fast(text) == plain(text)


def test_pieces_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = pack_documents(docs).collect()
    encode = encoder(default_vocabulary()[0])
    want = []
    for r in docs.collect():
        ids = np.array([*encode(r.text or ""), 0], dtype="<u4")
        at, n = 0, 0
        while at < len(ids):
            size = (len(ids) - at) % 2048 or 2048
            want.append((r.doc_id, n, at, size, zlib.crc32(ids[at : at + size].tobytes())))
            at, n = at + size, n + 1
    assert Counter(tuple(r)[:5] for r in rows) == Counter(want)
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
    assert pack_documents(documents(spark, [])).count() == 0


def test_query_over_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = op1_packing(spark, folder)
    total = rows.agg(F.sum("length")).first()[0]
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert rows.select("sequence_id").distinct().count() <= 1.03 * -(-total // 2048)


def test_one_length_for_a_third_of_the_items(spark):
    items = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 700).otherwise(F.col("id") % 900 + 1).cast("bigint").alias("length"))
    rows = pack(items)
    assert rows.count() == 9000
    over = rows.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert over.where("n > 2048 OR n != end").count() == 0
