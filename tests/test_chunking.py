import random
import subprocess
import sys
from pathlib import Path

import pytest

from sheaf.operators import chunking
from sheaf.operators.chunking import chunk_bytes, overlap_tail, pack_segments, split_segments
from tests import models

PIECES = ["a", "bc", " ", "\n", "é", "　", " ", "<b>", "<", ">", "</b>", "\n", "x y"]


def texts(seed, n=400, longest=40):
    r = random.Random(seed)
    rows = [b"", b"\n", b"   "]
    rows += ["".join(r.choices(PIECES, k=r.randint(0, longest))).encode() for _ in range(n)]
    rows += [bytes(r.choices(b"<>\n \xff\xc2\xa0a", k=r.randint(0, longest))) for _ in range(n)]
    return {str(i): row for i, row in enumerate(rows)}


def table(spark, rows):
    data = [(k, len(v), v) for k, v in rows.items()]
    return spark.createDataFrame(data, "path string, size bigint, content binary")


def chunks_of(frame):
    found = {}
    for r in frame.orderBy("path", "chunk_idx").collect():
        row = (r.chunk_idx, r.start, bytes(r.content), r.start_line, r.end_line, r.token_count)
        found.setdefault(r.path, []).append(row)
    return found


def test_reference_example(spark):
    content = b"this is a longer content that should be split into multiple chunks"
    rows = chunks_of(chunk_bytes(table(spark, {"a": content}), 20, 5))["a"]
    assert [r[1] for r in rows] == [0, 15, 30, 45, 60, 61]


@pytest.mark.parametrize("size, overlap", [(20, 5), (7, 0), (5, 5), (3, 9), (16, 15), (1, 0), (10, 3)])
def test_windows(spark, size, overlap):
    rows = texts(size * 100 + overlap)
    got = chunks_of(chunk_bytes(table(spark, rows), size, overlap, gate=None))
    for path, data in rows.items():
        expected = [
            (
                i,
                a,
                models.trim(data[a:b]) + b"\n",
                1 + data[:a].count(b"\n"),
                1 + data[: b - 1].count(b"\n"),
                models.tokens(data[a:b]),
            )
            for i, (a, b) in enumerate(models.windows(len(data), size, overlap))
            if data
        ]
        assert got.get(path, []) == expected, data


def test_gate_looks_at_the_original_size(spark):
    rows = spark.createDataFrame(
        [("big", 100, b"short"), ("same", 10, b"0123456789"), ("gone", 100, b"")],
        "path string, size bigint, content binary",
    )
    assert set(chunks_of(chunk_bytes(rows, 10, 2))) == {"big"}


@pytest.mark.parametrize("size, overlap", [(-1, 0), (1, -1)])
def test_negative_options(spark, size, overlap):
    with pytest.raises(ValueError):
        chunk_bytes(table(spark, {}), size, overlap)


def test_segments(spark):
    rows = texts(1)
    found = {}
    for r in split_segments(table(spark, rows)).orderBy("path", "segment_idx").collect():
        found.setdefault(r.path, []).append((r.segment_idx, r.segment, r.size))
    for path, data in rows.items():
        expected = [
            (i, s.removesuffix(b"\n").decode("utf-8", "replace"), len(s))
            for i, s in enumerate(models.segments(data))
        ]
        if data.decode("utf-8", "ignore").encode() == data:
            assert found.get(path, []) == expected, data
        else:
            assert [s[2] for s in found.get(path, [])] == [s[2] for s in expected]


@pytest.mark.parametrize("size, tokens", [(20, 5), (0, 3), (7, 0), (1, 1), (0, 0)])
def test_packs(spark, size, tokens):
    rows = texts(size * 100 + tokens)
    got = chunks_of(pack_segments(table(spark, rows), size, tokens))
    for path, data in rows.items():
        at, expected = 0, []
        for i, pack in enumerate(models.packs(models.segments(data), size, tokens)):
            end = at + len(pack)
            count = sum(map(models.tokens, models.segments(pack)))
            lines = 1 + data[:at].count(b"\n"), 1 + data[: end - 1].count(b"\n")
            expected.append((i, at, pack, *lines, count))
            at = end
        assert got.get(path, []) == expected, data


def test_packs_longer_than_a_block(spark):
    data = b"".join(b"word %d\n" % i for i in range(3000))
    rows = chunks_of(pack_segments(table(spark, {"a": data}), 5000, 0))["a"]
    assert [r[2] for r in rows] == models.packs(models.segments(data), 5000, 0)


def test_one_large_document(spark):
    data = (b"word " * 9 + b"\n") * 90_000
    rows = chunk_bytes(table(spark, {"a": data}), 256, 32).selectExpr(
        "count(*) AS n", "max(end_line) AS lines", "max(start) AS last"
    )
    assert tuple(rows.first()) == (len(models.windows(len(data), 256, 32)), 90_000, len(data) - 32)


@pytest.mark.parametrize("size, overlap", [(20, 5), (7, 0), (5, 5), (3, 9), (16, 15), (10, 3), (4, 60)])
def test_windows_in_small_blocks(spark, monkeypatch, size, overlap):
    """Blocks of three windows give what one block gives, lines and last window included."""
    rows = texts(size * 7 + overlap, n=150)
    whole = chunks_of(chunk_bytes(table(spark, rows), size, overlap, gate=None))
    monkeypatch.setattr(chunking, "_FEWEST", 1)
    monkeypatch.setattr(chunking, "_MOST", 3)
    assert chunks_of(chunk_bytes(table(spark, rows), size, overlap, gate=None)) == whole


LARGE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from sheaf.operators import chunking
from sheaf.operators.chunking import chunk_bytes
from sheaf.session import build_session
spark = build_session("local[2]", **{{"spark.driver.memory": "1g"}})
line = F.lit(b"0123456789abcde" + bytes([10]))
docs = spark.range(1).select(F.col("id").alias("path"), F.unhex(F.repeat(F.hex(line), {n} // 16)).alias("content"))
rows = chunk_bytes(docs, {size}, {overlap}, gate=None)
found = rows.agg(
    F.count("*"), F.countDistinct("chunk_idx"), F.sum("start"), F.sum("start_line"), F.sum("end_line"), F.max("end_line")
).first()
print("found", *found)
"""


@pytest.mark.parametrize("n, size, overlap", [(4 << 20, 64, 64), (1 << 18, 300, 299)])
def test_windows_that_move_by_a_byte_in_a_heap_of_1_gib(n, size, overlap):
    """Millions of windows of one document: only blocks of them are held at a time."""
    code = LARGE.format(repo=str(Path(__file__).parent.parent), n=n, size=size, overlap=overlap)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=900)
    spans = models.windows(n, size, overlap)
    lines = [1 + a // 16 for a, _ in spans], [1 + (b - 1) // 16 for _, b in spans]
    want = len(spans), len(spans), sum(a for a, _ in spans), sum(lines[0]), sum(lines[1]), n // 16
    assert f"found {' '.join(map(str, want))}" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize(
    "content, overlap, expected",
    [
        (b"", 5, b""),
        (b"abc", 0, b""),
        (b"abc", 10, b"abc"),
        (b"ab\ncd", 4, b"cd"),
        (b"ab\ncd\nef", 6, b"cd\nef"),
        (b"ab\n", 2, b""),
        ("é".encode(), 1, b"\xa9"),
    ],
)
def test_overlap_tail(spark, content, overlap, expected):
    assert bytes(overlap_tail(table(spark, {"a": content}), overlap).first().overlap_tail) == expected


@pytest.mark.parametrize("line", [b"<no end\n", b"<b>x</b> <\n", b"<p>\n"])
def test_segments_of_a_large_document_without_closing_marks(spark, line):
    data = b"<a>\n" + line * 300_000
    frame = table(spark, {"a": data})
    assert split_segments(frame).count() == len(models.segments(data[:4] + line * 30)) // 30 * 300_000 + 1
    assert pack_segments(frame).selectExpr("sum(octet_length(content)) AS n").first().n == len(data)
