import random

import pytest

from sheaf.operators.enrich import strip_comments
from tests import models


def stripped(spark, rows):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, content binary")
    got = {r.i: bytes(r.content) for r in strip_comments(frame, max_line_bytes=65536).collect()}
    return [got[i] for i in range(len(rows))]


def test_go_file(spark):
    source = (
        b"package main\n\n// This is a comment\nfunc main() {\n"
        b'    // Another comment\n    println("Hello, World!")\n}'
    )
    expected = b'package main\n\nfunc main() {\n    println("Hello, World!")\n}'
    assert stripped(spark, [source]) == [expected]


EDGES = {
    b"": b"",
    b"\n": b"",
    b"a\n": b"a",
    b"a  \n": b"a  ",
    b"\na": b"\n\na",
    b"\n\n \na": b"\n\na",
    b"a\n\n\n\nb": b"a\n\nb",
    b"a\n\n// x\n\nb": b"a\n\nb",
    b"// only\n/* comments\n*/": b"",
    b"a /* b */ c\nd": b"a",  # the block stays open
    b"a /* b\nc */ d\ne": b"a\nd\ne",
    b"a /* b\n  c */  d  \ne": b"a\n  d\ne",
    b"a /* b\n\nc */ d": b"a\n\nd",
    b"a /* b\n\nc */\nd": b"a\n\nd",
    b"a /* b\nc */ /* d\ne */ f": b"a\nf",
    b"a /* b\nc */ d /* e\nf */ g": b"a\nd\ng",
    b"x = 'http://x'; // y": b"x = 'http:",
    b"a //* b\nc": b"a /",
    b"  a\t// b": b"  a",
    b"a\r\nb // c\r\n\r\nd\r\n": b"a\nb\n\nd",
    b"a\r\r\nb": b"a\r\nb",
    b"# hash\n# stays": b"# hash\n# stays",
    "a // b".encode(): b"a",
    "　a // b".encode(): b"a",
    b"\xff\xfe // b\n\xc3": b"\xff\xfe\n\xc3",  # not UTF-8
    b"x" * 65535 + b"\n// y": b"x" * 65535,
    b"x" * 65536 + b"\n// y": b"x" * 65536 + b"\n// y",
}


def test_edges(spark):
    assert dict(zip(EDGES, stripped(spark, list(EDGES)))) == EDGES
    assert {k: models.strip_comments(k) for k in EDGES} == EDGES


def test_long_lines_are_stripped_unless_limited(spark):
    frame = spark.createDataFrame([(b"x" * 70000 + b" // y\n// z\n",)], "content binary")
    assert bytes(strip_comments(frame).first().content) == b"x" * 70000
    assert bytes(strip_comments(frame, max_line_bytes=65536).first().content).endswith(b"// z\n")


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(spark, seed):
    r = random.Random(seed)
    pieces = [
        b"/*", b"*/", b"//", b"\n", b"\n", b"\n", b" ", b"\t", b"a", b"b c", b"/", b"*", b"\r\n", b"\r",
        " ".encode(), "　".encode(), "é".encode(), b"\x0b", " ".encode(), b"\xff", b"\xc2",
    ]
    rows = [b"".join(r.choices(pieces, k=r.randint(0, 24))) for _ in range(20_000)]
    for source, got in zip(rows, stripped(spark, rows)):
        assert got == models.strip_comments(source), source


@pytest.mark.parametrize(
    "source",
    [
        b"x /*\n" + b"line of comment\n" * 200_000 + b"  */ y\n" + b"\n" * 100_000 + b"z",
        b"\xff/*\n" + b"line of comment\n" * 200_000 + b"  */ y\n" + b"\n" * 100_000 + b"z",
        b"/* x\n" * 600_000,
        (b" " * 60_000 + b"x\n") * 60,
    ],
    ids=["block", "block-bytes", "reopened", "spaces"],
)
def test_large_files_neither_overflow_nor_stall(spark, source):
    assert stripped(spark, [source]) == [models.strip_comments(source)]
