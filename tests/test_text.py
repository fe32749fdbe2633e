import pytest
from pyspark.sql import functions as F

from sheaf.functions import text
from sheaf.functions.constants import SPACE_CLASS
from sheaf.operators.enrich import with_line_count, with_token_count
from sheaf.operators.filters import gate_processable, with_is_binary
from tests import models


def column(spark, rows, use, kind="binary"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, content {kind}")
    return [r.x for r in frame.select("i", use(F.col("content")).alias("x")).orderBy("i").collect()]


def test_space_predicate_is_the_fixed_set(spark):
    # every code point except the surrogates
    chars = spark.range(1, 0x110000).where("id < 55296 or id > 57343")
    chars = chars.select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    differs = F.col("c").rlike(r"(?U)\s") != F.col("c").rlike(f"[{SPACE_CLASS}]")
    assert chars.where(differs).count() == 0


@pytest.mark.parametrize(
    "content, expected",
    [
        (b"", 0),
        (b"   \n\t", 0),
        ("one two　three".encode(), 3),
        (b"a b\nc", 3),
        (b"\xc2 \xa0", 2),  # cut white space is no white space
    ],
)
def test_token_count(spark, content, expected):
    frame = with_token_count(spark.createDataFrame([(content,)], "content binary"))
    assert frame.first().token_count == expected == models.tokens(content)


@pytest.mark.parametrize("content, expected", [(b"", 1), (b"a", 1), (b"a\n", 2), (b"\n\n\n", 4)])
def test_line_count(spark, content, expected):
    frame = with_line_count(spark.createDataFrame([(content,)], "content binary"))
    assert frame.first().line_count == expected


def test_trim_spaces(spark):
    rows = [
        b"",
        b" \t\n",
        b"  a b \n",
        "　a ".encode(),
        "　  a  \n".encode(),
        b"\xa0a\xc2",  # halves of a wide space stay
        b"\x80\x80 a",
        "　　".encode(),
        "é ".encode(),
    ]
    assert [bytes(x) for x in column(spark, rows, text.trim_spaces)] == [models.trim(r) for r in rows]


def test_is_binary(spark):
    rows = {
        b"": False,
        b"Hello, World!": False,
        bytes([0, 1, 2, 3]): True,
        b"a" * 7 + b"\x01" * 3: False,  # exactly the share
        b"a" * 6 + b"\x01" * 3: True,
        b"a" * 512 + b"\x00" * 5000: False,
        b"\x00" * 154 + b"a" * 358 + b"a" * 9000: True,
        b"\x00" * 153 + b"a" * 359: False,
        bytes(range(256)): False,
        bytes(range(0x7F, 0x9F)): True,
        "日本語のテキストです。これは例です。".encode(): True,
        "Привет, мир! Это пример текста.".encode(): False,
        b"\t\n\x0b\x0c\r \x85\xa0": False,
    }
    frame = spark.createDataFrame([(k, v) for k, v in rows.items()], "content binary, expected boolean")
    wrong = with_is_binary(frame).where("is_binary != expected").collect()
    assert wrong == []


def test_gate_keeps_rows_without_content(spark):
    rows = [("a", 3, False, "go", b"abc"), ("b", 3, True, "go", b"\x00\x01\x02"), ("c", 0, False, "go", b"")]
    frame = spark.createDataFrame(
        rows, "path string, size bigint, is_binary boolean, language string, content binary"
    )
    got = {r.path: (r.language, r.content) for r in gate_processable(frame).collect()}
    assert got == {"a": ("go", b"abc"), "b": (None, None), "c": (None, None)}
