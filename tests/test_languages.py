import pytest

from sheaf.functions.constants import LANGUAGE_BY_EXTENSION
from sheaf.operators.enrich import with_language


@pytest.mark.parametrize(
    "path, content, expected",
    [
        ("test.go", b"package main", "go"),
        ("test.py", b"#!/usr/bin/env ruby\n", "python"),  # the extension wins
        ("X.GO", b"", "go"),
        ("a.tar.gz", b"", "unknown"),
        ("README", b"text", "unknown"),
        (".gitignore", b"*.log", "unknown"),
        (".vim", b"", "vim"),
        ("a.b/c", b"", "unknown"),
        ("a.py/c.rs", b"", "rust"),
        ("tool", b"#!/usr/bin/env python3\nx", "python"),
        ("tool", b"#!/bin/sh\n", "shell"),
        ("tool", b"#!/usr/share/python\n", "python"),  # "sh" is part of it
        ("tool", b"#!/usr/bin/Rscript", "r"),
        ("tool", b" #!/bin/sh\n", "unknown"),
        ("tool", b"\n#!/bin/sh\n", "unknown"),
        ("tool", b"#!" + b"x" * 65534 + b"\n", "unknown"),
        ("tool", b"#!sh" + b" " * 65531 + b"\n", "shell"),
        ("tool", b"#!sh" + b" " * 65532 + b"\n", "unknown"),  # too long a line
        ("tool.xyz", b"#!/usr/bin/node\n", "javascript"),
        ("tool", b"", "unknown"),
    ],
)
def test_language(spark, path, content, expected):
    frame = spark.createDataFrame([(path, content)], "path string, content binary")
    assert with_language(frame, max_line_bytes=65536).first().language == expected


def test_a_long_shebang_line_counts_unless_limited(spark):
    frame = spark.createDataFrame([("tool", b"#!sh" + b" " * 70000)], "path string, content binary")
    assert with_language(frame).first().language == "shell"
    assert with_language(frame, max_line_bytes=65536).first().language == "unknown"


def test_known_language_wins(spark):
    rows = [("a.go", "cobol", b""), ("b.go", "", b""), ("c.go", None, b"")]
    frame = spark.createDataFrame(rows, "path string, language string, content binary")
    got = {r.path: r.language for r in with_language(frame).collect()}
    assert got == {"a.go": "cobol", "b.go": "go", "c.go": "go"}


def test_every_extension(spark):
    rows = [(f"dir/file{ext.upper()}", lang, b"") for ext, lang in LANGUAGE_BY_EXTENSION.items()]
    frame = spark.createDataFrame(rows, "path string, expected string, content binary")
    assert with_language(frame).where("language != expected").count() == 0
    assert len(rows) == 49
