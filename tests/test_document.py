"""A bundle as one document under a manifest."""

from __future__ import annotations

import json
import os
from xml.etree import ElementTree

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sheaf.options import BundleOptions
from sheaf.plans.bundle import build_bundle
from sheaf.sinks.bundle import FORMATS
from sheaf.sinks.document import MANIFEST, document_bytes, read_document, write_document
from tests.test_sinks import CONTENTS


@pytest.fixture
def bundle(spark):
    rows = [(p, len(c.encode()), c.encode()) for p, c in CONTENTS.items()]
    files = spark.createDataFrame(rows, "path string, size bigint, content binary").repartition(3)
    return build_bundle(files, options=BundleOptions(ignore_patterns=()))


def tree_text(bundle) -> str:
    return "".join(r.line + "\n" for r in bundle.tree.collect())


@pytest.mark.parametrize("format", FORMATS)
def test_round_trip_in_order(spark, bundle, tmp_path, format):
    folder = f"{tmp_path}/out"
    write_document(bundle.files, bundle.tree, folder, format, cwd="/work & <x>")
    files, context = read_document(spark, folder)
    got = files.orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(CONTENTS)))
    assert [(r.path, r.content) for r in got] == sorted(CONTENTS.items(), key=lambda x: x[0].encode())
    blocks = context.orderBy("block").collect()
    assert ("".join(r.tree for r in blocks), blocks[0].cwd) == (tree_text(bundle), "/work & <x>")


def test_the_pieces_are_one_document(spark, bundle, tmp_path):
    want = dict(sorted(CONTENTS.items(), key=lambda x: x[0].encode()))
    for format in FORMATS:
        write_document(bundle.files, bundle.tree, f"{tmp_path}/{format}", format, cwd="/w \"q\" <x>")
    text = {f: b"".join(document_bytes(f"{tmp_path}/{f}")).decode() for f in FORMATS}
    read = json.loads(text["json"])
    assert {f["path"]: f["content"] for f in read["files"]} == want
    assert [f["path"] for f in read["files"]] == list(want)
    assert read["directory_context"] == {"cwd": "/w \"q\" <x>", "tree": [tree_text(bundle)]}
    root = ElementTree.fromstring(text["xml"])
    assert {f.findtext("path"): f.findtext("content") or "" for f in root.iter("file")} == want
    assert root.findtext("directory-context/cwd") == "/w \"q\" <x>"
    lines = text["yaml"].split("\n")
    assert lines[0] == "files:" and lines[len(want) + 1] == "directory_context:"
    assert {f["path"]: f["content"] for f in (json.loads(x[2:]) for x in lines[1 : len(want) + 1])} == want
    assert json.loads(lines[len(want) + 4].removeprefix("  - ")) == tree_text(bundle)


@pytest.mark.parametrize("format", FORMATS)
def test_no_files(spark, bundle, tmp_path, format):
    write_document(bundle.files.where("false"), bundle.tree, f"{tmp_path}/out", format)
    files, context = read_document(spark, f"{tmp_path}/out")
    assert files.count() == 0 and context.count() == 1
    if format == "json":
        assert json.loads(b"".join(document_bytes(f"{tmp_path}/out")))["files"] == []
    if format == "xml":
        assert ElementTree.fromstring(b"".join(document_bytes(f"{tmp_path}/out"))).findall("files/file") == []


def test_a_failing_task_leaves_no_document(spark, bundle, tmp_path):
    folder = f"{tmp_path}/out"
    broken = bundle.files.withColumn(
        "content", F.when(F.col("path") == "wide", F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content"))
    )
    with pytest.raises(Exception, match="lost|abort|fail"):
        write_document(broken, bundle.tree, folder, "json")
    assert not os.path.exists(f"{folder}/{MANIFEST}")
    # A task that was still running may leave its piece, which nothing names.
    with pytest.raises((FileNotFoundError, PythonException)):
        read_document(spark, folder)
    # A later run fills the same folder.
    write_document(bundle.files, bundle.tree, folder, "json")
    assert read_document(spark, folder)[0].count() == len(CONTENTS)


def test_a_document_is_not_written_over(spark, bundle, tmp_path):
    write_document(bundle.files, bundle.tree, f"file://{tmp_path}/out", "json")
    with pytest.raises(Exception, match="there is a document"):
        write_document(bundle.files, bundle.tree, f"file://{tmp_path}/out", "json")
    stray = tmp_path / "out" / "pieces" / "00000000-files-stray"
    stray.write_bytes(b"{}")  # of a task that ran twice
    assert read_document(spark, f"{tmp_path}/out")[0].count() == len(CONTENTS)
