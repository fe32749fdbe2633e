import json
from pathlib import Path

import pytest

from sheaf.operators.tree import dir_tree
from sheaf.plans.bundle import build_bundle
from sheaf.options import BundleOptions
from sheaf.sinks.bundle import FORMATS, read_bundle, write_bundle

CONTENTS = {
    "test.txt": "test content",
    "markup.xml": "<![CDATA[ a ]]> <b c=\"d\">&amp; ' </b>",
    "spaces": "  \n lead and trail \n\n",
    "blank": "   ",
    "empty": "",
    "quotes\"'&<.txt": "\"'\\ \\n\\u0041",
    "wide": "é 日本 \U0001f600   ﻿",
    "tabs": "a\tb",
    "colon: - yaml": "---\n- a: b\n...\n# no",
    "dir/sub/x": "x",
}


@pytest.fixture
def bundle(spark):
    rows = [(p, len(c.encode()), c.encode()) for p, c in CONTENTS.items()]
    files = spark.createDataFrame(rows, "path string, size bigint, content binary").repartition(3)
    return build_bundle(files, options=BundleOptions(ignore_patterns=()))


def parts(folder, pattern="part-*"):
    return "".join(p.read_text() for p in sorted(Path(folder).glob(pattern)))


@pytest.mark.parametrize("format", FORMATS)
def test_round_trip(spark, bundle, tmp_path, format):
    write_bundle(bundle.files, bundle.tree, f"{tmp_path}/out", format, cwd="/work")
    assert {r.path: r.content for r in read_bundle(spark, f"{tmp_path}/out", format).collect()} == CONTENTS
    assert parts(f"{tmp_path}/out/context")


def test_json_in_path_order_with_context(bundle, tmp_path):
    write_bundle(bundle.files, bundle.tree, f"{tmp_path}/out", "JSON", cwd="/work")
    rows = [json.loads(line) for line in parts(f"{tmp_path}/out/files").split("\n") if line]
    assert [r["path"] for r in rows] == sorted(CONTENTS)
    (context,) = [json.loads(line) for line in parts(f"{tmp_path}/out/context").split("\n") if line]
    expected = "".join(r.line + "\n" for r in bundle.tree.collect())
    assert (context["cwd"], context["tree"]) == ("/work", expected)


def test_xml_is_well_formed(bundle, tmp_path):
    from xml.etree import ElementTree

    write_bundle(bundle.files, bundle.tree, f"{tmp_path}/out", "xml")
    found = {}
    for part in Path(f"{tmp_path}/out/files").glob("part-*"):
        root = ElementTree.parse(part).getroot()
        assert root.tag == "files"
        found.update({f.findtext("path"): f.findtext("content") or "" for f in root.iter("file")})
    assert found == CONTENTS
    (context,) = Path(f"{tmp_path}/out/context").glob("part-*")
    (row,) = ElementTree.parse(context).getroot().iter("directory-context")
    assert row.findtext("cwd") == "." and row.findtext("tree").startswith(".\n├── ")


def test_yaml_parses(bundle, tmp_path):
    yaml = pytest.importorskip("yaml")
    write_bundle(bundle.files, bundle.tree, f"{tmp_path}/out", "yaml", cwd="/work")
    documents = list(yaml.safe_load_all(parts(f"{tmp_path}/out/files")))
    assert {d["path"]: d["content"] for d in documents} == CONTENTS
    (context,) = yaml.safe_load_all(parts(f"{tmp_path}/out/context"))
    assert context["directory_context"]["cwd"] == "/work"


def test_characters_a_format_cannot_hold(spark, tmp_path):
    rows = [("control", b"a\x00\x01b\x7f\xc2\x80c"), ("bytes", b"a\xffb")]
    files = spark.createDataFrame(rows, "path string, content binary")
    tree = dir_tree(files)
    expected = {
        "xml": {"control": "a��b\x7f\x80c", "bytes": "a�b"},
        "json": {"control": "a\x00\x01b\x7f\x80c", "bytes": "a�b"},
        "yaml": {"control": "a\x00\x01b\x7f\x80c", "bytes": "a�b"},
    }
    for format, contents in expected.items():
        write_bundle(files, tree, f"{tmp_path}/{format}", format)
        got = {r.path: r.content for r in read_bundle(spark, f"{tmp_path}/{format}", format).collect()}
        assert got == contents, format
    assert "\\u0080" in parts(f"{tmp_path}/yaml/files")


def test_unknown_format(bundle, tmp_path):
    with pytest.raises(ValueError):
        write_bundle(bundle.files, bundle.tree, str(tmp_path), "csv")
