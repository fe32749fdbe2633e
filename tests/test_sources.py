import os

import pytest

from sheaf.sources import tree
from sheaf.sources.tree import read_contents, scan_tree

FILES = {
    "notes.md": b"# Heather and gorse",
    "blob.dat": bytes([7, 0, 9]),
    ".settings": b"colour=green\n",
    "build/out": b"left over",
    "lib/heap.rs": b"fn sift() {}\n",
    "_private/.hidden/empty": b"",
    "a/b/c/d/e": "é\xff".encode("latin-1"),
}


@pytest.fixture
def root(tmp_path):
    for path, content in FILES.items():
        file = tmp_path / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    return str(tmp_path)


def listed(frame):
    return {r.path: r.size for r in frame.collect()}


@pytest.mark.parametrize("parts", [1, 2, 3, 64])
def test_every_regular_file_once(spark, root, parts):
    frame = scan_tree(spark, root, parts=parts)
    assert listed(frame) == {p: len(c) for p, c in FILES.items()}
    assert frame.count() == len(FILES)
    assert frame.where("error is not null or mod_time is null").count() == 0


def test_ignore_and_size(spark, root):
    some = {"notes.md", "blob.dat", ".settings", "build/out", "lib/heap.rs"}
    rest = ["_private", "a"]
    assert set(listed(scan_tree(spark, root, rest))) == some
    expected = {"notes.md", ".settings", "lib/heap.rs"}
    assert set(listed(scan_tree(spark, root, [*rest, "*.dat", "build/*"]))) == expected
    assert set(listed(scan_tree(spark, root, rest, max_size=5))) == {"blob.dat"}
    assert listed(scan_tree(spark, root, ["*"])) == {}


def test_the_driver_opens_no_directory(spark, root, monkeypatch):
    def refuse(*_):
        raise AssertionError("opened on the driver")

    monkeypatch.setattr(os, "scandir", refuse)
    assert set(listed(scan_tree(spark, root))) == set(FILES)


def test_ignored_directories_are_not_opened(spark, root):
    os.chmod(f"{root}/build", 0o700)
    os.symlink("loop", f"{root}/build/loop")
    assert scan_tree(spark, root, ["build", "a/b"]).where("error is not null").count() == 0
    assert not any(p.startswith(("build/", "a/b/")) for p in listed(scan_tree(spark, root, ["build", "a/b"])))


def test_a_name_that_is_not_utf8_is_an_error_row(spark, root):
    os.mkdir(os.fsencode(root) + b"/caf\xe9")
    open(os.fsencode(root) + b"/na\xefve.txt", "wb").close()
    rows = {r.path: r.error for r in scan_tree(spark, root).collect()}
    assert set(FILES) < set(rows)
    assert rows["caf\\xe9"] == rows["na\\xefve.txt"] == "the name is not UTF-8"


def test_a_store_by_its_address(spark, root):
    frame = read_contents(scan_tree(spark, f"file://{root}", ["build"]), f"file://{root}")
    assert {r.path: bytes(r.content) for r in frame.collect()} == {p: c for p, c in FILES.items() if p != "build/out"}
    assert scan_tree(spark, f"file://{root}/nowhere").select("path").collect() == [(".",)]


def test_a_file_too_large_for_a_row(spark, root):
    frame = scan_tree(spark, root).replace(13, tree._MOST_BYTES + 1, "size").where("path = 'lib/heap.rs'")
    row = read_contents(frame, root, 1).first()
    assert row.content is None and row.error == "read error: too large for a row"


def test_contents(spark, root):
    frame = read_contents(scan_tree(spark, root), root, 4)
    assert {r.path: bytes(r.content) for r in frame.collect()} == FILES
    assert frame.rdd.getNumPartitions() == 4


def test_the_rest_is_scanned_when_something_fails(spark, root):
    os.symlink("notes.md", f"{root}/link")
    os.symlink("missing", f"{root}/broken")
    os.symlink("lib", f"{root}/directory")
    rows = {r.path: r for r in read_contents(scan_tree(spark, root), root, 2).collect()}
    assert set(rows) == {*FILES, "link", "broken", "directory"}
    assert bytes(rows["link"].content) == FILES["notes.md"] and rows["link"].error is None
    assert rows["broken"].error and rows["broken"].content is None
    assert rows["directory"].error and rows["directory"].content is None
    gone = scan_tree(spark, f"{root}/nowhere").collect()
    assert [(r.path, r.size) for r in gone] == [(".", None)] and gone[0].error


def test_a_file_that_vanishes_after_listing(spark, root):
    frame = spark.createDataFrame(
        [("nowhere", 1, None, None)], "path string, size bigint, mod_time timestamp, error string"
    )
    row = read_contents(frame, root, 1).first()
    assert row.content is None and row.error.startswith("read error")


def test_executors_need_no_copy_of_the_package(root):
    """A driver outside the repository scans; the workers cannot import the package."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).parent.parent)!r})
from sheaf import read_contents, scan_tree
from sheaf.session import build_session
spark = build_session("local[2]")
print("rows", read_contents(scan_tree(spark, {root!r}, ["lib"]), {root!r}, 2).where("error is null").count())
"""
    done = subprocess.run(
        [sys.executable, "-c", code], cwd="/", capture_output=True, text=True, timeout=300
    )
    assert f"rows {len(FILES) - 1}" in done.stdout, done.stderr[-2000:]
