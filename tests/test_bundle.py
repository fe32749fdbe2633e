import pytest

from sheaf.options import BundleOptions
from sheaf.plans.bundle import build_bundle, bundle_chunks
from tests import models

GO = b'package main\n\n// note\nfunc main() {\n    println("hi") // x\n}\n'
FILES = {
    "src/main.go": GO,
    "tool": b"#!/bin/sh\necho // x\n",
    "image.png": bytes(range(32)) * 4,
    "empty.py": b"",
    "node_modules/x.js": b"var x",
    "src/node_modules/y.js": b"var y",
    "large.txt": b"x " * 300,
}


@pytest.fixture
def files(spark):
    rows = [(p, len(c), c) for p, c in FILES.items()]
    return spark.createDataFrame(rows, "path string, size bigint, content binary")


def rows_of(bundle):
    return {r.path: (r.is_binary, r.language, bytes(r.content)) for r in bundle.files.collect()}


def test_bundle(files):
    bundle = build_bundle(files, options=BundleOptions(strip_comments=True, max_file_size=500))
    assert rows_of(bundle) == {
        "src/main.go": (False, "go", models.strip_comments(GO)),
        "tool": (False, "shell", b"#!/bin/sh\necho"),
        "image.png": (True, None, b""),
        "empty.py": (False, None, b""),
        "src/node_modules/y.js": (False, "javascript", b"var y"),
    }
    # the tree has its own rule: no size limit, and "node_modules" at any depth is out
    lines = [r.line for r in bundle.tree.collect()]
    assert lines == [
        ".", "├── empty.py", "├── image.png", "├── large.txt", "├── src", "  ├── main.go", "├── tool",
    ]


def test_selection_and_cap(spark, files):
    chosen = spark.createDataFrame([("tool",), ("src/main.go",), ("nowhere",)], "path string")
    assert set(rows_of(build_bundle(files, chosen))) == {"tool", "src/main.go"}
    assert rows_of(build_bundle(files, chosen))["src/main.go"][2] == GO
    capped = build_bundle(files, options=BundleOptions(max_files=2))
    assert set(rows_of(capped)) == {"empty.py", "image.png"}


def test_chunks_of_the_bundle(files):
    options = BundleOptions(chunk_size=50, chunk_overlap=10, strip_comments=True)
    chunks = bundle_chunks(build_bundle(files, options=options).files, options).collect()
    assert {r.path for r in chunks} == {"src/main.go", "large.txt"}
    stripped = models.strip_comments(GO)
    windows = models.windows(len(stripped), 50, 10)
    assert sorted(r.start for r in chunks if r.path == "src/main.go") == [a for a, _ in windows]


@pytest.mark.parametrize(
    "name", ["max_file_size", "max_files", "chunk_size", "chunk_overlap", "max_tokens"]
)
def test_negative_options(name):
    with pytest.raises(ValueError):
        BundleOptions(**{name: -1})


def test_from_a_tree_to_a_written_bundle(spark, tmp_path):
    import sheaf

    root = tmp_path / "in"
    for path, content in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(content)
    options = BundleOptions(strip_comments=True, max_file_size=500)
    bundle = sheaf.bundle_listing(sheaf.scan_tree(spark, str(root)), str(root), options=options)
    sheaf.write_bundle(bundle.files, bundle.tree, f"{tmp_path}/out", "json", cwd=str(root))
    got = {r.path: r.content for r in sheaf.read_bundle(spark, f"{tmp_path}/out", "json").collect()}
    assert set(got) == {"src/main.go", "tool", "image.png", "empty.py", "src/node_modules/y.js"}
    assert got["src/main.go"].encode() == models.strip_comments(GO) and got["image.png"] == ""
    context = sheaf.read_context(spark, f"{tmp_path}/out", "json").orderBy("block").collect()
    assert {r.cwd for r in context} == {str(root)}
    assert "".join(r.tree for r in context).splitlines() == [
        ".", "├── empty.py", "├── image.png", "├── large.txt", "├── src", "  ├── main.go", "├── tool",
    ]


def test_listing_first(spark, tmp_path):
    from sheaf import bundle_listing, scan_tree, write_tree

    rows = [(p, c) for p, c in FILES.items()]
    assert write_tree(spark.createDataFrame(rows, "path string, content binary"), str(tmp_path)) == len(rows)
    chosen = spark.createDataFrame([("tool",), ("large.txt",), ("src/main.go",)], "path string")
    bundle = bundle_listing(scan_tree(spark, str(tmp_path)), str(tmp_path), chosen)
    assert {p: c for p, (_, _, c) in rows_of(bundle).items()} == {p: FILES[p] for p in ("tool", "large.txt", "src/main.go")}
    assert [r.path for r in bundle.files.collect()] == sorted(["tool", "large.txt", "src/main.go"])
    plan = bundle.files._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    assert "MapInArrow" not in bundle.tree._jdf.queryExecution().executedPlan().toString()
    unlimited = bundle_listing(scan_tree(spark, str(tmp_path)), str(tmp_path), options=BundleOptions(max_file_size=None))
    assert "large.txt" in rows_of(unlimited)


def test_the_tree_of_a_listing_is_that_of_a_walk(spark, tmp_path):
    """Directories without files, or with ignored files only, are drawn; ignored ones are not."""
    import os

    from sheaf.plans.bundle import bundle_listing
    from sheaf.sources.tree import scan_tree

    for path in ("a/b/file.go", "a/only/x.log", "top", "skip/y/z"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"text")
    for path in ("empty", "a/empty/inner", "skip/empty", "é"):
        (tmp_path / path).mkdir(parents=True)
    os.symlink("missing", tmp_path / "broken")
    options = BundleOptions(ignore_patterns=("skip", "*.log"))
    listing = scan_tree(spark, str(tmp_path), directories=True)
    bundle = bundle_listing(listing, str(tmp_path), options=options)
    want = [".", "├── a", "  ├── b", "    ├── file.go", "  ├── empty", "    ├── inner", "  ├── only", "├── empty", "├── top", "├── é"]
    assert [r.line for r in bundle.tree.collect()] == want
    # The files follow the scan's rule, in which *.log is about root-level files.
    assert {r.path for r in bundle.files.collect()} == {"a/b/file.go", "a/only/x.log", "top"}
    assert {r.path for r in scan_tree(spark, str(tmp_path)).collect()} == {
        "a/b/file.go", "a/only/x.log", "top", "skip/y/z", "broken"
    }
