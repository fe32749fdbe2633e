"""The directory tree as a data source and as a stream."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import datasource as ds

from sheaf.sources import tree_format
from sheaf.sources.tree import read_contents, scan_tree
from sheaf.sources.tree_format import TreeReader, register_tree
from sheaf.streaming.scan import write_available

FILES = {
    "top.md": b"x",
    ".hidden": b"",
    "src/a.go": b"package a\n",
    "src/deep/er/b.go": b"package b\n" * 3,
    "src/deep/c.go": b"package c\n",
    "docs/d.md": b"# d\n",
    "docs/old/e.md": b"# e, longer\n",
    "docs é/f.md": b"f",
    "zoo/_x/g": b"g" * 50,
}


@pytest.fixture
def root(tmp_path):
    for path, content in FILES.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    return str(tmp_path)


def reader(spark, root, **options):
    register_tree(spark)
    return spark.read.format("file_tree").options(**options).load(root)


@pytest.mark.parametrize("parts", [1, 2, 32])
def test_rows_are_those_of_the_scan(spark, root, parts):
    want = scan_tree(spark, root, ["docs/*", "*.md"]).collect()
    assert sorted(reader(spark, root, parts=parts, patterns="docs/*\n*.md").collect()) == sorted(want)
    assert {r.path: r.size for r in reader(spark, root, parts=parts).collect()} == {p: len(c) for p, c in FILES.items()}
    assert [r.error is not None for r in reader(spark, f"{root}/nowhere").collect()] == [True]


def test_contents(spark, root):
    got = reader(spark, root, contents="true").where("size < 40")
    assert {r.path: bytes(r.content) for r in got.collect()} == {p: c for p, c in FILES.items() if len(c) < 40}
    stored = reader(spark, f"file://{root}", contents="true")
    want = read_contents(scan_tree(spark, root), root).select("path", "content")
    assert sorted(stored.select("path", "content").collect()) == sorted(want.collect())


CONDITIONS = [
    "path = 'src/deep/c.go'",
    "path IN ('top.md', 'docs/old/e.md', 'none')",
    "path LIKE 'src/deep/%'",
    "path LIKE '%.md'",
    "path LIKE '%é%'",
    "path > 'docs/old/e.md'",
    "path >= 'docs/old/e.md' AND path <= 'src/deep/c.go'",
    "path < 'docs/p'",
    "size > 10 AND size <= 30",
    "size = 1 OR path = 'top.md'",
    "path LIKE 'docs/%' AND size > 5 AND length(path) > 3",
    "size IS NULL",
    "NOT path = 'top.md'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_conditions_give_what_a_filter_gives(spark, root, condition):
    want = scan_tree(spark, root).where(condition).select("path", "size").collect()
    assert sorted(reader(spark, root).where(condition).select("path", "size").collect()) == sorted(want)


def test_sql_prunes_the_walk(spark, root):
    reader(spark, root).createOrReplaceTempView("tree")
    plan = spark.sql("SELECT path FROM tree WHERE path LIKE 'src/deep/%' AND size > 10")._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    # What the source takes over is no longer evaluated by Spark.
    assert "Filter " not in physical and "file_tree" in physical


@pytest.mark.parametrize(
    "pushed, opened",
    [
        ([ds.StringStartsWith(("path",), "src/deep/")], {"", "src", "src/deep", "src/deep/er"}),
        ([ds.EqualTo(("path",), "docs/d.md")], {"", "docs"}),
        ([ds.In(("path",), ("top.md", "zoo/_x/g"))], {"", "zoo", "zoo/_x"}),
        ([ds.LessThan(("path",), "docs")], {""}),
        ([ds.GreaterThan(("path",), "src/z")], {"", "src", "zoo", "zoo/_x"}),
        ([ds.GreaterThan(("size",), 10)], {"", "src", "src/deep", "src/deep/er", "docs", "docs/old", "docs é", "zoo", "zoo/_x"}),
    ],
)
def test_directories_that_cannot_match_are_not_opened(root, monkeypatch, pushed, opened):
    seen = set()
    listed = tree_format._local_entries

    def watched(top, directory):
        seen.add(directory)
        return listed(top, directory)

    monkeypatch.setattr(tree_format, "_local_entries", watched)
    source = TreeReader({"path": root, "parts": "2"})
    assert list(source.pushFilters([*pushed, left := ds.IsNull(("error",))])) == [left]
    rows = [r for part in source.partitions() for b in source.read(part) for r in b.to_pylist()]
    assert seen == opened
    assert len({r["path"] for r in rows}) == len(rows)


def stream(spark, root):
    register_tree(spark)
    return spark.readStream.format("file_tree").option("settle", "0.2").option("contents", "true").load(root)


def test_files_that_appear_anywhere_arrive_once(spark, root, tmp_path_factory):
    out, checkpoint = (str(tmp_path_factory.mktemp("stream") / n) for n in ("out", "checkpoint"))
    old = os.path.join(str(tmp_path_factory.mktemp("old")), "moved")
    with open(old, "wb") as file:
        file.write(b"made before, moved in later")
    os.utime(old, (1, 1))
    batches = [{}, {"src/new/h.go": b"h", "late": b"l"}, {"src/new/i/j/k": b"k" * 5, "docs/z": b"z"}]
    for n, more in enumerate(batches):
        for path, content in more.items():
            os.makedirs(os.path.dirname(os.path.join(root, path)), exist_ok=True)
            with open(os.path.join(root, path), "wb") as file:
                file.write(content)
        if n == 2:
            os.rename(old, os.path.join(root, "docs/moved"))
        time.sleep(0.5)
        # Each run is a new query that goes on from the checkpoint.
        write_available(stream(spark, root), out, checkpoint)
        got = sorted(spark.read.parquet(out).select("path", "size", "content").collect())
        want = read_contents(scan_tree(spark, root), root).select("path", "size", "content")
        assert got == sorted(want.collect())
    write_available(stream(spark, root), out, checkpoint)
    assert spark.read.parquet(out).count() == len(FILES) + 5


def test_batches_of_contents_are_small(tmp_path):
    for n in range(24):
        (tmp_path / f"{n}").write_bytes(b"x" * (1 << 20))
    walk = tree_format._Walk({"path": str(tmp_path), "contents": "true"})
    (part,) = walk.subtrees()
    batches = list(walk.batches(walk.rows(part)))
    assert sum(b.num_rows for b in batches) == 24
    assert max(b.nbytes for b in batches) < 10 << 20
