"""What the plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from sheaf.operators import chunking, enrich, filters, search, selection
from sheaf.operators.order import in_path_order
from sheaf.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("plans") / "files")
    spark.range(10).selectExpr(
        "concat('f', id) AS path", "id AS size", "cast('x' AS binary) AS content", "current_timestamp() AS mod_time"
    ).write.parquet(folder)
    return spark.read.parquet(folder)


def test_row_wise_operators_do_not_shuffle(files):
    rows = filters.with_is_binary(filters.filter_ignored(filters.filter_size(files)))
    rows = filters.gate_processable(enrich.with_language(rows))
    rows = enrich.with_line_count(enrich.with_token_count(enrich.strip_comments(rows)))
    for frame in (
        rows,
        chunking.chunk_bytes(enrich.strip_comments(files)),
        chunking.pack_segments(files),
        chunking.split_segments(files),
        search.grep_lines(files, "x"),
        search.match_stats(files, "x"),
        search.preview(files, "x"),
    ):
        assert "Exchange" not in plan(frame) and "Python" not in plan(frame)


def test_stripping_is_computed_once_before_chunking(files):
    text = plan(chunking.chunk_bytes(enrich.strip_comments(files)))
    assert text.count("?mdU") == plan(enrich.strip_comments(files)).count("?mdU") > 0


def test_size_filter_is_pushed_to_the_scan(files):
    text = plan(filters.filter_size(files, 5))
    assert "LessThanOrEqual(size,5)" in text


def test_path_work_does_not_read_contents(files):
    text = plan(filters.filter_ignored(files).select("path"))
    assert re.search(r"ReadSchema: struct<path:string>", text)


def test_cap_finds_its_cut_on_paths_alone(files):
    text = plan(filters.cap_files(files, 3))
    assert "TakeOrderedAndProject" not in text and "Join" not in text
    assert re.search(r"PushedFilters: \[.*LessThan\(path,", text)


def test_many_queries_are_cut_before_the_shuffle(files):
    text = plan(search.search_fuzzy_many(files, ["a", "b"], 5))
    before_shuffle = text[text.index("Exchange") :]
    assert re.search(r"WindowGroupLimit .*Partial", before_shuffle)
    # A path becomes rows for the queries it matches only.
    assert re.search(r"Generate explode\(filter\(", text)


def test_aggregations_combine_before_the_shuffle(files):
    assert "partial_count" in plan(selection.selection_state(files))
    ops = files.selectExpr("path", "'write' AS op", "content", "mod_time AS ts", "size AS seq")
    assert "partial_max_by" in plan(selection.apply_ops(ops))


def test_no_registered_query_has_a_cross_join(spark):
    for name, query in QUERIES.items():
        text = plan(query(spark, FOLDER))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_contents_are_read_and_moved_once_for_a_bundle_in_order(spark, tmp_path):
    """Ranges come from paths and sizes; the plan then has one scan and one exchange."""
    spark.range(3000).selectExpr(
        "concat('f', id % 997) AS path", "id AS size", "cast(repeat('x', 100) AS binary) AS content"
    ).repartition(4).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    ordered = in_path_order(files, 7)
    text = plan(ordered)
    assert text.count("FileScan") == text.count("Exchange") == 1 and "rangepartitioning" not in text
    rows = ordered.withColumn("part", F.spark_partition_id()).collect()
    assert [r.position for r in sorted(rows, key=lambda r: r.position)] == list(range(3000))
    by_place = sorted(rows, key=lambda r: r.position)
    assert [r.path for r in by_place] == sorted(r.path for r in rows)
    assert [r.part for r in by_place] == sorted(r.part for r in rows) and len({r.part for r in rows}) == 7


def test_order_of_odd_tables(spark):
    schema = "path string, size bigint, content binary"
    assert in_path_order(spark.createDataFrame([], schema)).count() == 0
    rows = [("b", 1, b"x"), (None, 2, b"y"), ("a\"\\é", None, None), ("b", 1, b"x"), ("", 0, b"")]
    got = in_path_order(spark.createDataFrame(rows, schema), 3).orderBy("position").collect()
    assert [(r.position, r.path) for r in got] == [(0, None), (1, ""), (2, "a\"\\é"), (3, "b"), (4, "b")]
