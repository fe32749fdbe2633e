import glob
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sheaf.operators.chunking import chunk_bytes, pack_segments, split_segments
from sheaf.operators.enrich import strip_comments, with_language, with_line_count, with_token_count
from sheaf.operators.filters import filter_ignored, filter_size, gate_processable, with_is_binary
from sheaf.operators.search import grep_lines, match_stats, preview, search_path
from sheaf.operators.selection import selection_state
from sheaf.streaming.scan import scan_stream, write_available
from sheaf.streaming.selection import (
    compact_selection,
    read_selection,
    selection_stream,
    write_selection,
)

SCHEMA = "path string, size bigint, content binary"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("stream") / "files")
    spark.range(400).select(
        F.concat(F.lit("src/f"), "id", F.lit(".go")).alias("path"),
        F.concat(
            F.repeat(F.lit("word // note\n\n\n"), F.col("id").cast("int") % 40),
            F.lit("/* x\n*/ the end\n"),
        ).cast("binary").alias("content"),
    ).withColumn("size", F.octet_length("content").cast("bigint")).select(
        "path", "size", "content"
    ).repartition(5).write.parquet(folder)
    return folder


OPERATORS = {
    "size": lambda df: filter_size(df, 200),
    "ignored": lambda df: filter_ignored(df, ["src/f1*"]),
    "enriched": lambda df: with_line_count(
        with_token_count(strip_comments(gate_processable(with_language(with_is_binary(df)))))
    ),
    "chunks": lambda df: chunk_bytes(df, 64, 8),
    "segments": split_segments,
    "packs": lambda df: pack_segments(df, 50, 7),
    "paths": lambda df: search_path(df, "F2"),
    "lines": lambda df: grep_lines(df, "the"),
    "stats": lambda df: match_stats(df, "the"),
    "preview": lambda df: preview(df, "the"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_stream_equals_batch(spark, folder, tmp_path, name):
    operator = OPERATORS[name]
    stream = scan_stream(spark, folder, SCHEMA, max_files_per_trigger=2)
    assert stream.isStreaming
    write_available(operator(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out")
    expected = operator(spark.read.schema(SCHEMA).parquet(folder))
    assert got.count() == expected.count() > 0
    assert got.select(expected.columns).exceptAll(expected).count() == 0


def test_new_files_are_added_once(spark, tmp_path):
    out, checkpoint, source = f"{tmp_path}/out", f"{tmp_path}/checkpoint", f"{tmp_path}/in"
    rows = spark.range(10).select(F.col("id").cast("string").alias("path"))
    for expected in (10, 20):
        rows.write.mode("append").parquet(source)
        write_available(scan_stream(spark, source, "path string"), out, checkpoint)
        assert spark.read.parquet(out).count() == expected
    write_available(scan_stream(spark, source, "path string"), out, checkpoint)
    assert spark.read.parquet(out).count() == 20


@pytest.mark.parametrize("as_file", [True, False])
def test_one_table_of_a_folder(spark, tmp_path, as_file):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = spark.range(20).select(F.col("id").cast("string").alias("path"))
    rows.repartition(3).write.parquet(f"{source}/other.parquet")
    rows.where("path < 5").repartition(3).write.parquet(f"{source}/kept.parquet")
    if as_file:
        part = f"{tmp_path}/one"
        rows.where("path < 5").coalesce(1).write.parquet(part)
        source = f"{tmp_path}/file"
        os.mkdir(source)
        for name in ("kept", "other"):
            shutil.copy(glob.glob(f"{part}/part-*")[0], f"{source}/{name}.parquet")
    write_available(scan_stream(spark, source, "path string", table="kept.parquet"), out, f"{tmp_path}/checkpoint")
    assert sorted(r.path for r in spark.read.parquet(out).collect()) == list("01234")


def test_selection_stream_equals_batch(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    toggles = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 97)).alias("path")
    )
    for _ in range(2):  # a second run picks up the state of the first
        toggles.repartition(4).write.mode("append").parquet(source)
        stream = scan_stream(spark, source, "path string", max_files_per_trigger=1)
        write_selection(selection_stream(stream), out, checkpoint)
        got = {tuple(r) for r in read_selection(spark, out).collect()}
        assert got == {tuple(r) for r in selection_state(spark.read.parquet(source)).collect()}


def test_a_compacted_selection_reads_later_batches_only(spark, tmp_path):
    source, out, checkpoint = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    toggles = spark.range(300).select((F.col("id") % 7).cast("string").alias("path"))
    for runs in range(1, 4):
        toggles.write.mode("append").parquet(source)
        stream = scan_stream(spark, source, "path string", max_files_per_trigger=1)
        write_selection(selection_stream(stream), out, checkpoint)
        read = read_selection(spark, out)
        want = {tuple(r) for r in selection_state(spark.read.parquet(source)).collect()}
        assert {tuple(r) for r in read.collect()} == want
        compact_selection(spark, out)
        compact_selection(spark, out)
        assert {tuple(r) for r in read_selection(spark, out).collect()} == want
        plan = read_selection(spark, out)._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(batch" in plan
