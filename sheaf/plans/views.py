"""Tables of files and paths derived from the given tables.

The given tables hold documents, pages and events, not files; these views give their
rows paths, interpreter lines and comments, so that every operator has something to
do. Each covers its whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.text import byte_length
from sheaf.sources.tables import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


_KEYS = {"documents": ("doc_id",), "pages": ("page_id",), "conversations": ("conv_id", "turn")}


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose texts are worked on, dealt out to all cores."""
    return read_table(spark, f"{folder}/{name}.parquet", spread_by=_KEYS[name])


def _pick(number: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number + 1).cast("int"))


def _path() -> Column:
    doc = F.col("doc_id")
    directory = _pick(doc % 5, "src/", "node_modules/pkg/", "src/node_modules/", "", "vendor/")
    suffix = _pick(doc % 6, ".go", ".py", ".MD", ".tar.js", "", ".xyz")
    return F.concat(directory, "lang", F.lit("_"), doc.cast("string"), suffix)


def _commented() -> Column:
    text = F.col("text")
    for word, mark in ((".\n", "\n\n\n"), (" the ", "/*"), (" and ", "*/"), (" of ", " // ")):
        text = F.replace(text, F.lit(word), F.lit(mark))
    return text.cast("binary")


def _files(documents: DataFrame, content: Column) -> DataFrame:
    rows = documents.select("doc_id", _path().alias("path"), content.alias("content"))
    return rows.select("doc_id", "path", byte_length(F.col("content")).alias("size"), "content")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, size, content: documents as source files in several directories."""
    doc = F.col("doc_id")
    interpreter = F.when(doc % 4 == 0, "python").otherwise("bash")
    shebang = F.concat(F.lit("#!/usr/bin/env "), interpreter, F.lit("\n"), F.col("text"))
    content = F.when(doc % 6 == 4, shebang).otherwise(F.col("text")).cast("binary")
    return _files(texts(spark, folder, "documents"), content)


def _garbled() -> Column:
    return F.regexp_replace("text", "[aeiou ]", "\x01")


def binaries(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, content: documents, some of them full of control characters."""
    content = F.when(F.col("doc_id") % 7 == 0, _garbled()).otherwise(F.col("text"))
    return texts(spark, folder, "documents").select("doc_id", content.cast("binary").alias("content"))


def commented(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, content: documents with blank lines and comment marks put in."""
    return texts(spark, folder, "documents").select("doc_id", _commented().alias("content"))


def commented_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, size, content: the files view's paths with commented contents."""
    return _files(texts(spark, folder, "documents"), _commented())


def mixed_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, size, content: commented files, some of them full of control characters."""
    content = F.when(F.col("doc_id") % 7 == 0, _garbled().cast("binary")).otherwise(_commented())
    return _files(texts(spark, folder, "documents"), content)


def paths(spark: SparkSession, folder: str) -> DataFrame:
    """path: the addresses of the pages, without scheme, query and closing slash."""
    path = F.rtrim(F.regexp_extract("url", r"^https?://([^?#]+)", 1), F.lit("/"))
    return table(spark, folder, "pages").select(path.alias("path")).where(F.col("path") != "")


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """path, op, content, ts, seq: events as writes and removes of one file per user."""
    op = F.when(F.col("event_type") == "error", "remove").otherwise("write")
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("path"),
        op.alias("op"),
        F.col("props").alias("content"),
        "ts",
        F.col("event_id").alias("seq"),
    )


def selected_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of the documents whose number is a selected user of the events."""
    from sheaf.operators.selection import selection_state

    state = selection_state(table(spark, folder, "events"), "user_id")
    return state.where("is_selected").select(F.col("user_id").alias("doc_id"))
