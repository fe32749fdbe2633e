"""Per-document columns: language, stripped content, token and line counts.

All of them are projections: no shuffle, and they run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions import comments, languages, text


def with_language(
    df: DataFrame, path: str = "path", content: str = "content", max_line_bytes: int | None = None
) -> DataFrame:
    known = F.col("language") if "language" in df.columns else None
    found = languages.detect_language(F.col(path), F.col(content), known, max_line_bytes)
    return df.withColumn("language", found)


def strip_comments(
    df: DataFrame, content: str = "content", max_line_bytes: int | None = None
) -> DataFrame:
    return df.withColumn(content, comments.strip_comments(F.col(content), max_line_bytes))


def with_token_count(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("token_count", text.token_count(text.as_text(F.col(content))))


def with_line_count(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("line_count", text.line_count(F.col(content)))
