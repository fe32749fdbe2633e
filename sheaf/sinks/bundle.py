"""Context bundles: selected files and the directory context, as XML, JSON or YAML.

A bundle is a folder with two parts, ``files`` and ``context``. Each is written by
all tasks at once as part files. Files come range-partitioned by path (``build_bundle``
does it) and are sorted here, so reading the parts in name order gives the files in
path order. The directory tree is written in blocks (see ``render_tree``), since one
string would need one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.text import as_text
from sheaf.operators.tree import render_tree

FORMATS = ("xml", "json", "yaml")

# Fixed value: characters XML 1.0 cannot hold, not even escaped.
_NOT_XML = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"
# Characters JSON leaves bare that YAML wants escaped, since it cannot
# hold them or reads them as line breaks.
_NOT_YAML = r"[\x{7F}-\x{9F}\x{2028}\x{2029}\x{FEFF}\x{FFFE}\x{FFFF}]"
_NOT_YAML_CODES = [*range(0x7F, 0xA0), 0x2028, 0x2029, 0xFEFF, 0xFFFE, 0xFFFF]


def _file_rows(files: DataFrame) -> DataFrame:
    content = F.coalesce(F.make_valid_utf8(as_text(F.col("content"))), F.lit(""))
    return files.select("path", content.alias("content")).sortWithinPartitions("path")


def _context_rows(tree: DataFrame, cwd: str) -> DataFrame:
    return render_tree(tree).select(F.lit(cwd).alias("cwd"), "block", "tree")


def write_xml(files: DataFrame, tree: DataFrame, folder: str, cwd: str = ".") -> None:
    """``<files>`` of ``<file>`` with path and content, and ``<directory-context>``.

    Markup in a content is escaped. XML has no form for most control characters;
    they are written as U+FFFD.
    """

    def clean(df: DataFrame, *columns: str) -> DataFrame:
        return df.withColumns({c: F.regexp_replace(c, _NOT_XML, "�") for c in columns})

    (
        clean(_file_rows(files), "path", "content")
        .write.format("xml")
        .options(rootTag="files", rowTag="file")
        .save(f"{folder}/files")
    )
    (
        clean(_context_rows(tree, cwd), "cwd", "tree")
        .write.format("xml")
        .options(rootTag="directory-contexts", rowTag="directory-context")
        .save(f"{folder}/context")
    )


def write_json(files: DataFrame, tree: DataFrame, folder: str, cwd: str = ".") -> None:
    """One JSON object per line with path and content; context with cwd and tree."""
    _file_rows(files).write.json(f"{folder}/files")
    _context_rows(tree, cwd).write.json(f"{folder}/context")


def _yaml_flow(text: Column) -> Column:
    """A JSON value as YAML, which reads it as a flow value."""
    escaped = text
    for code in _NOT_YAML_CODES:
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(text.rlike(_NOT_YAML), escaped).otherwise(text)


def _yaml_document(value: Column) -> Column:
    return F.concat(F.lit("---\n"), _yaml_flow(F.to_json(value))).alias("value")


def write_yaml(files: DataFrame, tree: DataFrame, folder: str, cwd: str = ".") -> None:
    """One YAML document per file with path and content, and per block of the tree."""
    rows = _file_rows(files)
    rows.select(_yaml_document(F.struct("path", "content"))).write.text(f"{folder}/files")
    context = F.struct(F.struct("cwd", "block", "tree").alias("directory_context"))
    _context_rows(tree, cwd).select(_yaml_document(context)).write.text(f"{folder}/context")


def write_bundle(
    files: DataFrame, tree: DataFrame, folder: str, format: str = "xml", cwd: str = "."
) -> None:
    writers = {"xml": write_xml, "json": write_json, "yaml": write_yaml}
    if format.lower() not in writers:
        raise ValueError(f"invalid format: {format} (must be one of {', '.join(FORMATS)})")
    writers[format.lower()](files, tree, folder, cwd)


def read_context(spark, folder: str, format: str = "xml") -> DataFrame:
    """The directory context of a written bundle: cwd, block, tree."""
    schema = "cwd string, block bigint, tree string"
    context = f"{folder}/context"
    if format == "xml":
        read = spark.read.format("xml").schema(schema)
        return read.options(rowTag="directory-context", ignoreSurroundingSpaces="false").load(context)
    if format == "json":
        return spark.read.schema(schema).json(context)
    if format == "yaml":
        lines = spark.read.text(context).where(F.col("value") != "---")
        read = F.from_json("value", "directory_context struct<cwd: string, block: bigint, tree: string>")
        return lines.select(read.alias("row")).select("row.directory_context.*")
    raise ValueError(f"invalid format: {format}")


def read_bundle(spark, folder: str, format: str = "xml") -> DataFrame:
    """The files of a written bundle: path, content."""
    schema = "path string, content string"
    files = f"{folder}/files"
    if format == "xml":
        read = spark.read.format("xml").schema(schema)
        rows = read.options(rowTag="file", ignoreSurroundingSpaces="false").load(files)
    elif format == "json":
        rows = spark.read.schema(schema).json(files)
    elif format == "yaml":
        lines = spark.read.text(files).where(F.col("value") != "---")
        rows = lines.select(F.from_json("value", schema).alias("file")).select("file.*")
    else:
        raise ValueError(f"invalid format: {format}")
    return rows.withColumn("content", F.coalesce("content", F.lit("")))
