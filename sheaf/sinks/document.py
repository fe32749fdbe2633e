"""A bundle as one document, of which readers see all or nothing.

Files and directory context are one XML, JSON or YAML document, cut into pieces that tasks
write on their own. What stands between the pieces and their order are in a manifest, which
is written last, by a rename, when every task has reported its piece. Without it there is
no bundle: a failed job leaves none, and a task that runs again leaves a piece that nothing
names. The pieces and texts of the manifest, one after the other, are the document; every
file and every block of the tree is one line of it.
"""

from __future__ import annotations

import itertools
import json
import os
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from sheaf.functions.text import as_text
from sheaf.operators.tree import render_tree
from sheaf.sinks.bundle import _NOT_XML, FORMATS, _yaml_flow
from sheaf.sources.tree import _send_code_along

MANIFEST = "manifest.json"
_ROWS = "section string, position bigint, value string"
_LINES_PER_BATCH = 1000


def _xml_text(text: Column) -> Column:
    """Escaped, with line ends as references, so that it stays on one line."""
    out = F.regexp_replace(text, _NOT_XML, "�")
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def _xml_literal(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def _string(text: Column) -> Column:
    """A JSON string: the value in an object of one field, whose other characters are eight."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def _rendered(format: str, section: str) -> Column:
    if section == "files":
        content = F.coalesce(F.make_valid_utf8(as_text(F.col("content"))), F.lit(""))
        if format == "xml":
            parts = F.lit("<file><path>"), _xml_text(F.col("path")), F.lit("</path><content>"), _xml_text(content)
            return F.concat(*parts, F.lit("</content></file>"))
        line = F.to_json(F.struct("path", content.alias("content")))
        return line if format == "json" else F.concat(F.lit("- "), _yaml_flow(line))
    if format == "xml":
        return F.concat(F.lit("<tree>"), _xml_text(F.col("tree")), F.lit("</tree>"))
    line = _string(F.col("tree"))
    return line if format == "json" else F.concat(F.lit("  - "), _yaml_flow(line))


def _frame(format: str, cwd: str, has_files: bool) -> tuple[str, str, str, str]:
    """What stands before the files, between lines, before the tree and at the end."""
    if format == "xml":
        head = '<?xml version="1.0" encoding="UTF-8"?>\n<bundle>\n<files>\n'
        context = f"</files>\n<directory-context>\n<cwd>{_xml_literal(cwd)}</cwd>\n"
        return head, "\n", "\n" * has_files + context, "\n</directory-context>\n</bundle>\n"
    if format == "json":
        context = f'],"directory_context":{{"cwd":{json.dumps(cwd)},"tree":[\n'
        return '{"files":[\n', ",\n", "\n" * has_files + context, "\n]}}\n"
    head = "files:\n" if has_files else "files: []\n"
    return head, "\n", "\n" * has_files + f"directory_context:\n  cwd: {json.dumps(cwd)}\n  tree:\n", "\n"


def write_document(files: DataFrame, tree: DataFrame, folder: str, format: str = "xml", cwd: str = ".") -> None:
    """Write files (path, content) and a tree as one document in ``folder``.

    Files come range-partitioned by path, as a bundle's do, and so stand in path order.
    ``folder`` is a path or an address, as in ``scan_tree``, and must not hold a document.
    """
    format = format.lower()
    if format not in FORMATS:
        raise ValueError(f"invalid format: {format} (must be one of {', '.join(FORMATS)})")
    register_documents(files.sparkSession)
    ordered = files.sortWithinPartitions("path")
    blocks = render_tree(tree).orderBy("root", "block")
    # Tasks are numbered through the union, so the tree's come after the files'.
    rows = ordered.select(F.lit("files").alias("section"), _rendered(format, "files").alias("value")).unionByName(
        blocks.select(F.lit("tree").alias("section"), _rendered(format, "tree").alias("value"))
    )
    rows.write.format("bundle_document").options(format=format, cwd=cwd).mode("append").save(folder)


def read_document(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The files (position, path, content) and the context (cwd, block, tree) of a document."""
    register_documents(spark)
    rows = spark.read.format("bundle_document").load(folder)
    manifest = _manifest(folder)
    format, cwd = manifest["format"], manifest["cwd"]
    value = F.col("value")
    if format == "xml":
        keep = {"ignoreSurroundingSpaces": "false"}
        file = F.from_xml(value, "path string, content string", keep)
        block = F.from_xml(F.concat(F.lit("<t>"), value, F.lit("</t>")), "tree string", keep)["tree"]
    else:
        text = F.regexp_replace(value, r"\A *- " if format == "yaml" else r",\z", "")
        file = F.from_json(text, "path string, content string")
        block = F.from_json(F.concat(F.lit('{"tree":'), text, F.lit("}")), "tree string")["tree"]
    files = rows.where("section = 'files'").select("position", file.alias("file"))
    files = files.select("position", "file.path", F.coalesce("file.content", F.lit("")).alias("content"))
    context = rows.where("section = 'tree'").select(
        F.lit(cwd).alias("cwd"), F.col("position").alias("block"), block.alias("tree")
    )
    return files, context


def document_bytes(folder: str) -> Iterator[bytes]:
    """The document itself, piece by piece, for a copy to one file."""
    system, base = _place(folder)
    for piece in _manifest(folder)["pieces"]:
        if "text" in piece:
            yield piece["text"].encode()
        else:
            with system.open_input_stream(posixpath.join(base, piece["file"])) as file:
                while data := file.read(1 << 20):
                    yield data


def register_documents(spark: SparkSession) -> None:
    _send_code_along()
    spark.dataSource.register(BundleDocument)


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    address = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    return fs.FileSystem.from_uri(address)


def _exists(system: fs.FileSystem, name: str) -> bool:
    return system.get_file_info(name).type != fs.FileType.NotFound


def _manifest(folder: str) -> dict:
    system, base = _place(folder)
    name = posixpath.join(base, MANIFEST)
    if not _exists(system, name):
        raise FileNotFoundError(f"no finished document in {folder}")
    with system.open_input_stream(name) as file:
        return json.loads(file.read())


@dataclass
class _Piece(ds.WriterCommitMessage):
    """What one task wrote: the rows of one section, in one file."""

    task: int
    section: str
    file: str
    rows: int


@dataclass
class _Pieces(ds.WriterCommitMessage):
    pieces: list[_Piece]


class BundleDocument(ds.DataSource):
    """Options: ``path`` (the folder), and for writing ``format`` and ``cwd``."""

    @classmethod
    def name(cls) -> str:
        return "bundle_document"

    def schema(self) -> str:
        return _ROWS

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


class DocumentWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.format, self.cwd = options["path"], options["format"], options["cwd"]
        system, base = _place(self.folder)
        if _exists(system, posixpath.join(base, MANIFEST)):
            raise FileExistsError(f"there is a document in {self.folder}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Pieces:
        """A file for each section among the task's rows, in which lines are separated."""
        system, base = _place(self.folder)
        system.create_dir(posixpath.join(base, "pieces"), recursive=True)
        between = _frame(self.format, self.cwd, True)[1].encode()
        task, pieces, files = TaskContext.get().partitionId(), {}, {}
        try:
            for batch in iterator:
                for section, value in zip(batch.column("section").to_pylist(), batch.column("value").to_pylist()):
                    if section not in pieces:
                        name = f"pieces/{task:08d}-{section}-{uuid.uuid4().hex}"
                        pieces[section] = _Piece(task, section, name, 0)
                        files[section] = system.open_output_stream(posixpath.join(base, name))
                    piece = pieces[section]
                    files[section].write((between if piece.rows else b"") + value.encode())
                    piece.rows += 1
        except BaseException:
            for section, file in files.items():
                file.close()
                system.delete_file(posixpath.join(base, pieces[section].file))
            raise
        for file in files.values():
            file.close()
        return _Pieces(list(pieces.values()))

    def commit(self, messages: list[_Pieces | None]) -> None:
        system, base = _place(self.folder)
        pieces = sorted((p for m in messages if m for p in m.pieces), key=lambda p: (p.section != "files", p.task))
        sections = {s: [p for p in pieces if p.section == s] for s in ("files", "tree")}
        head, between, context, end = _frame(self.format, self.cwd, bool(sections["files"]))
        listed: list[dict] = [{"text": head}]
        for section, after in (("files", context), ("tree", end)):
            for k, piece in enumerate(sections[section]):
                if k:
                    listed.append({"text": between})
                listed.append(asdict(piece))
            listed.append({"text": after})
        manifest = {"format": self.format, "cwd": self.cwd, "pieces": listed}
        whole = posixpath.join(base, f".{uuid.uuid4().hex}")
        system.create_dir(base, recursive=True)
        with system.open_output_stream(whole) as file:
            file.write(json.dumps(manifest).encode())
        system.move(whole, posixpath.join(base, MANIFEST))

    def abort(self, messages: list[_Pieces | None]) -> None:
        system, base = _place(self.folder)
        for piece in (p for m in messages if m for p in m.pieces):
            name = posixpath.join(base, piece.file)
            if _exists(system, name):
                system.delete_file(name)


@dataclass
class _ListedPiece(ds.InputPartition):
    file: str
    section: str
    first: int


class DocumentReader(ds.DataSourceReader):
    """A task for every piece that the manifest names; positions count through its section."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[_ListedPiece]:
        at = {"files": 0, "tree": 0}
        out = []
        for piece in _manifest(self.folder)["pieces"]:
            if "file" in piece:
                out.append(_ListedPiece(piece["file"], piece["section"], at[piece["section"]]))
                at[piece["section"]] += piece["rows"]
        return out

    def read(self, partition: _ListedPiece) -> Iterator[pa.RecordBatch]:
        system, base = _place(self.folder)
        number = itertools.count(partition.first)
        held: list[tuple] = []
        with pa.PythonFile(system.open_input_file(posixpath.join(base, partition.file)), mode="r") as file:
            for line in _lines(file):
                held.append((partition.section, next(number), line))
                if len(held) == _LINES_PER_BATCH:
                    yield _line_batch(held)
                    held = []
        if held:
            yield _line_batch(held)


def _lines(file) -> Iterator[str]:
    rest = b""
    while data := file.read(1 << 20):
        *lines, rest = (rest + data).split(b"\n") if b"\n" in data else [rest + data]
        for line in lines:
            yield line.decode()
    yield rest.decode()


def _line_batch(rows: list[tuple]) -> pa.RecordBatch:
    section, position, value = zip(*rows)
    return pa.record_batch(
        [pa.array(section), pa.array(position, pa.int64()), pa.array(value)], names=["section", "position", "value"]
    )
