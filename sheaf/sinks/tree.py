"""Files written as a directory tree."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.sources.tree import _FILES_PER_TASK, _send_code_along


def write_tree(files: DataFrame, root: str) -> int:
    """Write each row's ``content`` as the file ``path`` below ``root``; returns how many.

    Rows are dealt out by their path to tasks of about 5,000 files, since a file costs far
    more time than its bytes. A file appears whole, by a rename, so a task that
    runs again does no harm; of rows with one path any one stays. ``root`` is a path or
    an address, as in ``scan_tree``.
    """
    _send_code_along()
    address = root if "://" in root or root.startswith("file:") else f"file://{os.path.abspath(root)}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(address)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = posixpath.join(base, path)
                folder = posixpath.dirname(name)
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                whole = posixpath.join(folder, f".{uuid.uuid4().hex}")
                with system.open_output_stream(whole) as file:
                    file.write(content.as_buffer() or b"")
                system.move(whole, name)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // _FILES_PER_TASK))
    dealt = files.select("path", "content").repartition(tasks, "path")
    done = dealt.mapInArrow(write, "n bigint")
    return done.agg({"n": "sum"}).first()[0] or 0
