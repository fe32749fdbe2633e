"""The whole run: filter, select, enrich, strip, and the directory tree beside it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.operators.chunking import chunk_bytes
from sheaf.operators.enrich import strip_comments, with_language
from sheaf.operators.filters import (
    cap_files,
    filter_ignored,
    filter_size,
    filter_tree_ignored,
    gate_processable,
    with_is_binary,
)
from sheaf.operators.order import in_path_order
from sheaf.operators.selection import select_contents
from sheaf.operators.tree import dir_tree
from sheaf.options import BundleOptions
from sheaf.sources.tree import read_contents


@dataclass(frozen=True)
class Bundle:
    files: DataFrame
    """path, size, is_binary, language, content"""
    tree: DataFrame
    """root, parts, depth, line"""


def _chosen(files: DataFrame, selected: DataFrame | None, options: BundleOptions) -> DataFrame:
    """Files that pass the filters and the selection; contents are not looked at."""
    kept = filter_size(files, options.max_file_size)
    kept = filter_ignored(kept, options.ignore_patterns)
    kept = cap_files(kept, options.max_files)
    return kept if selected is None else select_contents(kept, selected)


def _processed(files: DataFrame, options: BundleOptions, *more: str) -> DataFrame:
    """Binary and empty files stay with empty content and no language."""
    limit = options.max_line_bytes
    kept = gate_processable(with_language(with_is_binary(files), max_line_bytes=limit))
    if options.strip_comments:
        kept = strip_comments(kept, max_line_bytes=limit)
    return kept.select(
        "path", "size", "is_binary", "language", F.coalesce("content", F.lit(b"")).alias("content"), *more
    )


def _by_path(files: DataFrame) -> DataFrame:
    """Range-partitioned by path; the second key lets one path fill several partitions."""
    return files.repartitionByRange("path", F.xxhash64("path", "size"))


def processed_files(
    files: DataFrame,
    selected: DataFrame | None = None,
    options: BundleOptions = BundleOptions(),
    by_path: bool = False,
    position: bool = False,
) -> DataFrame:
    """Files that pass the filters and the selection, ready to be written.

    Row filters and the selection come first, so content is looked at only for files
    that stay.

    ``by_path`` orders the files by path before the contents are worked on; with
    ``position`` their places in that order are a column.
    """
    kept = _chosen(files, selected, options)
    if not by_path and not position:
        return _processed(kept, options)
    done = _processed(in_path_order(kept), options, "position")
    return done if position else done.drop("position")


def _tree(listing: DataFrame, options: BundleOptions) -> DataFrame:
    paths = listing.select("path")
    return dir_tree(filter_tree_ignored(paths, options.ignore_patterns), options.root)


def build_bundle(
    files: DataFrame, selected: DataFrame | None = None, options: BundleOptions = BundleOptions()
) -> Bundle:
    """The processed files, and the tree of all files under the tree's own ignore rule.

    For files that already have contents, such as the rows of a table.
    """
    return Bundle(processed_files(files, selected, options, by_path=True), _tree(files, options))


def bundle_listing(
    listing: DataFrame,
    root: str,
    selected: DataFrame | None = None,
    options: BundleOptions = BundleOptions(),
) -> Bundle:
    """The bundle of a listing: contents are read last, and only those of chosen files.

    Filters, cap, selection and the order work on the listing, some hundred bytes a file,
    and each file is then read once, in its place. The tree is drawn from the listing as
    it is, so scan without a size limit and without patterns; the options bring both.
    Files that cannot be read are in the tree only, and so are directories, of which those
    without files are drawn if the listing has them as rows.
    """
    shown = F.col("size").isNotNull()
    if "is_directory" in listing.columns:
        shown = shown | F.col("is_directory")
    good = listing.where("error IS NULL AND size IS NOT NULL")
    ordered = _by_path(_chosen(good, selected, options)).sortWithinPartitions("path")
    read = read_contents(ordered, root, in_place=True).where("error IS NULL")
    return Bundle(_processed(read, options), _tree(listing.where(shown), options))


def bundle_chunks(files: DataFrame, options: BundleOptions = BundleOptions()) -> DataFrame:
    """Chunks of processed files whose original size exceeds the chunk size."""
    return chunk_bytes(files, options.chunk_size, options.chunk_overlap)
