"""Corpus preparation on Spark: scan, filter, enrich, chunk, search, select, bundle."""

from sheaf.operators.chunking import chunk_bytes, overlap_tail, pack_segments, split_segments
from sheaf.operators.enrich import (
    strip_comments,
    with_language,
    with_line_count,
    with_token_count,
)
from sheaf.operators.filters import (
    cap_files,
    filter_ignored,
    filter_size,
    filter_tree_ignored,
    gate_processable,
    over_size,
    with_is_binary,
)
from sheaf.operators.parts import count_parts, grep_parts, strip_parts
from sheaf.operators.search import (
    grep_lines,
    match_stats,
    preview,
    search_aligned,
    search_and_preview,
    search_fuzzy,
    search_fuzzy_many,
    search_path,
)
from sheaf.operators.selection import apply_ops, select_contents, selection_state
from sheaf.operators.tree import dir_tree, render_tree
from sheaf.options import BundleOptions
from sheaf.plans.bundle import Bundle, build_bundle, bundle_chunks, bundle_listing, processed_files
from sheaf.sinks.bundle import (
    read_bundle,
    read_context,
    write_bundle,
    write_json,
    write_xml,
    write_yaml,
)
from sheaf.sinks.document import document_bytes, read_document, write_document
from sheaf.sinks.tree import write_tree
from sheaf.sources.parts import list_parts, read_parts
from sheaf.sources.tree import read_contents, scan_tree
from sheaf.sources.tree_format import register_tree
from sheaf.streaming.buffer import buffer_stream, read_buffer, write_buffer
from sheaf.streaming.scan import scan_stream, write_available
from sheaf.streaming.selection import (
    compact_selection,
    read_selection,
    selection_stream,
    write_selection,
)

__all__ = [
    "Bundle",
    "BundleOptions",
    "apply_ops",
    "buffer_stream",
    "build_bundle",
    "bundle_chunks",
    "bundle_listing",
    "cap_files",
    "chunk_bytes",
    "compact_selection",
    "count_parts",
    "dir_tree",
    "document_bytes",
    "filter_ignored",
    "filter_size",
    "filter_tree_ignored",
    "gate_processable",
    "grep_lines",
    "grep_parts",
    "list_parts",
    "match_stats",
    "over_size",
    "overlap_tail",
    "pack_segments",
    "preview",
    "processed_files",
    "read_buffer",
    "read_bundle",
    "read_context",
    "read_contents",
    "read_document",
    "read_parts",
    "read_selection",
    "register_tree",
    "render_tree",
    "scan_stream",
    "scan_tree",
    "search_aligned",
    "search_and_preview",
    "search_fuzzy",
    "search_fuzzy_many",
    "search_path",
    "select_contents",
    "selection_state",
    "selection_stream",
    "split_segments",
    "strip_comments",
    "strip_parts",
    "with_is_binary",
    "with_language",
    "with_line_count",
    "with_token_count",
    "write_available",
    "write_buffer",
    "write_bundle",
    "write_document",
    "write_json",
    "write_tree",
    "write_selection",
    "write_xml",
    "write_yaml",
]
