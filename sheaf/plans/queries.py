"""The registered queries: one per operator, over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.constants import DEFAULT_IGNORE_PATTERNS
from sheaf.functions.text import as_text
from sheaf.operators import chunking, enrich, filters, parts, search, selection, tree
from sheaf.options import BundleOptions
from sheaf.plans import views
from sheaf.plans.bundle import build_bundle, bundle_chunks, bundle_listing, processed_files
from sheaf.session import new_folder
from sheaf.sinks.bundle import read_bundle, read_context, write_bundle
from sheaf.sinks.document import read_document, write_document
from sheaf.sinks.tree import write_tree
from sheaf.sources.parts import read_parts
from sheaf.sources.tree import read_contents, scan_tree
from sheaf.sources.tree_format import register_tree
from sheaf.streaming.buffer import buffer_stream, read_buffer, write_buffer
from sheaf.streaming.scan import scan_stream, write_available
from sheaf.streaming.selection import read_selection, selection_stream, write_selection

# Parameters the queries and their SQL share.
MAX_SIZE = 4000
CAP = 100
SCAN_PATTERNS = (*DEFAULT_IGNORE_PATTERNS, "*.MD", "src/*.go", "src/node_modules/de*")
TREE_PATTERNS = ("/fr/", "*7", "cheap?pills", "spam-farm", "m.*.net", "en/*", "[a-b]*.ht*")
WALK_PATTERNS = ("*.py", "d2/", "*.crc")
CHUNK, OVERLAP, TOKENS = 256, 32, 60
PART = 700
DIRECTORIES = 1000
LINE_QUERY = "The"
PATH_QUERY = "EXAMPLE"
FUZZY_QUERY = "exfr"
FUZZY_QUERIES = ("exfr", "e", "html", "2a", "c.o")
TOP = 20


def _md5(content: str = "content"):
    return F.md5(F.col(content).cast("binary")).alias("content_md5")


def tokens_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per file with its language, without ignored and large files."""
    kept = filters.filter_ignored(filters.filter_size(views.files(spark, folder)))
    rows = enrich.with_token_count(enrich.with_language(kept))
    return rows.select("doc_id", "path", "language", "token_count")


def tree_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents written as text files, one directory per language, scanned again."""
    root = new_folder(spark, "tree")
    views.texts(spark, folder, "documents").select("lang", "text").write.partitionBy("lang").text(root)
    # Spark's own bookkeeping files are there too, since hidden files are listed.
    found = scan_tree(spark, root, ["*/.*.crc", ".*.crc", "_SUCCESS"])
    read = enrich.with_token_count(enrich.with_line_count(read_contents(found, root)))
    return read.groupBy(F.substring_index("path", "/", 1).alias("directory")).agg(
        F.sum("size").alias("size"),
        F.sum(F.octet_length("content").cast("bigint")).alias("content_bytes"),
        F.sum(F.col("line_count") - 1).alias("newlines"),
        F.sum("token_count").alias("token_count"),
        F.count("error").alias("errors"),
    )


def _text_files(spark: SparkSession, folder: str, rows: DataFrame) -> tuple[DataFrame, str]:
    """Documents written as one file each, named by doc_id, and listed again.

    A directory is listed by one task, so the files lie in many.
    """
    root = new_folder(spark, "files").removeprefix("file:")
    path = F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(DIRECTORIES)), F.lit("/"), "doc_id")
    write_tree(rows.select(path.alias("path"), F.col("content").cast("binary")), root)
    return scan_tree(spark, root), root


def _by_document(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.substring_index("path", "/", -1).cast("bigint")).drop("path")


def file_part_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Lines and tokens of files that are read as parts of some hundred bytes."""
    listing, root = _text_files(spark, folder, _documents(spark, folder))
    return _by_document(parts.count_parts(read_parts(listing, root, PART)))


def file_part_search(spark: SparkSession, folder: str) -> DataFrame:
    """Matching lines of the same files, of which many are cut by a part's end."""
    listing, root = _text_files(spark, folder, _documents(spark, folder))
    rows = parts.grep_parts(read_parts(listing, root, PART), LINE_QUERY)
    return _by_document(rows.withColumn("line_no", F.col("line_no").cast("bigint")))


def file_part_stripping(spark: SparkSession, folder: str) -> DataFrame:
    """Comments stripped part by part, and the parts put together again."""
    listing, root = _text_files(spark, folder, views.commented(spark, folder))
    rows = parts.strip_parts(read_parts(listing, root, PART, whole_lines=True))
    whole = F.array_sort(F.collect_list(F.struct("part", as_text(F.col("content")).alias("text"))))
    joined = rows.groupBy("path").agg(F.array_join(F.transform(whole, lambda p: p["text"]), "").alias("content"))
    return _by_document(joined)


def size_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.filter_size(views.files(spark, folder), MAX_SIZE).select("doc_id", "path", "size")


def file_cap(spark: SparkSession, folder: str) -> DataFrame:
    return filters.cap_files(views.files(spark, folder), CAP).select("path", "size", _md5())


def scan_ignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.filter_ignored(views.files(spark, folder), SCAN_PATTERNS).select("doc_id", "path")


def incremental_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The documents as a stream of files, enriched on the way into a table."""
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    stream = scan_stream(spark, folder, schema, table="documents.parquet")
    rows = stream.select(
        "doc_id",
        F.concat(F.lit("docs/"), "source", F.lit(".py")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
        F.col("text").cast("binary").alias("content"),
    )
    rows = filters.with_is_binary(filters.filter_ignored(rows))
    rows = enrich.with_token_count(enrich.strip_comments(enrich.with_language(rows)))
    rows = rows.select("doc_id", "path", "size", "is_binary", "language", "token_count")
    out = new_folder(spark, "incremental")
    write_available(rows, out, new_folder(spark, "incremental-checkpoint"))
    return spark.read.parquet(out)


def tree_source(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a tree by SQL, whose conditions keep directories and files from being opened."""
    root = new_folder(spark, "files").removeprefix("file:")
    write_tree(views.files(spark, folder), root)
    register_tree(spark)
    tree = spark.read.format("file_tree").option("contents", "true").load(root)
    rows = tree.where(f"path LIKE 'src/%' AND size <= {MAX_SIZE} AND error IS NULL")
    return rows.select("path", "size", _md5())


def tree_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a tree handled as they appear, some ignored, binary or full of comments.

    Half of the files are there when the first run lists the tree; the second run goes on
    from its checkpoint.
    """
    root = new_folder(spark, "files").removeprefix("file:")
    out, checkpoint = new_folder(spark, "arrived"), new_folder(spark, "arrived-checkpoint")
    register_tree(spark)
    files = views.mixed_files(spark, folder)
    for half in (0, 1):
        write_tree(files.where(F.col("doc_id") % 2 == half), root)
        stream = spark.readStream.format("file_tree").options(contents="true", settle="0").load(root)
        rows = filters.with_is_binary(filters.filter_ignored(stream.where("error IS NULL")))
        rows = filters.gate_processable(enrich.with_language(rows))
        rows = enrich.with_token_count(enrich.strip_comments(rows))
        rows = rows.select("path", "size", "is_binary", "language", "token_count", _md5())
        write_available(rows, out, checkpoint)
    return spark.read.parquet(out)


def binary_flag(spark: SparkSession, folder: str) -> DataFrame:
    return filters.with_is_binary(views.binaries(spark, folder)).select("doc_id", "is_binary")


def processable_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.binaries(spark, folder).withColumn("size", F.octet_length("content").cast("bigint"))
    gated = filters.gate_processable(filters.with_is_binary(rows))
    return gated.select("doc_id", "size", "is_binary", _md5())


def language_detection(spark: SparkSession, folder: str) -> DataFrame:
    """Languages, with every ninth file's already known."""
    known = F.when(F.col("doc_id") % 9 == 0, "known").otherwise("")
    rows = views.files(spark, folder).withColumn("language", known)
    return enrich.with_language(rows).select("doc_id", "path", "language")


def comment_stripping(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.strip_comments(views.commented(spark, folder))
    return rows.select("doc_id", as_text(F.col("content")).alias("content"))


def document_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.with_token_count(views.texts(spark, folder, "documents"), "text")
    return rows.select("doc_id", "token_count")


def conversation_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.with_token_count(views.texts(spark, folder, "conversations"), "text")
    return rows.select("conv_id", "turn", "token_count")


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = enrich.with_line_count(views.texts(spark, folder, "documents"), "text")
    return rows.select("doc_id", "line_count")


def _chunk_rows(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(
        key,
        "chunk_idx",
        "start",
        F.hex("content").alias("content_hex"),
        "start_line",
        "end_line",
        "token_count",
    )


def overlapping_chunks(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.texts(spark, folder, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("content")
    )
    return _chunk_rows(chunking.chunk_bytes(rows, CHUNK, OVERLAP, "doc_id", gate=None), "doc_id")


def markup_segments(spark: SparkSession, folder: str) -> DataFrame:
    pages = views.texts(spark, folder, "pages")
    return chunking.split_segments(pages, content="html", key="page_id")


def budget_packing(spark: SparkSession, folder: str) -> DataFrame:
    pages = views.texts(spark, folder, "pages").withColumn("html", F.col("html").cast("binary"))
    return _chunk_rows(chunking.pack_segments(pages, CHUNK, TOKENS, "page_id", "html"), "page_id")


def budget_packing_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.commented(spark, folder)
    return _chunk_rows(chunking.pack_segments(rows, 4 * CHUNK, TOKENS, "doc_id"), "doc_id")


def overlap_tail(spark: SparkSession, folder: str) -> DataFrame:
    rows = views.texts(spark, folder, "documents").select(
        "doc_id", F.col("text").cast("binary").alias("content")
    )
    tails = chunking.overlap_tail(rows, CHUNK)
    return tails.select("doc_id", F.hex("overlap_tail").alias("tail_hex"))


def path_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_path(views.table(spark, folder, "part"), "ED", "p_name").select(
        "p_partkey", "p_name"
    )


def fuzzy_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_fuzzy(views.paths(spark, folder), FUZZY_QUERY, TOP)


def fuzzy_search_many(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.search_fuzzy_many(views.paths(spark, folder), FUZZY_QUERIES, TOP)
    return rows.select("query", "path", "span", "start", F.col("rank").cast("bigint").alias("rank"))


def aligned_search(spark: SparkSession, folder: str) -> DataFrame:
    """The same query ranked by the best place for each letter."""
    return search.search_aligned(views.paths(spark, folder), FUZZY_QUERY, TOP)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return views.texts(spark, folder, "documents").select("doc_id", F.col("text").alias("content"))


def line_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.grep_lines(_documents(spark, folder), LINE_QUERY, "doc_id")
    return rows.withColumn("line_no", F.col("line_no").cast("bigint"))


def match_stats(spark: SparkSession, folder: str) -> DataFrame:
    return search.match_stats(_documents(spark, folder), LINE_QUERY, "doc_id")


def line_preview(spark: SparkSession, folder: str) -> DataFrame:
    return search.preview(_documents(spark, folder), LINE_QUERY, "doc_id")


def selection_state(spark: SparkSession, folder: str) -> DataFrame:
    return selection.selection_state(views.table(spark, folder, "events"), "user_id")


def selection_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    toggles = scan_stream(spark, folder, schema, table="events.parquet").select("user_id")
    out = new_folder(spark, "selection")
    state = selection_stream(toggles, "user_id")
    write_selection(state, out, new_folder(spark, "selection-checkpoint"))
    return read_selection(spark, out, "user_id")


def latest_writes(spark: SparkSession, folder: str) -> DataFrame:
    return selection.apply_ops(views.operations(spark, folder))


def buffer_from_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same buffer from a stream of operations, a fifth of them at a time, in no order."""
    ops = views.operations(spark, folder)
    arriving = new_folder(spark, "operations")
    ops.repartition(5, "seq").write.parquet(arriving)
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    out = new_folder(spark, "buffer")
    write_buffer(buffer_stream(stream), out, new_folder(spark, "buffer-checkpoint"))
    return read_buffer(spark, out)


def selected_contents(spark: SparkSession, folder: str) -> DataFrame:
    chosen = views.selected_documents(spark, folder)
    rows = selection.select_contents(views.files(spark, folder), chosen, "doc_id")
    return rows.select("doc_id", "path", _md5())


def tree_ignore_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.filter_tree_ignored(views.paths(spark, folder), TREE_PATTERNS)


def directory_tree(spark: SparkSession, folder: str) -> DataFrame:
    rows = tree.dir_tree(views.paths(spark, folder))
    return rows.select(
        "root",
        F.array_join("parts", "/").alias("path"),
        F.col("depth").cast("bigint").alias("depth"),
        "line",
    )


def rendered_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The rendered text, cut into lines again and counted."""
    blocks = tree.render_tree(tree.dir_tree(views.paths(spark, folder)), 50)
    lines = blocks.select(F.explode(F.split("tree", "\n")).alias("line")).where("line != ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _written_bundle(spark: SparkSession, folder: str, format: str) -> str:
    """All files written as a bundle; returns its folder."""
    options = BundleOptions(ignore_patterns=(), max_file_size=None)
    bundle = build_bundle(views.files(spark, folder), options=options)
    out = new_folder(spark, format)
    write_bundle(bundle.files, bundle.tree, out, format, cwd="/work & <tree>")
    return out


def _bundle(spark: SparkSession, folder: str, format: str) -> DataFrame:
    out = _written_bundle(spark, folder, format)
    return read_bundle(spark, out, format).select("path", _md5())


def _tree_lines(context: DataFrame) -> DataFrame:
    lines = context.select("cwd", F.explode(F.split("tree", "\n")).alias("line")).where("line != ''")
    return lines.groupBy("cwd", "line").agg(F.count(F.lit(1)).alias("n"))


def _context(spark: SparkSession, folder: str, format: str) -> DataFrame:
    """The directory context of a written bundle, read back and counted by line."""
    return _tree_lines(read_context(spark, _written_bundle(spark, folder, format), format))


def xml_context(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder, "xml")


def json_context(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder, "json")


def yaml_context(spark: SparkSession, folder: str) -> DataFrame:
    return _context(spark, folder, "yaml")


def xml_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "xml")


def json_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "json")


def yaml_bundle(spark: SparkSession, folder: str) -> DataFrame:
    return _bundle(spark, folder, "yaml")


def _document(spark: SparkSession, folder: str, format: str) -> DataFrame:
    """All files as one committed document, read back with their places in it."""
    options = BundleOptions(ignore_patterns=(), max_file_size=None)
    bundle = build_bundle(views.files(spark, folder), options=options)
    out = new_folder(spark, f"{format}-document")
    write_document(bundle.files, bundle.tree, out, format)
    return read_document(spark, out)[0].select("position", "path", _md5())


def xml_document(spark: SparkSession, folder: str) -> DataFrame:
    return _document(spark, folder, "xml")


def json_document(spark: SparkSession, folder: str) -> DataFrame:
    return _document(spark, folder, "json")


def yaml_document(spark: SparkSession, folder: str) -> DataFrame:
    return _document(spark, folder, "yaml")


def _selected_paths(spark: SparkSession, folder: str) -> DataFrame:
    chosen = views.selected_documents(spark, folder)
    return views.files(spark, folder).select("doc_id", "path").join(chosen, "doc_id", "left_semi")


def context_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run on the selected files, comments stripped."""
    rows = processed_files(
        views.commented_files(spark, folder),
        _selected_paths(spark, folder),
        BundleOptions(strip_comments=True, max_file_size=None),
    )
    return rows.select("path", "size", "is_binary", "language", _md5())


def ordered_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The same files in the order of their paths, with their places in it."""
    rows = processed_files(
        views.commented_files(spark, folder),
        _selected_paths(spark, folder),
        BundleOptions(strip_comments=True, max_file_size=None),
        position=True,
    )
    return rows.select("position", "path", "size", "is_binary", "language", _md5())


def _listed_bundle(spark: SparkSession, folder: str) -> str:
    """Documents written as a tree of files, listed, and bundled from the listing."""
    root, out = new_folder(spark, "files").removeprefix("file:"), new_folder(spark, "listed")
    write_tree(views.commented_files(spark, folder), root)
    options = BundleOptions(strip_comments=True, max_file_size=None)
    chosen = _selected_paths(spark, folder)
    bundle = bundle_listing(scan_tree(spark, root), root, chosen, options)
    write_bundle(bundle.files, bundle.tree, out, "json", cwd="files")
    return out


def listed_bundle(spark: SparkSession, folder: str) -> DataFrame:
    """The whole run from a directory tree: the selected files as they were written."""
    return read_bundle(spark, _listed_bundle(spark, folder), "json").select("path", _md5())


def listed_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The same run's directory tree, of all files under the tree's own rule."""
    return _tree_lines(read_context(spark, _listed_bundle(spark, folder), "json"))


def walked_tree(spark: SparkSession, folder: str) -> DataFrame:
    """The tree of a listing with its directories, some of which hold ignored files only."""
    root = new_folder(spark, "walk").removeprefix("file:")
    name = F.element_at(F.split("path", "/"), -1)
    place = F.concat(F.lit("d"), F.col("doc_id") % 30, F.lit("/"), name)
    write_tree(views.files(spark, folder).withColumn("path", place), root)
    options = BundleOptions(ignore_patterns=WALK_PATTERNS)
    lines = bundle_listing(scan_tree(spark, root, directories=True), root, options=options).tree
    return lines.select(F.array_join("parts", "/").alias("path"), F.col("depth").cast("bigint").alias("depth"), "line")


def context_bundle_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of the whole run on all files, comments stripped."""
    options = BundleOptions(
        strip_comments=True, max_file_size=None, chunk_size=1000, chunk_overlap=100
    )
    rows = processed_files(views.commented_files(spark, folder), options=options)
    return _chunk_rows(bundle_chunks(rows, options), "path")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        tokens_by_file,
        tree_scan,
        file_part_counts,
        file_part_search,
        file_part_stripping,
        size_filter,
        file_cap,
        scan_ignore_filter,
        incremental_scan,
        tree_source,
        tree_stream,
        binary_flag,
        processable_gate,
        language_detection,
        comment_stripping,
        document_tokens,
        conversation_tokens,
        document_lines,
        overlapping_chunks,
        markup_segments,
        budget_packing,
        budget_packing_lines,
        overlap_tail,
        path_search,
        fuzzy_search,
        fuzzy_search_many,
        aligned_search,
        line_search,
        match_stats,
        line_preview,
        selection_state,
        selection_from_stream,
        latest_writes,
        buffer_from_stream,
        selected_contents,
        tree_ignore_filter,
        directory_tree,
        rendered_tree,
        xml_bundle,
        json_bundle,
        yaml_bundle,
        xml_context,
        json_context,
        yaml_context,
        xml_document,
        json_document,
        yaml_document,
        listed_bundle,
        listed_tree,
        walked_tree,
        context_bundle,
        ordered_bundle,
        context_bundle_chunks,
    )
}
