"""Search over paths and lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import constants
from sheaf.functions.constants import PREVIEW_CONTEXT, PREVIEW_LINES
from sheaf.functions.globs import quote
from sheaf.functions.text import as_text, line_count, lower_letters, lower_query, newline_count

# Salts of the rounds that cut a query's paths to k, the last of which sees one part.
_TOP_K_PARTS = (4096, 64, 1)


def _contains(text: Column, query: str) -> Column:
    """Case-insensitive substring test."""
    return lower_letters(text).contains(lower_query(query))


def search_path(df: DataFrame, query: str, path: str = "path") -> DataFrame:
    """Files whose path contains ``query`` in any case; an empty query keeps all."""
    return df if query == "" else df.where(_contains(F.col(path), query))


def _fuzzy_span(path: Column, query: str) -> Column:
    """The leftmost text that holds the query's letters in order; '' if there is none.

    From the first letter's first place on, each letter is taken where it comes
    first. Nothing else needs to be tried, so the pattern never backtracks.
    """
    letters = [quote(c) for c in query]
    ordered = letters[0] + "".join(f"[^{c}]*+{c}" for c in letters[1:])
    return F.regexp_extract(path, rf"(?iu)\A[^{letters[0]}]*+({ordered})", 1)


def _with_rank_columns(hits: DataFrame, path: str) -> DataFrame:
    return hits.withColumns(
        {
            "span": F.length("_found").cast("bigint"),
            "start": (F.instr(F.col(path), F.col("_found")) - 1).cast("bigint"),
        }
    ).drop("_found")


def _fuzzy_order(path: str) -> list[Column]:
    return [F.col("span"), F.col("start"), F.length(path), F.col(path)]


def search_fuzzy(df: DataFrame, query: str, k: int, path: str = "path") -> DataFrame:
    """Top-``k`` files whose path holds the query's letters in order, any case.

    Best first: shortest leftmost span, earliest start, shortest path, path. Adds
    ``span`` and ``start``. The order and limit become one top-k per task, so only
    k rows per task travel. An empty query keeps every file, whatever k is.
    """
    if query == "":
        return df.withColumns({"span": F.lit(0).cast("bigint"), "start": F.lit(0).cast("bigint")})
    found = _fuzzy_span(F.col(path), query)
    hits = df.where(found != "").withColumn("_found", found)
    return _with_rank_columns(hits, path).orderBy(*_fuzzy_order(path)).limit(k)


def search_fuzzy_many(df: DataFrame, queries: Sequence[str], k: int, path: str = "path") -> DataFrame:
    """Top-``k`` paths of each query, with ``rank``, in one pass over the paths.

    The queries are part of the expression, each compiled once, so no join is
    needed, and a path becomes rows only for the queries it matches. A query that
    matches a third of all paths does not flood one task: its paths are cut to k in
    rounds of ever fewer parts, so no task holds more than 64 times k of them. Every
    path matches the empty query; without queries there are no rows.
    """
    found = [
        F.struct(
            F.lit(q).alias("query"),
            (_fuzzy_span(F.col(path), q) if q else F.lit("")).alias("found"),
            F.lit(q == "").alias("every"),
        )
        for q in dict.fromkeys(queries)
    ]
    kind = "array<struct<query: string, found: string, every: boolean>>"
    spans = F.array(*found).cast(kind)
    matched = F.filter(spans, lambda hit: hit["every"] | (hit["found"] != ""))
    hits = df.select(path, F.explode(matched).alias("_hit"))
    hits = hits.select(path, "_hit.query", F.col("_hit.found").alias("_found"))
    hits = _with_rank_columns(hits, path)
    hits = hits.withColumn("start", F.greatest("start", F.lit(0)))
    for parts in _TOP_K_PARTS:
        # The salts are powers of two, so a part is made of whole parts of the round before.
        salt = F.pmod(F.xxhash64(path), F.lit(parts))
        within = Window.partitionBy("query", salt).orderBy(*_fuzzy_order(path))
        hits = hits.withColumn("rank", F.row_number().over(within)).where(F.col("rank") <= k)
    return hits


def _alignment_score(path: Column, query: str) -> Column:
    """The best score of any way to find the query's letters in order in the path.

    A letter gains by standing at the start, after a separator, at a capital after a small
    letter, or next to the letter before; characters before the first letter cost, up to a
    limit, and every character without a letter costs a little. One fold over the path's
    characters keeps, for each letter of the query, the best score with the letter at the
    last place seen and with the letter anywhere before it.
    """
    letters = list(lower_query(query))
    none = F.lit(-(1 << 40)).cast("bigint")
    shown = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
    lowered = F.regexp_extract_all(lower_letters(path), F.lit("(?s)."), F.lit(0))
    before = F.concat(F.array(F.lit("")), shown)

    def place(char: Column, at: Column) -> Column:
        last = F.get(before, at)
        gain = F.when(at == 0, constants.ALIGN_START).otherwise(0)
        gain += F.when((last != "") & F.lit(constants.ALIGN_SEPARATORS).contains(last), constants.ALIGN_AFTER_SEPARATOR).otherwise(0)
        gain += F.when(F.concat(last, F.get(shown, at)).rlike(r"\A\p{Ll}\p{Lu}"), constants.ALIGN_CAMEL_CASE).otherwise(0)
        lead = F.least(at * F.lit(constants.ALIGN_LEADING_GAP), F.lit(constants.ALIGN_MOST_LEADING_GAP))
        return F.struct(char.alias("char"), gain.cast("bigint").alias("gain"), lead.cast("bigint").alias("lead"))

    def step(best: Column, at: Column) -> Column:
        fields = []
        for i, letter in enumerate(letters):
            if i == 0:
                so_far = -at["lead"]
            else:
                so_far = F.greatest(best[f"here{i - 1}"] + constants.ALIGN_ADJACENT, best[f"any{i - 1}"])
            here = F.when(at["char"] == letter, so_far + at["gain"]).otherwise(none)
            fields += [here.alias(f"here{i}"), F.greatest(best[f"any{i}"], here).alias(f"any{i}")]
        return F.struct(*fields)

    start = F.struct(*[none.alias(f"{kind}{i}") for i in range(len(letters)) for kind in ("here", "any")])
    found = F.aggregate(F.transform(lowered, place), start, step, lambda best: best[f"any{len(letters) - 1}"])
    return found - (F.length(path) - len(letters)).cast("bigint") * constants.ALIGN_UNMATCHED


def search_aligned(df: DataFrame, query: str, k: int, path: str = "path") -> DataFrame:
    """Top-``k`` files whose path holds the query's letters in order, by how well they lie in it.

    Best first: ``score``, shortest path, path. Only paths that match are scored, and as in
    ``search_fuzzy`` only k rows per task travel. An empty query keeps every file, with
    score 0, whatever k is.
    """
    if query == "":
        return df.withColumn("score", F.lit(0).cast("bigint"))
    hits = df.where(_fuzzy_span(F.col(path), query) != "")
    scored = hits.withColumn("score", _alignment_score(F.col(path), query))
    return scored.orderBy(F.desc("score"), F.length(path), path).limit(k)


def grep_lines(df: DataFrame, query: str, key: str = "path", content: str = "content") -> DataFrame:
    """One row per line that contains ``query`` in any case, with its 0-based number.

    Documents without the query are dropped before their lines are exploded.
    """
    text = as_text(F.col(content))
    docs = df.where(F.lit(query != "" and "\n" not in query) & _contains(text, query))
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return lines.where(_contains(F.col("line"), query))


def match_stats(df: DataFrame, query: str, key: str = "path", content: str = "content") -> DataFrame:
    """Lines, matching lines and first matching line (0-based) of each document.

    Counted on the text itself: a match takes the rest of its line along, so
    counting matches counts lines, and nothing is exploded or grouped.
    """
    text = as_text(F.col(content))
    lowered = lower_letters(text)
    if query == "" or "\n" in query:
        matches, first = F.lit(0), F.lit(None)
    else:
        needle = lower_query(query)
        matches = F.regexp_count(lowered, F.lit(quote(needle) + r"[^\n]*+"))
        first = F.when(
            lowered.contains(needle), newline_count(F.substring_index(lowered, needle, 1))
        )
    return df.select(
        key,
        line_count(F.col(content)).alias("line_count"),
        matches.cast("bigint").alias("match_count"),
        first.cast("bigint").alias("first_match"),
    )


def preview(
    df: DataFrame,
    query: str = "",
    key: str = "path",
    content: str = "content",
    max_lines: int = PREVIEW_LINES,
    context: int = PREVIEW_CONTEXT,
) -> DataFrame:
    """The lines a preview shows of each text file.

    Looks at the first ``max_lines`` complete lines (a last line without line feed is
    left out) and starts ``context`` lines before the first match.
    """
    if "is_binary" in df.columns:
        df = df.where(~F.col("is_binary"))
    text = as_text(F.col(content))
    # The split stops after max_lines, so the rest of a long file is not cut up.
    pieces = F.split(text, "\n", max_lines + 1)
    shown = df.select(key, F.slice(pieces, 1, F.size(pieces) - 1).alias("_lines"))
    if query == "" or "\n" in query:
        current = F.lit(0)
        matched = F.lit(False)
    else:
        head = lower_letters(F.array_join("_lines", "\n"))
        needle = lower_query(query)
        before = newline_count(F.substring_index(head, needle, 1))
        current = F.when(head.contains(needle), before).otherwise(0)
        matched = _contains(F.col("line"), query)
    # The outer form keeps Spark from testing the size of the lines before the split.
    lines = shown.withColumn("_current", current.cast("bigint")).select(
        key, "_current", F.posexplode_outer("_lines").alias("_pos", "line")
    )
    return lines.where(F.col("_pos") >= F.col("_current") - context).select(
        key,
        (F.col("_pos") + 1).cast("bigint").alias("line_no"),
        "line",
        (F.col("_pos") == F.col("_current")).alias("is_current"),
        matched.alias("is_match"),
    )


def search_and_preview(
    df: DataFrame,
    query: str,
    k: int,
    line_query: str = "",
    path: str = "path",
    content: str = "content",
) -> DataFrame:
    """The preview rows of the ``k`` best paths for ``query``, with ``rank`` from 1 on.

    Paths are ranked without their contents, and only the files found are looked into.
    """
    best = search_fuzzy(df.select(path), query, k, path)
    rank = F.row_number().over(Window.orderBy(*_fuzzy_order(path)))  # over k rows
    best = best.orderBy(*_fuzzy_order(path)).limit(k).select(path, rank.alias("rank"))
    shown = preview(df.join(best.select(path), path, "left_semi"), line_query, path, content)
    return shown.join(best, path)
