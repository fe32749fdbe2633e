"""Line dedup by winnowing over line hashes.

Of every window of ``min_lines`` lines the line with the smallest hash is selected, the last
one of equals, and a document's selected positions are its fingerprints, about two for every
``min_lines + 1`` lines. Two equal windows select the same line of theirs, so a run of
``min_lines`` lines that two places share is found by a fingerprint that both have. Positions
whose fingerprint no other position of the corpus has are dropped; the others are joined to
the first occurrence of the windows that selected them, which verifies the match, and
matches on one diagonal, next to each other, are put together to maximal runs. Runs after
the first occurrence are deleted. A line of ``long_words`` words or more is always selected
and is a run by itself.

Defined results: lines end at ``\\n``; equal lines are equal bytes. Occurrences are
ordered by doc_id, null last, then, where rows share a doc_id, by a hash of the text,
then by place in the document; an occurrence may overlap the first one. Rows with equal
doc_id and text are one document and get the same result. A null text is the empty text and keeps its one empty line. Lines are hashed to
128 bits. Columns other than doc_id and text are returned unchanged. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, join_by_key, text_of, written

MIN_LINES = 3
LONG_WORDS = 25
BITS_PER_KEY = 16
MOST_BITS = 1 << 28
_WORD = r"[^\x20\x09-\x0D]+"


def _selected(min_lines: int, long_words: int) -> Column:
    """place, mark and windows of a document's selected positions.

    ``windows`` has the start, length and digest of the runs that the position stands for:
    the windows that selected it, which all hold it, and the line itself if it is long.
    """
    lines, count = F.col("lines"), F.size("lines")
    none = F.array().cast("array<struct<start:int,place:int>>")

    def window(i: Column) -> Column:
        least = F.array_min(
            F.transform(
                F.sequence(i, i + (min_lines - 1)),
                lambda j: F.struct(F.get("hashes", j).alias("hash"), (-j).alias("back")),
            )
        )
        return F.struct(i.alias("start"), (-least["back"]).alias("place"))

    several = F.when(count >= min_lines, F.transform(F.sequence(F.lit(0), count - min_lines), window)).otherwise(none)
    long = F.filter(
        F.transform(lines, lambda x, i: F.when(F.regexp_count(x, F.lit(_WORD)) >= long_words, i)), lambda i: i.isNotNull()
    )

    def position(windows: Column, place: Column) -> Column:
        # Only windows that start up to min_lines - 1 lines before can have selected it.
        starts = F.filter(
            F.transform(F.sequence(place - (min_lines - 1), place), lambda i: F.when(i >= 0, F.get(windows, i))),
            lambda w: w["place"] == place,
        )
        found = F.transform(
            starts,
            lambda w: F.struct(
                w["start"].alias("start"),
                F.lit(min_lines).alias("length"),
                F.md5(F.array_join(F.slice("digests", w["start"] + 1, min_lines), "").cast("binary")).alias("window"),
            ),
        )
        alone = F.struct(place.alias("start"), F.lit(1).alias("length"), F.get("digests", place).alias("window"))
        is_long = F.regexp_count(F.get(lines, place), F.lit(_WORD)) >= long_words
        return F.struct(
            place.alias("place"),
            F.get("hashes", place).alias("mark"),
            F.when(is_long, F.concat(found, F.array(alone))).otherwise(found).alias("windows"),
        )

    def positions(windows: Column) -> Column:
        places = F.array_union(F.transform(windows, lambda w: w["place"]), long)
        return F.transform(places, lambda place: position(windows, place))

    # As a lambda variable the windows are worked out once.
    return F.flatten(F.transform(F.array(several), positions))


def fingerprints(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, doc_key, place, mark and windows: a row for every selected position."""
    lines = F.split(text_of(docs), "\n")
    base = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"), document_key(docs).alias("doc_key"), lines.alias("lines")
    )
    base = base.withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    base = base.withColumn("digests", F.transform("lines", lambda x: F.md5(x.cast("binary"))))
    return base.select("doc_id", "doc_key", F.inline(_selected(min_lines, long_words)))


def repeated_runs(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, doc_key, start, length and first_id, first_key, first_start of each later run."""
    chosen = written(fingerprints(docs, min_lines, long_words), "line-fingerprints")
    total = chosen.count()
    marks = chosen.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Beyond the hot keys, tables of any size meet in the same way, so that what is moved
    # grows with the corpus from the start.
    near = join_by_key(chosen, written(marks, "line-marks").hint("merge"), "mark", total).drop("n")
    near = written(near.select("doc_id", "doc_key", F.inline("windows")), "line-matches")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "doc_key", "start")
    first = near.groupBy("window").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    first = written(first.where("n > 1"), "line-firsts").hint("merge")
    later = join_by_key(near, first, "window", near.count())
    same = (F.col("doc_key") == F.col("first.doc_key")) & F.col("doc_id").eqNullSafe(F.col("first.doc_id"))
    later = later.where(~(same & (F.col("start") == F.col("first.start")))).select(
        "doc_id", "doc_key", "start", (F.col("start") + F.col("length")).alias("end"),
        F.col("first.doc_id").alias("first_id"), F.col("first.doc_key").alias("first_key"),
        (F.col("start") - F.col("first.start")).alias("diagonal"),
    )
    # A match extends the run before it on its diagonal if it touches it.
    diagonal = ["doc_id", "doc_key", "first_id", "first_key", "diagonal"]
    along = Window.partitionBy(*diagonal).orderBy("start", "end")
    reach = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    begun = later.withColumn("begins", (F.col("start") > F.coalesce(reach, F.lit(-1))).cast("int"))
    runs = begun.withColumn("run", F.sum("begins").over(along)).groupBy(*diagonal, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end")
    )
    return runs.select(
        "doc_id", "doc_key", "start", (F.col("end") - F.col("start")).alias("length"),
        "first_id", "first_key", (F.col("start") - F.col("diagonal")).alias("first_start"),
    )


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """doc_id, doc_key, deleted: the places of the lines to delete, per document that has any."""
    runs = repeated_runs(docs, min_lines, long_words)
    places = F.explode(F.sequence("start", F.col("start") + F.col("length") - 1)).alias("place")
    return runs.select("doc_id", "doc_key", places).groupBy("doc_id", "doc_key").agg(F.collect_set("place").alias("deleted"))


def document_key(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"], text_of(docs))


def _marked(docs: DataFrame, key: str, mark: str, gone: DataFrame) -> DataFrame:
    """Documents with whether they may be among those of ``gone``, by a bitmap of the keys.

    All that are among them are marked, and of the others about one in ``BITS_PER_KEY``. The
    bitmap has at most ``MOST_BITS`` bits, 32 MB, whatever the corpus, so it is broadcast;
    beyond that more and more others are marked, which only moves them.
    """
    bits = min(MOST_BITS, max(1 << 15, BITS_PER_KEY * gone.count()))
    number = lambda column: F.pmod(column, F.lit(bits)) + 1
    bucket, bitmap = fresh(docs.columns, stem="bucket"), fresh(docs.columns, stem="bitmap")
    keys = gone.select(number(F.col("doc_key")).alias("number"))
    bitmaps = keys.groupBy(F.bitmap_bucket_number("number").alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias(bitmap)
    )
    placed = docs.withColumn(bucket, F.bitmap_bucket_number(number(F.col(key))))
    joined = placed.join(F.broadcast(bitmaps), bucket, "left")
    place = F.bitmap_bit_position(number(F.col(key)))
    byte = F.conv(F.hex(F.substring(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = F.floor(byte / F.pow(F.lit(2), place % 8)) % 2 == 1
    return joined.withColumn(mark, F.coalesce(found, F.lit(False))).drop(bucket, bitmap)


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, long_words: int = LONG_WORDS) -> DataFrame:
    """Documents with text without its repeated lines, and n_lines and n_deleted.

    Documents without lines to delete, but for a few, are not moved.
    """
    if min_lines < 1 or long_words < 1:
        raise ValueError("min_lines and long_words must be 1 or more")
    gone = written(repeated_lines(docs, min_lines, long_words), "line-deletions")
    key, mark = fresh(docs.columns, stem="key"), fresh(docs.columns, stem="mark")
    deleted = fresh(docs.columns, stem="deleted")
    marked = _marked(docs.withColumn(key, document_key(docs)), key, mark, gone)
    own_id, own_key = fresh(docs.columns, stem="own_id"), fresh(docs.columns, stem="own_key")
    named = gone.select(F.col("doc_id").alias(own_id), F.col("doc_key").alias(own_key), F.col("deleted").alias(deleted))
    # The id is part of the key, so a hash of the text tells only rows of one id apart.
    same = (F.col(key) == F.col(own_key)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(own_id))
    joined = marked.where(mark).join(named.hint("merge"), same, "left").select(*docs.columns, deleted)
    none = F.lit(None).cast("array<int>").alias(deleted)
    rows = marked.where(~F.col(mark)).select(*docs.columns, none).unionByName(joined)

    lines = F.split(text_of(rows), "\n")
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    left = F.array_except(every, F.coalesce(rows[deleted], F.array().cast("array<int>")))
    text = F.when(rows[deleted].isNull(), text_of(rows)).otherwise(
        F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    )
    counted = {"n_lines": F.size(lines).cast("bigint"), "n_deleted": F.coalesce(F.size(rows[deleted]), F.lit(0)).cast("bigint")}
    kept = [text.alias("text") if c == "text" else rows[c] for c in docs.columns if c not in counted]
    return rows.select(*kept, *[value.alias(name) for name, value in counted.items()])


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document: its lines, how many go, and what is left as length and digest."""
    rows = dedup_lines(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select(
        "doc_id",
        "n_lines",
        "n_deleted",
        F.octet_length("text").cast("bigint").alias("clean_bytes"),
        F.md5(F.col("text").cast("binary")).alias("clean_md5"),
    )


OP6_SQL = r"""
WITH cut AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS place FROM cut
), windows AS (
  SELECT doc_id, place AS start, 3 AS length,
         lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, line AS l0
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY place)
), runs AS (
  SELECT doc_id, start, length, md5(l0) || md5(l1) || md5(l2) AS what FROM windows WHERE l2 IS NOT NULL
  UNION ALL
  SELECT doc_id, place, 1, md5(line) FROM lines
  WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 25
), later AS (
  SELECT doc_id, start, length FROM (
    SELECT *, row_number() OVER (PARTITION BY what ORDER BY doc_id, start) AS n FROM runs
  ) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(start, start + length)) AS place FROM later
)
SELECT l.doc_id,
       count(*) AS n_lines,
       count(g.place) AS n_deleted,
       CAST(octet_length(encode(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), ''))) AS BIGINT) AS clean_bytes,
       md5(coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (g.place IS NULL), '')) AS clean_md5
FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.place = l.place
GROUP BY l.doc_id
"""
