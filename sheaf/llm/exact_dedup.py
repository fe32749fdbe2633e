"""Exact dedup by a persistent digest index.

The index is a bucketed table sorted by SHA-256 digest, one row per text. New rows are
hashed, reduced to one row per digest before the shuffle, held against the index by a
sort-merge anti-join in which the index is neither shuffled nor read beyond its
columns, and what is new is appended with the batch's name. Only digests move; texts are
read once.

A batch that runs again, because its job died after the append or was started twice, finds
its own digests under its own name and gets the decisions of the first run. Unless it is
given, the name is a hash of the batch's doc_ids and digests. An index is opened with the
number of buckets it was made with, or not at all.

Defined results: a null text is the empty text; texts are equal when their UTF-8 bytes
are. Of equal texts the row with the largest doc_id stays, null being the smallest, and
of rows with the same doc_id too one stays, whichever. A text the index already has
stays with the row it was indexed with, so all its new rows go. Columns other than
doc_id and text play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, join_by_key, text_of, written
from sheaf.session import new_folder

BUCKETS = 64


@dataclass(frozen=True)
class DigestIndex:
    """Digests seen so far, with the row that stays and the number of rows."""

    spark: SparkSession
    path: str
    table: str
    buckets: int = BUCKETS

    @staticmethod
    def _buckets_of(spark: SparkSession, path: str) -> int | None:
        """The number kept beside the files of an index; None if there is none."""
        try:
            return spark.read.schema("buckets int").parquet(f"{path}-buckets").first()["buckets"]
        except AnalysisException:
            return None

    @classmethod
    def open(cls, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS) -> DigestIndex:
        """The index at ``path``, made empty if there is none; a new one without path.

        The files are the index: a later session that names the same path and number of
        buckets goes on with them. The catalog entry only tells Spark how they lie.
        """
        if path:
            made_with = cls._buckets_of(spark, path)
            if made_with is None:
                spark.range(1).select(F.lit(buckets).alias("buckets")).write.parquet(f"{path}-buckets")
            elif made_with != buckets:
                raise ValueError(f"the index at {path} has {made_with} buckets, not {buckets}")
        path = path or new_folder(spark, "digests")
        table = "digests_" + re.sub(r"\W", "_", uuid.uuid5(uuid.NAMESPACE_URL, path).hex)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (digest STRING, keep_id BIGINT, group_size BIGINT, batch BIGINT)"
            f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS"
            f" LOCATION '{path}'"
        )
        return cls(spark, path, table, buckets)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def append(self, groups: DataFrame, batch: int) -> None:
        """Add a batch's groups, whose digests the index does not have yet."""
        rows = groups.select("digest", "keep_id", "group_size", F.lit(batch).cast("bigint").alias("batch"))
        spread = rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
        spread.write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)


def _named(rows: DataFrame) -> tuple[int, int]:
    """How many rows, and a name of the batch, whatever the order of its rows."""
    # Parts of 22 bits, whose sums hold for a trillion rows.
    one = F.xxhash64("doc_id", "digest")
    parts = [F.shiftright(one, by).bitwiseAND(F.lit((1 << 22) - 1)) for by in (0, 22, 42)]
    sums = [F.coalesce(F.sum(part), F.lit(0)) for part in parts]
    count = F.count(F.lit(1))
    return tuple(rows.agg(count, F.xxhash64(*sums, count)).first())


def _decided(docs: DataFrame, index: DigestIndex, batch: int | None) -> DataFrame:
    """One row per document: doc_id, digest, row (a number of its own), and the decision."""
    rows = docs.select(
        docs["doc_id"].cast("bigint").alias("doc_id"),
        F.sha2(text_of(docs).cast("binary"), 256).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "digest-rows")
    total, name = _named(rows)
    batch = name if batch is None else batch
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "row", "doc_id"))
    groups = rows.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
    groups = groups.select(
        "digest", "n", F.col("best.doc_id").alias("best_id"), F.col("best.row").alias("best_row")
    )
    known = index.rows().hint("merge")
    fresh_groups = groups.hint("merge").join(known.select("digest"), "digest", "left_anti")
    fresh_groups = written(fresh_groups, "digest-groups")
    # What this batch itself brought in is decided as it was then.
    own = F.col("batch").eqNullSafe(F.lit(batch))
    seen = groups.hint("merge").join(known, "digest").select(
        "digest", "n", "keep_id", "group_size", F.when(own, F.col("best_row")).alias("keep_row")
    )
    new = fresh_groups.select(
        "digest", "n", F.col("best_id").alias("keep_id"), F.col("n").alias("group_size"),
        F.col("best_row").alias("keep_row"),
    )
    table = written(new.unionByName(seen), "digest-decisions")
    index.append(new, batch)

    return join_by_key(rows, table, "digest", total).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def dedup(docs: DataFrame, index: DigestIndex | None = None, batch: int | None = None) -> DataFrame:
    """A decision per row: doc_id, keep_id, group_size, kept, text_sha256.

    ``docs`` needs ``doc_id`` and ``text``. Without an index the rows are held against
    each other only; with one, new texts are added to it. ``group_size`` counts the
    rows of the batch that brought the text in. Rows given again under the ``batch`` they
    had, or the same rows without one, get the same decisions.
    """
    return _decided(docs, index or DigestIndex.open(docs.sparkSession), batch)


def keep_first(docs: DataFrame, index: DigestIndex | None = None, batch: int | None = None) -> DataFrame:
    """The rows that stay, with all their columns.

    A semi join on digest and doc_id. Where rows share both, which makes them equal in
    what counts, the one with the largest hash of all columns stays.
    """
    decided = dedup(docs, index, batch)
    digest, place = fresh(docs.columns, stem="digest"), fresh(docs.columns, stem="place")
    kept = decided.where("kept").select(
        F.col("doc_id").alias("__kept_id"), F.col("text_sha256").alias("__kept_digest")
    )
    times = decided.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"))
    kept = written(
        kept.join(
            times,
            F.col("__kept_id").eqNullSafe(times["doc_id"]) & (F.col("__kept_digest") == times["text_sha256"]),
        ).select("__kept_id", "__kept_digest", (F.col("n") > 1).alias("__tied")),
        "kept-digests",
    )
    marked = docs.withColumn(digest, F.sha2(text_of(docs).cast("binary"), 256))

    def those(tied: bool) -> DataFrame:
        rows = kept.where(F.col("__tied") == F.lit(tied))
        on = marked["doc_id"].eqNullSafe(rows["__kept_id"]) & (marked[digest] == rows["__kept_digest"])
        return marked.join(rows, on, "left_semi")

    every = F.struct(*[docs[c] for c in docs.columns])
    tied = those(True)
    one = tied.groupBy("doc_id", digest).agg(F.max_by(every, F.xxhash64(every)).alias(place))
    return those(False).select(*docs.columns).unionByName(one.select(f"{place}.*"))


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row that stays for its text."""
    return dedup(spark.read.parquet(f"{folder}/documents.parquet"))


OP5_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
