"""Mixing sources to target weights by systematic sampling.

A source's target is shared out by weight and stops at ``most`` times its size; what is
over goes to the others by weight until none is above. Every document of a source then
expects target / size copies. Prefix sums of the expected copies run through the
source in order of size, one offset per source is added, and a document is taken once
for each whole number its interval crosses. Ordered by size, the words taken stay
within about one document of the target. Prefix sums come from ranks that no single
task has to count (``ranked``), so a source may have any share of the rows.

Defined results: a document's size is its number of words, 0 for null. Sources are
ordered by code point, null last, and weigh ``weights`` in turn. A source without words
has target 0 and gives nothing. Documents without words are taken like others of their
source and count 0. Repeated rows are documents of their own. The offset is a hash of
the source and the seed, and ties in size are ordered by a hash of doc_id, so reruns
agree. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm.common import fresh, join_by_key, ranked, text_hash, text_of, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
_WORD = r"[^\x20\x09-\x0D]+"
_STEPS = 1 << 20


def _sized(docs: DataFrame) -> DataFrame:
    """source_key sorts as the sources do, null last."""
    source = docs["source"].cast("string")
    return docs.select(
        docs["doc_id"].alias("doc_id"),
        F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source)).alias("source_key"),
        F.regexp_count(text_of(docs), F.lit(_WORD)).cast("bigint").alias("size"),
        F.xxhash64(docs["doc_id"], F.lit("order")).alias("tie"),
        text_hash(docs).alias("text_hash"),
    )


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source_key, source_size, n and target of each source, from a row per source.

    The level is the words per unit of weight. Every round of sharing is one aggregate
    over the sources and leaves fewer sources below their cap, until none is above it.
    """
    if share < 0 or share > most or min(weights) <= 0:
        raise ValueError("weights must be positive and share between 0 and most")
    places = ranked(sizes.withColumn("all", F.lit(0)), ["all"], ["source_key"], "sources")
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")
    )
    rows = written(places.select("source_key", "source_size", "n", weight.alias("weight")), "source-weights")
    cap = F.col("source_size") * float(most)
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, settled = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") >= cap
        told = rows.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("full"),
        ).first()
        if told["full"] == settled or not told["open"]:
            break
        settled = told["full"]
        level = max(level, (share * total - told["held"]) / told["open"])
    return rows.select(
        "source_key", "source_size", "n", F.least(cap, F.lit(level) * F.col("weight")).alias("target")
    )


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = 0,
) -> DataFrame:
    """doc_id, text_hash, size, source_size, target, copies, taken of every document."""
    sized = written(_sized(docs), "sizes")
    sources = sized.groupBy("source_key").agg(
        F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")
    )
    plan = written(targets(written(sources, "source-sizes"), weights, share, most), "targets")
    placed = ranked(sized, ["source_key"], ["size", "tie", "doc_id"], "ranks")
    rows = join_by_key(placed, plan, "source_key", sized.count())
    # The offset has few binary digits, so whole rates add up without rounding.
    offset = F.pmod(F.xxhash64("source_key", F.lit(seed)), F.lit(_STEPS)) / F.lit(float(_STEPS))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("rate", rate).withColumn("offset", offset)
    before = F.floor(F.col("offset") + F.col("rank") * F.col("rate"))
    after = F.floor(F.col("offset") + (F.col("rank") + 1) * F.col("rate"))
    copies = F.least(after - before, F.lit(most)).cast("bigint")
    return rows.select(
        "doc_id", "text_hash", "size", "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all columns.

    Rows with equal doc_id and text are taken together: one of them, the one with the
    largest hash of its columns, comes as often as all of them were.
    """
    taken = mix(docs, **options).groupBy("doc_id", "text_hash").agg(
        F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")
    )
    taken = written(taken.where("copies > 0"), "taken")
    mark, place = fresh(docs.columns, stem="hash"), fresh(docs.columns, stem="place")
    times, alike = fresh(docs.columns, stem="times"), fresh(docs.columns, stem="alike")
    taken = taken.select(
        F.col("doc_id").alias("__taken_id"), F.col("text_hash").alias("__taken_hash"),
        F.col("copies").alias(times), F.col("n").alias(alike),
    )
    marked = docs.withColumn(mark, text_hash(docs))
    on = marked["doc_id"].eqNullSafe(taken["__taken_id"]) & (marked[mark] == taken["__taken_hash"])
    rows = marked.join(taken, on)
    every = F.struct(*[docs[c] for c in docs.columns])
    tied = rows.where(F.col(alike) > 1).groupBy("doc_id", mark).agg(
        F.max_by(every, F.xxhash64(every)).alias(place), F.max(times).alias(times)
    )
    once = rows.where(F.col(alike) == 1).select(every.alias(place), times)
    both = once.unionByName(tied.select(place, times))
    copies = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))
    return both.select(place, copies.alias(times)).select(f"{place}.*")


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its source's target and what the mix takes of it."""
    rows = mix(spark.read.parquet(f"{folder}/documents.parquet"))
    return rows.select("doc_id", "size", "source_size", "target", "taken")
