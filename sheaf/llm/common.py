"""What the operators share: written tables, common keys, ranks, rows to keep."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheaf.session import new_folder

HOT_SHARE = 0.001
"""A key with more than this share of all rows is hot, so there are under 1,000."""


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows, written as a table in the shared folder and read again.

    This cuts the lineage: nothing above is computed twice, and executors that are
    lost later lose nothing. What the write shuffled is deleted as soon as it ends; else
    it would stay until the driver happens to collect its garbage.
    """
    return _write(df, new_folder(df.sparkSession, name))


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``written`` for the length of a ``with``; its files are deleted at the end.

    Nothing lazy may read the table afterwards, so what is made of it has to be written.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, name)
    try:
        yield _write(df, path)
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(*taken: Sequence[str], stem: str = "tmp") -> str:
    """A column name no frame has yet."""
    used = {c.lower() for columns in taken for c in columns}
    name = f"__{stem}"
    while name in used:
        name = f"__{stem}_{uuid.uuid4().hex[:8]}"
    return name


def text_of(docs: DataFrame) -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(docs["text"], F.lit(""))


def hot_keys(counts: DataFrame, total: int, n: str = "n") -> DataFrame:
    """The rows of ``counts`` whose key has over ``HOT_SHARE`` of ``total`` rows.

    At most ``1 / HOT_SHARE`` rows, whatever the input, so the result may be broadcast.
    """
    return counts.where(F.col(n) > F.lit(max(1.0, HOT_SHARE * total)))


def join_by_key(facts: DataFrame, table: DataFrame, key: str, total: int, n: str = "n", merge: bool = False) -> DataFrame:
    """Join facts with one row per key, where one key may have a third of all facts.

    The bounded list of hot keys is broadcast, so their facts stay where they are; all
    other keys meet in a sort-merge join. ``table`` has the number of a key's facts in
    ``n`` and should be a written table, because it is read twice.
    With ``merge`` Spark broadcasts no small table either, so that every size moves alike.
    """
    hot = hot_keys(table, total, n)
    rest = table.where(F.col(n) <= F.lit(max(1.0, HOT_SHARE * total)))
    if merge:
        rest = rest.hint("merge")
    hot_facts = facts.join(F.broadcast(hot), key)
    cold = facts.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key)
    return hot_facts.unionByName(cold)


def ranked(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Rows with ``rank``, their 0-based place within their group; no task holds a group.

    Rows are range-partitioned by group and order and written with the number of their
    partition. A partition's rows of a group are ranked on their own, and the counts of
    the partitions before it, a row per partition and group, give the start. ``order``
    should end in something that differs between rows.
    """
    part = "__part"
    spread = rows.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id())
    placed = written(spread, name)
    counts = placed.groupBy(*groups, part).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *groups, part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    own = Window.partitionBy(*groups, part).orderBy(*order)
    local = placed.withColumn("__row", F.row_number().over(own).cast("bigint"))
    same = [local[c].eqNullSafe(starts[c]) for c in (*groups, part)]
    on = same[0]
    for condition in same[1:]:
        on = on & condition
    return local.join(starts, on).select(
        *[local[c] for c in rows.columns], (F.col("__start") + F.col("__row") - 1).alias("rank")
    )


def kept_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """Documents whose doc_id and text hash are among the rows of ``keep``, whole.

    ``keep`` has ``doc_id`` and ``text_hash``, of ``text_hash(docs)``. A semi join, so
    rows that repeat stay repeated.
    """
    name = fresh(docs.columns, stem="hash")
    marked = docs.withColumn(name, text_hash(docs))
    on = marked["doc_id"].eqNullSafe(keep["doc_id"]) & (marked[name] == keep["text_hash"])
    return marked.join(keep, on, "left_semi").drop(name)


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(text_of(docs))


def text_batches(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of buffers each, one row at least."""
    rows = batch.num_rows
    if not rows:
        return
    step = max(1, int(rows * most / max(batch.nbytes, 1)))
    for start in range(0, rows, step):
        yield batch.slice(start, step)


def total_rows(df: DataFrame) -> int:
    return df.count()


def literal_rows(spark: SparkSession, rows: Sequence[Sequence], schema: str) -> DataFrame:
    """A small table of literals, as one expression: no Python runs for it."""
    names = [field.split()[0] for field in schema.split(",")]
    kinds = [field.split()[1] for field in schema.split(",")]
    one = spark.range(1)
    if not rows:
        return one.limit(0).select(
            *[F.lit(None).cast(kind).alias(name) for name, kind in zip(names, kinds)]
        )
    structs = [
        F.struct(*[F.lit(v).cast(kind).alias(name) for name, kind, v in zip(names, kinds, row)])
        for row in rows
    ]
    return one.select(F.inline(F.array(*structs)))
