"""Mixing against a sequential model, shards read back, and the whole pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from sheaf.llm import mixing
from sheaf.llm.common import written
from sheaf.llm.tokens import default_vocabulary, encoder
from sheaf.llm.training_order import Permutation, materialise
from tests.llm.cases import documents, odd_documents
from tests.llm.test_pairs import brute_components

FOLDER = "/root/testdata/sf0.01"


def shares(sizes, weights=(5, 2, 1), share=1.5, most=2):
    """Targets by repeated sharing: what is over a cap goes to the others by weight."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weigh = {name: weights[i % len(weights)] for i, name in enumerate(names)}
    target, open_ = {}, set(names)
    left = share * sum(sizes.values())
    while open_:
        total = sum(weigh[n] for n in open_)
        over = {n for n in open_ if left * weigh[n] / total >= most * sizes[n]}
        if not over:
            return {**target, **{n: left * weigh[n] / total for n in open_}}
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]
        open_ -= over
    return target


def check_mix(rows, source_of):
    by_source = defaultdict(list)
    for r in rows:
        by_source[source_of[r.doc_id]].append(r)
    sizes = {s: sum(r.size for r in group) for s, group in by_source.items()}
    want = shares(sizes)
    for source, group in by_source.items():
        assert {r.source_size for r in group} == {sizes[source]}
        assert all(r.target == pytest.approx(want[source]) for r in group)
        taken = sum(r.taken for r in group)
        assert abs(taken - want[source]) <= max(r.size for r in group) + 1e-6
        assert all(r.taken in (0, r.size, 2 * r.size) for r in group)


def test_mix_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = mixing.op4_mixing(spark, FOLDER).collect()
    source_of = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    assert len(rows) == len(source_of)
    check_mix(rows, source_of)
    again = mixing.op4_mixing(spark, FOLDER).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_with_a_hot_source_and_small_ones(spark):
    rows = [(i, "w " * (i % 7 + 1), "", "hot" if i % 3 == 0 else f"s{i % 50}") for i in range(3000)]
    rows += [(9000, "", "", "empty"), (9001, None, "", "empty"), (9002, "a b", "", None)]
    out = mixing.mix(documents(spark, rows)).collect()
    check_mix(out, {r[0]: r[3] for r in rows})
    assert [r.target for r in out if r.doc_id == 9000] == [0.0]


def test_mix_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.taken <= 2 * r.size for r in rows)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert {(r.doc_id, r.text) for r in out.collect()} <= {(r.doc_id, r.text) for r in docs.collect()}
    per_key = mixing.mix(docs).groupBy("doc_id", "text_hash").agg(F.sum("copies").alias("n"))
    assert out.count() == per_key.agg(F.sum("n")).first()[0]
    assert mixing.mix(documents(spark, [])).count() == 0 and mixing.mixed(documents(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 1000, 4097])
def test_permutation_is_one_and_its_inverse(n):
    for key in (0, 7):
        order = Permutation(n, key)
        slots = order.slot(np.arange(n))
        assert sorted(slots) == list(range(n))
        assert (order.number(slots) == np.arange(n)).all()
    if n >= 64:
        assert (Permutation(n, 0).slot(np.arange(n)) != Permutation(n, 7).slot(np.arange(n))).any()


def check_shards(docs, shards, manifest):
    encode = encoder(default_vocabulary()[0])
    rows = manifest.collect()
    records = list(shards.read(0, shards.sequences))
    assert len(rows) == len(records) == shards.sequences
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    got = Counter()
    for r in rows:
        assert zlib.crc32(records[r.slot].tobytes()) == r.record_crc32
        assert not records[r.slot][r.n_ids :].any() and r.shard == r.slot // shards.per_shard
        got[(r.doc_id, r.place, tuple(records[r.slot][: r.n_ids].tolist()))] += 1
    want = Counter()
    for d in docs.collect():
        ids = [*encode(d.text or ""), 0]
        for k in range(0, len(ids), shards.length):
            want[(d.doc_id, k // shards.length, tuple(ids[k : k + shards.length]))] += 1
    assert got == want


def test_shards_hold_every_sequence(spark, tmp_path):
    docs = written(odd_documents(spark), "odd")
    shards, manifest = materialise(docs, str(tmp_path / "out"), key=3, length=50, per_shard=7)
    check_shards(docs, shards, manifest)
    # Reading on from the middle, over the end of a shard, gives the same records.
    every = [r.tobytes() for r in shards.read(0, shards.sequences)]
    assert [r.tobytes() for r in shards.read(5, 9)] == every[5:14]
    files = sorted(p.name for p in (tmp_path / "out").iterdir())
    assert files == [f"shard-{i:08d}.bin" for i in range(-(-shards.sequences // 7))]


def test_shards_of_nothing(spark, tmp_path):
    shards, manifest = materialise(documents(spark, []), str(tmp_path / "none"))
    assert shards.sequences == 0 and manifest.count() == 0 and list(shards.read(0, 5)) == []


def test_shards_are_the_same_again(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, two = (materialise(docs, str(tmp_path / x), per_shard=64)[0] for x in "ab")
    names = [p.name for p in (tmp_path / "a").iterdir()]
    assert names and all((tmp_path / "a" / n).read_bytes() == (tmp_path / "b" / n).read_bytes() for n in names)
    assert one.stride == two.stride == 1024


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "ngram_join", "mixing", "packing"]
    kept = written(stages["language_id"](spark, docs, FOLDER), "t1")
    assert kept.columns == docs.columns and kept.count() >= 0.995 * docs.count()
    once = written(stages["exact_dedup"](spark, kept, FOLDER), "t2")
    newest = kept.groupBy("text").agg(F.max("doc_id").alias("doc_id"))
    assert sorted(r.doc_id for r in once.select("doc_id").collect()) == sorted(r.doc_id for r in newest.collect())
    near = written(stages["ngram_join"](spark, once, FOLDER), "t3")
    want = brute_components([(r.doc_id, r.text) for r in once.select("doc_id", "text").limit(10**6).collect()], 5, 80)
    assert sorted(r.doc_id for r in near.select("doc_id").collect()) == sorted({root for _, root in want.values()})
    mix = written(stages["mixing"](spark, near, FOLDER), "t4")
    plan = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    assert Counter(r.doc_id for r in mix.select("doc_id").collect()) == Counter({k: n for k, n in plan.items() if n})
    packed = written(stages["packing"](spark, mix, FOLDER), "t5")
    assert packed.where("piece = 0").count() == mix.count()
    assert mix.columns == near.columns == once.columns == docs.columns


def test_pipeline_runs_on_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 0


def test_queries_are_registered():
    names = set(spark_entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names and "pipeline" not in spark_entry.oracle_sql()
    assert set(spark_entry.oracle_sql()) <= names
