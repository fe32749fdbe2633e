"""Language identification and toxicity: held-out accuracy, exactness, awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheaf.llm import language_id, toxicity
from tests.llm.cases import documents, odd_documents

FOLDER = "/root/testdata/sf0.01"


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", bytes(range(1, 256)) * 3, b"x" * 512]
    windows, owner, sizes = language_id.windows_of(texts)
    for i, text in enumerate(texts):
        assert windows[owner == i].tobytes().rstrip(b"\0") == text
        assert sizes[owner == i].sum() == len(text)


def test_language_of_held_out_documents(spark):
    rows = language_id.op3_language_id(spark, FOLDER).toPandas()
    truth = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").toPandas()
    both = rows.merge(truth, on="doc_id")
    assert len(both) == len(truth)
    assert (both.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_language_of_odd_rows(spark):
    examples = [("der die und nicht ist das ein", "de"), ("the and of to in that is", "en")] * 4
    net = language_id.train([t.encode() * 4 for t, _ in examples], [k for _, k in examples], rounds=60)
    docs = odd_documents(spark).withColumn("score", F.lit("old"))
    rows = language_id.identify(docs, net).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.lang_pred in ("de", "en", "und") and 0 <= r.score <= 1
    und = [r for r in rows if r.lang_pred == "und"]
    assert {r.doc_id for r in und} == {3, 4, 5, None} and all(r.score == 0 for r in und)
    assert sum(r.doc_id is None for r in und) == 1
    assert language_id.identify(documents(spark, []), net).count() == 0


def test_nothing_to_learn_a_language_from(spark):
    docs = documents(spark, [(1, "some text", None, "")])
    net = language_id.learned(docs, F.lit(True))
    assert net is None
    assert language_id.identify(docs, net).select("lang_pred", "score").collect() == [("und", 0.0)]


def test_sample_is_bounded_and_copies_count_once(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"),
        F.lit("en").alias("lang"),
    )
    taken = language_id.sample(docs, "lang", F.lit(True), per_language=100)
    assert 0 < len(taken) <= 100 * language_id.PIECES
    assert sum(t == b"the same text" for t, _ in taken) <= language_id.PIECES


@pytest.fixture(scope="module")
def examples():
    rng = np.random.default_rng(8)
    terms = [f"t{i}".encode() for i in range(40)]
    rows = [
        (i, int(rng.integers(0, 2)), 1.0, {int(t): int(rng.integers(1, 4)) for t in rng.choice(40, rng.integers(0, 6), replace=False)})
        for i in range(900)
    ]
    return terms, rng.uniform(0.5, 3, 40), rows


def test_neighbours_are_exact(examples):
    terms, idf, rows = examples
    index = toxicity.build(terms, idf, rows)
    dense = np.zeros((len(index.ids), len(terms)))
    by_id = {r[0]: r[3] for r in rows}
    for n, i in enumerate(index.ids):
        places, weights = index.vector(by_id[int(i)])
        dense[n, places] = weights
    for _, _, _, counts in rows[:200]:
        if not counts:
            continue
        places, weights = index.vector(counts)
        found, cosines = index.nearest(places, weights, 15)
        every = dense[:, places] @ weights
        want = np.sort(every[every > 0])[::-1][:15]
        assert np.allclose(cosines, want, atol=1e-5)
        assert np.allclose(every[found], cosines, atol=1e-5)


def test_bounds_save_work(examples):
    terms, idf, rows = examples
    index = toxicity.build(terms, idf, rows)
    places, weights = index.vector({0: 3})
    bounds = index.most[:, places] @ weights
    _, cosines = index.nearest(places, weights, 5)
    assert (bounds < cosines[-1]).any()


def test_toxicity_of_held_out_documents(spark):
    rows = toxicity.op9_toxicity(spark, FOLDER).toPandas()
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "toxic").toPandas()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id]).all()
    both = rows.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.toxic == held.predicted).mean() > 0.93
    assert held[held.toxic == 1].score.mean() > 5 * held[held.toxic == 0].score.mean()
    assert rows.score.between(0, 1).all() and (rows.predicted == (rows.score >= 0.5)).all()


def test_toxicity_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (6, 0), (99, 1)], "doc_id bigint, toxic int")
    index = toxicity.learned(docs, labels, F.lit(True))
    rows = toxicity.score(docs, index).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = toxicity.learned(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), none).count() == 0


def test_repeated_beginnings_are_counted():
    features = toxicity.Features([b"3^abcd", b"abcdx"])
    assert features.counts("abcdx abcdy ABCDZ!") == {0: 1, 1: 1}
    assert features.counts("abcdx abcdy") == {1: 1}
    assert b"2^abcd" in toxicity.all_terms("abcdx abcdy")


def test_texts_travel_once(spark):
    docs = documents(spark, [(1, None, "en", ""), (2, "", "en", "")])
    judged = language_id.identify(docs, None)
    assert sorted(map(tuple, judged.select("doc_id", "lang_pred", "score").collect())) == [(1, "und", 0.0), (2, "und", 0.0)]
    assert judged.where("text IS NULL").count() == 1
    sent = judged._jdf.queryExecution().analyzed().children().apply(0).output().size()
    assert sent == len(docs.columns)
