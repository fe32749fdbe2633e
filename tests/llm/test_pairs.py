"""Near-duplicate joins against brute force, with skewed groups and awkward rows."""

import random
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheaf.llm import common, embedding_dedup, ngram_join
from sheaf.llm.bloom import bloom_of
from sheaf.llm.components import components
from sheaf.llm.shingles import shingle_set, word_hashes
from tests.llm.cases import documents, near_copies, odd_documents


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(found) < words:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + words]) for i in range(len(found) - words + 1))


def brute_components(rows, words, percent):
    sets = {i: shingles(text, words) for i, text in rows}
    ids = sorted(sets)
    links = []
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                links.append((j, i))
    return {i: (len(sets[i]), root) for i, root in roots(ids, links).items()}


def test_components_of_random_links(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)]
    links += [(i, i + 1) for i in range(1000, 1100)] + [(5000, i) for i in range(5001, 5200)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*links, (None, 1)], "a bigint, b bigint")).collect()}
    assert got == roots({n for pair in links for n in pair}, links)
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@given(st.text(alphabet="aB \t\n\x0b é1", max_size=60), st.integers(1, 5))
@settings(max_examples=200, deadline=None)
def test_shingle_sets_have_the_right_size(text, words):
    assert len(shingle_set(text.encode(), words)) == len(shingles(text, words))


def test_equal_words_hash_alike_anywhere():
    text = ("alpha beta " * 200_000 + "gamma").encode()  # more than one stretch
    hashes = word_hashes(text)
    assert len(hashes) == 400_001 and len(np.unique(hashes)) == 3
    assert word_hashes(b"x beta")[1] == hashes[1]


@given(st.integers(1, 400), st.integers(0, 200), st.integers(0, 200), st.sampled_from([80, 85, 95]), st.integers(0, 10**6), st.booleans())
@settings(max_examples=400, deadline=None)
def test_sets_that_link_share_a_key(common, left, right, percent, seed, crowded):
    rng = np.random.default_rng(seed)
    left, right = (min(x, common * (100 - percent) // percent) for x in (left, right))
    while left + right and 100 * common < percent * (common + left + right):
        left, right = (left - 1, right) if left >= right else (left, right - 1)
    values = np.unique(rng.integers(0, 1 << 63, common + left + right + 50, dtype="u8"))
    rng.shuffle(values)
    a = np.sort(values[: common + left])
    b = np.sort(np.concatenate([values[:common], values[common + left : common + left + right]]))
    usual = np.sort(values[: common if crowded else common // 2])
    if len(a) != len(b) or (a != b).any():
        assert np.intersect1d(ngram_join.keys_of(a, percent, usual), ngram_join.keys_of(b, percent, usual)).size


@pytest.mark.parametrize("words,percent", [(4, 85), (5, 80)])
def test_ngram_components_equal_brute_force(spark, words, percent):
    rows = near_copies(7, 25, 12)
    found = ngram_join.ngram_components(documents(spark, rows, "doc_id bigint, text string"), words, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, words, percent)
    assert sum(r.kept for r in found) == len({r.component_id for r in found})
    assert all(r.doc_id == r.component_id for r in found if r.kept)


def test_ngram_tiles_of_a_large_cluster(spark, monkeypatch):
    # Small blocks, and nothing small enough to be sent to all tasks.
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(ngram_join, "BROADCAST_COPIES", -1)
    rows = near_copies(11, 2, 120)
    found = ngram_join.ngram_components(documents(spark, rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 4, 85)


def test_ngram_join_moves_little_at_a_time(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ngram_join, "ROUND_SHINGLES", 500, raising=False)
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 16)
    made = []

    def folder(session, name):
        made.append(name)
        return f"{tmp_path}/{name}-{len(made)}"

    monkeypatch.setattr(common, "new_folder", folder)
    rows = near_copies(5, 6, 60)
    found = ngram_join.ngram_components(documents(spark, rows, "doc_id bigint, text string"), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components(rows, 4, 85)
    assert made.count("shared-keys") == made.count("stars") == 8 and made.count("tile-links") > 2
    # What grows with the texts is gone before the documents are moved.
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "stars" in left and not left & {"shingle-keys", "shared-keys", "sets"}


def test_written_leaves_no_shuffled_files(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(setting, None)

    def shuffles():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
        return set(re.findall(r"shuffle_\d+", blocks.mkString(" ")))

    before = shuffles()
    table = common.written(spark.range(20_000).repartition(4, "id").groupBy("id").count().repartition(3), "table")
    for _ in range(100):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before
    assert table.count() == 20_000 and spark.conf.get(setting, None) == was


def test_keys_of_many_sets_are_not_one_window(spark):
    rows = [(i, f"c{i}", [7, 1000 + i // 2] if i % 3 else [1000 + i // 2]) for i in range(300)]
    keyed = documents(spark, rows, "row bigint, class string, keys array<bigint>")
    stars = ngram_join._candidates(keyed.select(keyed["row"].alias("node")), keyed)
    first = {}
    for row, _, keys in rows:
        for key in keys:
            first.setdefault(key, row)
    want = sorted((first[key], row) for row, _, keys in rows for key in keys if first[key] != row)
    assert sorted(map(tuple, stars.collect())) == want
    assert "Window" not in stars._jdf.queryExecution().toString()


def test_ngram_components_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = ngram_join.ngram_components(docs, 4, 85).collect()
    assert len(rows) == docs.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert {r.component_id for r in by_id[1] + by_id[2]} == {1} and sum(r.kept for r in by_id[1] + by_id[2]) == 1
    assert all(r.n_shingles == 0 and r.kept and r.component_id == r.doc_id for r in by_id[3] + by_id[4])
    assert sorted((r.n_shingles, r.component_id) for r in by_id[None]) == [(0, None), (1, None)]
    assert {r.component_id for r in by_id[6] + by_id[7]} == {6}
    assert ngram_join.ngram_components(documents(spark, []), 4, 85).count() == 0


def test_bloom_lets_its_own_keys_pass(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000, dtype="i8")
    frame = spark.createDataFrame([(int(k),) for k in keys[:1000]], "h bigint")
    bloom = bloom_of(frame, "h", 1000)
    assert bloom.passes(keys[:1000]).all()
    assert bloom.passes(keys[1000:]).mean() < 0.05


def brute_links(vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ unit.T >= threshold


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    rows = [rng.normal(size=16) for _ in range(400)]
    for base in rows[:40]:
        for _ in range(rng.integers(1, 5)):
            rows.append(base + rng.normal(scale=0.08, size=16))
    rows += [rows[3] * 2.5] * 120 + [rows[5]] * 60
    return np.array(rows)


def test_embedding_links_equal_brute_force(spark, vectors):
    frame = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    rows = {r.vec_id: r for r in embedding_dedup.near_duplicates(frame).collect()}
    linked = brute_links(vectors)
    want = linked.sum(axis=1) - 1
    got = np.array([rows[i].n_links for i in range(len(vectors))])
    assert (got <= want).all() and got.sum() >= 0.95 * want.sum()
    if (got == want).all():
        parts = roots(range(len(vectors)), [tuple(p) for p in np.argwhere(linked).tolist()])
        assert {i: r.component_id for i, r in rows.items()} == parts
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())


def test_embedding_blocks(spark, vectors, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    frame = spark.createDataFrame(
        [(i, [float(np.float32(x)) for x in v + 1e-4 * i]) for i, v in enumerate(np.repeat(vectors[:1], 300, axis=0))],
        "vec_id bigint, embedding array<float>",
    )
    rows = embedding_dedup.near_duplicates(frame).collect()
    assert {(r.n_links, r.component_id) for r in rows} == {(299, 0)}


def test_embedding_links_of_a_dense_group_among_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROWS_PER_CELL", 2)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    centre /= np.linalg.norm(centre)
    near = rng.normal(size=(900, 64))
    near -= (near @ centre)[:, None] * centre
    near = np.sqrt(0.92) * centre + np.sqrt(0.08) * near / np.linalg.norm(near, axis=1, keepdims=True)
    rows = np.concatenate([near, rng.normal(size=(1800, 64))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    got = np.array([got[i] for i in range(len(rows))])
    want = brute_links(rows).sum(axis=1) - 1
    assert (got <= want).all() and got.sum() >= 0.97 * want.sum()


def test_embeddings_longer_than_any_of_the_sample(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 4)
    rows = [(i, [float(i), 1.0, 0.0]) for i in range(60)] + [(100, [0.0] * 5 + [1.0]), (101, [0.0] * 5 + [2.0]), (102, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    assert got[100] == got[101] == (1, 100) and got[102] == (0, 102)


def test_embeddings_that_are_no_vectors(spark):
    rows = [
        (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 0.0]),
        (7, [2.0, 0.0]), (7, [2.0, 0.0]), (None, [3.0, 0.0]), (8, [1.0]), (9, []), (10, [-0.0, 1.0]), (11, [0.0, 1e-300]), (None, None),
    ]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = embedding_dedup.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    links = defaultdict(set)
    for r in got:
        links[r.vec_id].add((r.n_links, r.component_id, r.kept))
    assert links[1] == {(3, 1, True)} and links[7] == {(3, 1, False)}
    assert links[None] == {(3, 1, False), (0, None, False)}
    assert all(links[i] == {(0, i, True)} for i in (2, 3, 4, 5, 6, 8, 9))
    assert links[10] == {(1, 10, True)} and links[11] == {(1, 10, False)}
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_traversal_visits_nearest_cells_first():
    rng = np.random.default_rng(2)
    index = embedding_dedup.MultiIndex(8, rng.normal(size=(9, 4)), rng.normal(size=(9, 4)))
    points = rng.normal(size=(50, 8))
    left, right = index.halves(points)
    sums = ((left[:, None] - index.left) ** 2).sum(-1)[:, :, None] + ((right[:, None] - index.right) ** 2).sum(-1)[:, None, :]
    for visits in (1, 5, 20, 81):
        cells = index.traversal(points, visits)
        want = np.sort(sums.reshape(50, -1), axis=1)[:, :visits]
        assert np.allclose(np.take_along_axis(sums.reshape(50, -1), cells, axis=1), want)
