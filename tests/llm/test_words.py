"""Spelling variants, periodic runs and byte-level BPE against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from sheaf.llm import periodic_runs as R
from sheaf.llm import spelling as S
from sheaf.llm import word_bpe as W
from sheaf.llm.spans import cut, text_bytes
from tests.llm.cases import ODD_COLUMNS, documents, odd_documents

SMALLEST = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_of(frame) -> list[tuple]:
    return [(r[0], r[1]) for r in frame.select("doc_id", "text").collect()]


# Spelling variants


def lower(word: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def typed(rows, every: int | None) -> collections.Counter:
    n = collections.Counter()
    for doc, text in rows:
        for word in map(lower, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{doc}:{word}".encode())
            if every and doc is not None and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return n


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:k] + a[k + 1 :] == b for k in range(len(a)))


def grouped(n: dict[str, int]) -> dict[str, tuple]:
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n[w], len(near[w]), n.get(form.get(w)))
    return out


def spelled(frame) -> dict[str, tuple]:
    rows = frame.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: tuple(r)[1:] for r in rows}


def test_counts_and_deletions(spark):
    for frame in (odd_documents(spark), spark.read.parquet(f"{SMALLEST}/documents.parquet")):
        for every in (None, 3):
            got = {r.word: r.n for r in S.word_counts(frame, length=3, times=2, every=every).collect()}
            want = {w: c for w, c in typed(texts_of(frame), every).items() if len(w) >= 3 and c >= 2}
            assert got == want


@pytest.mark.parametrize("block", [1024, 3])
def test_groups_are_those_of_brute_force(spark, block):
    rng = random.Random(3)
    n = {"".join(rng.choices("abé", k=rng.randint(1, 7))): rng.choice([1, 2, 30, 400]) for _ in range(220)}
    for word in ("hotspelling", "x" * 300, "y" * 300 + "z"):
        for k in range(70):  # a key with far more words than the others
            n[word[: k % len(word)] + chr(97 + k % 26) + word[k % len(word) :]] = 1 + k
        n[word] = 5000
    frame = spark.createDataFrame(list(n.items()), "word string, n bigint")
    assert spelled(S.spelling_groups(frame, block=block)) == grouped(n)


def test_roots_follow_long_chains(spark):
    chain = [("w" * k, "w" * (k + 1)) for k in range(1, 12)]
    got = {r.word: r.root for r in S.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {word: "w" * 12 for word, _ in chain}


def test_words_of_no_documents(spark):
    assert S.spelling_groups(S.word_counts(spark.createDataFrame([], ODD_COLUMNS))).count() == 0
    bare = documents(spark, [(1, None, "en", "a"), (2, "", "en", "a"), (3, "12 漢字", "en", "a")])
    assert S.spelling_groups(S.word_counts(bare)).count() == 0


def test_spelling_query(spark):
    got = spelled(S.op11_spelling_variants(spark, SMALLEST))
    rows = texts_of(spark.read.parquet(f"{SMALLEST}/documents.parquet"))
    n = {w: c for w, c in typed(rows, 31).items() if len(w) >= 7 and c >= 2}
    # Only words of one length or the next are near, so brute force goes by a deleted letter.
    assert {w: g[2] for w, g in got.items()} == n
    some = sorted(n)[::7]
    for word in some:
        near = [v for v in n if abs(len(v) - len(word)) < 2 and (v[:2] == word[:2] or v[-2:] == word[-2:]) and one_edit(v, word)]
        assert got[word][3] == len(near)


# Periodic runs


def all_runs(words: list, least: int) -> list[tuple[int, int, int]]:
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            own = words[i : j + q]
            if length >= max(least, 2 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_of_random_symbols(least):
    rng = random.Random(least)
    for _ in range(400):
        n = rng.randint(1, 60)
        words = rng.choices(range(rng.randint(1, 6)), k=n)
        if rng.random() < 0.5:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        words = [rng.randrange(100, 200) if rng.random() < 0.05 else w for w in words]
        codes = np.array(words)
        want = all_runs(words, least)
        assert [tuple(r) for r in R.runs_of(codes, least).tolist()] == want
        # What no repeat covers is folded, and nothing is lost by it.
        keep = R.covered(codes, np.zeros(n, dtype="i8"), least // 2)
        assert [tuple(r) for r in R._text_runs(codes, keep, least).tolist()] == want


def test_extensions_are_common_prefixes():
    rng = random.Random(9)
    symbols = [*rng.choices([1, 2], k=200), 0]
    tree = R.SuffixTree(symbols)
    assert sorted(range(201), key=lambda i: symbols[i:]) == sorted(range(201), key=tree.rank.__getitem__)
    i, j = np.array([(a, b) for a in range(201) for b in range(201) if a != b]).T
    for a, b, got in zip(i.tolist(), j.tolist(), tree.extension(i, j).tolist()):
        assert symbols[a : a + got] == symbols[b : b + got]
        assert symbols[a + got : a + got + 1] != symbols[b + got : b + got + 1]


def test_runs_of_odd_documents(spark):
    frame = odd_documents(spark).where(F.length("text").isNull() | (F.length("text") < 10_000))
    long = documents(spark, [(50, "a b c " * 4000 + "d", "en", "a"), (51, "x y  \t\n" * 30, "en", "a")])
    frame = frame.unionByName(long, allowMissingColumns=True)
    rows = R.periodic_runs(frame, least=4).collect()
    assert len(rows) == frame.count()
    left = collections.Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in rows)
    want = collections.Counter()
    for doc, text in texts_of(frame):
        words = WORD.findall(text or "")
        runs = all_runs(words, 4) if len(words) < 5000 else [(0, 12_000, 3)]
        want[(doc, len(words), tuple(runs), collapsed(words, runs))] += 1
    assert left == want
    assert R.periodic_runs(spark.createDataFrame([], ODD_COLUMNS)).count() == 0


def test_bytes_that_are_not_text(spark):
    frame = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("cast(x'61FF80C3' as string)").alias("text"))
    assert R.periodic_runs(frame).first().collapsed == "a���"
    assert W.encode(frame).first().decoded.decode() == "a���"
    assert S.word_counts(frame, length=1, times=1).collect() == [("a", 1)]


def test_runs_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in R.op12_periodic_runs(spark, SMALLEST).collect()}
    planted = 0
    for doc, text in texts_of(spark.read.parquet(f"{SMALLEST}/documents.parquet")):
        words = WORD.findall(text or "")
        h = zlib.crc32(str(doc).encode())
        g, n = h // 10, len(words)
        if n > 1500:
            continue
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        runs = all_runs(words, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        assert got[doc] == (
            len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        )
    assert planted


# Byte-level BPE


def library():
    return W._encoding(W.default_ranks())


def test_pre_tokens_are_the_patterns_matches():
    import public_tokenizers

    rng = random.Random(1)
    letters = list(" \n\t  '''sstrevmldlabZ09.,-é漢　\xa0´̈‘ǅ½Ⅷ😀")
    classes = W._classes(W.class_ranges())
    for _ in range(3000):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 4))]
        data, starts = text_bytes(pa.array(texts))
        got = cut(data, W.pre_tokens(data, starts, classes)).to_pylist()
        assert got == [m.group() for t in texts for m in regex.finditer(public_tokenizers.PATTERN, t)]


def test_classes_of_every_code_point_are_the_librarys():
    """A code point between letters, numbers and spaces is cut as the library cuts it."""
    classes = W._classes(W.class_ranges())
    rng = random.Random(4)
    points = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    encode = library().encode_ordinary
    for _ in range(300):
        text = "".join(rng.choice(["a", "1", " ", "!", "'", "\n"]) + chr(rng.choice(points)) for _ in range(30))
        data, starts = text_bytes(pa.array([text]))
        words = cut(data, W.pre_tokens(data, starts, classes)).to_pylist()
        assert [i for word in words for i in encode(word)] == encode(text)


def test_ids_and_bytes_are_the_librarys(spark, monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", 2000)  # many slices in the blocks
    odd = odd_documents(spark).repartition(3)
    frame = documents(
        spark,
        [(100, "it's 'sad we'll'd " * 3 + "  \n\n end ", "en", "a"), (101, "x" * 30_000, "en", "a"), (102, " ", "en", "a")],
    ).unionByName(odd.select("doc_id", "text", "lang", "source"))
    frame.write.mode("overwrite").parquet(path := _scratch(spark))
    frame = spark.read.parquet(path)
    rows = W.encode(frame).collect()
    got = collections.Counter((r.doc_id, r.n_tokens, bytes(r.ids), bytes(r.decoded)) for r in rows)
    want = collections.Counter()
    for doc, text in texts_of(frame):
        ids = library().encode_ordinary(text or "")
        want[(doc, len(ids), np.array(ids, dtype="<u4").tobytes(), (text or "").encode())] += 1
    assert got == want
    assert W.encode(spark.createDataFrame([], ODD_COLUMNS)).count() == 0


def test_keys_of_any_kind(spark):
    frame = spark.createDataFrame([("a", "one two", 1), (None, "three", 2)], "name string, text string, block int")
    got = {r["name"]: bytes(r.decoded) for r in W.encode(frame, key="name").collect()}
    assert got == {"a": b"one two", None: b"three"}


def test_documents_in_another_order_are_refused(spark):
    words = documents(spark, [(1, "one two", "en", "a")])
    block = W._Block(0)
    block.add(pa.array([1]), pa.array(["three four"]), W._classes(W.class_ranges()))
    table = W._Table()
    row = next(W._by_block(_coded(W.encode_words(W.pre_token_rows(words), W.default_ranks()))))
    table.add(row)
    with pytest.raises(ValueError, match="another order"):
        list(table.documents(next(block.document_rows()), "doc_id"))


def _coded(frame) -> pa.Table:
    tokens = {i: word for word, i in W._merges(W.default_ranks()).items()}
    rows = frame.toArrow()
    raw = pa.array([tokens[i] for i in rows.column("id").to_pylist()], pa.binary())
    return rows.append_column("bytes", raw)


def test_decoding_explodes_and_joins(spark):
    ids = library().encode_ordinary("Ein Satz, 漢字 and émigré")
    frame = spark.createDataFrame([(1, ids), (2, []), (3, None)], "doc_id int, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in W.decode(frame, "doc_id").collect()}
    assert got == {1: "Ein Satz, 漢字 and émigré".encode(), 2: b"", 3: b""}


def test_bpe_query(spark):
    got = {r.doc_id: tuple(r)[1:] for r in W.op13_byte_bpe(spark, SMALLEST).collect()}
    rows = texts_of(spark.read.parquet(f"{SMALLEST}/documents.parquet"))
    assert len(got) == len(rows)
    for doc, text in rows:
        ids = library().encode_ordinary(text or "")
        assert got[doc] == (
            len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest(),
        )


def _scratch(spark) -> str:
    from sheaf.session import new_folder

    return new_folder(spark, "test")
