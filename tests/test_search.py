import itertools
import random
import re

import pytest

from sheaf.functions import constants
from sheaf.operators import search


def docs(spark, *rows):
    return spark.createDataFrame(list(enumerate(rows)), "path int, content string")


def paths(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "path string")


def test_path_search(spark):
    frame = paths(spark, "src/Main.go", "README", "a/maintain")
    assert {r.path for r in search.search_path(frame, "MAIN").collect()} == {"src/Main.go", "a/maintain"}
    assert search.search_path(frame, "").count() == 3


def fuzzy_model(rows, query, k):
    pattern = re.compile(".*?".join(map(re.escape, query)), re.I | re.S)
    hits = [(m.end() - m.start(), m.start(), len(p), p) for p in rows if (m := pattern.search(p))]
    return [h[3] for h in sorted(hits)[:k]]


@pytest.mark.parametrize("query", ["mg", "a.b", "+(", "zzz", "AB", "\\", "é", "^a", "]["])
def test_fuzzy(spark, query):
    r = random.Random(3)
    rows = sorted({"".join(r.choices("amgb./+(\\éA^[]", k=r.randint(1, 9))) for _ in range(300)})
    got = [x.path for x in search.search_fuzzy(paths(spark, *rows), query, 10).collect()]
    assert got == fuzzy_model(rows, query, 10)


def test_fuzzy_does_not_backtrack(spark):
    rows = ["a" * 3000, "a" * 3000 + "b"]
    got = [x.path for x in search.search_fuzzy(paths(spark, *rows), "a" * 30 + "B", 10).collect()]
    assert got == rows[1:]
    assert [x.path for x in search.search_fuzzy(paths(spark, "Élan", "x"), "éN", 5).collect()] == ["Élan"]


@pytest.mark.parametrize("k", [3, 1200])
def test_fuzzy_many(spark, k):
    r = random.Random(4)
    rows = sorted({"".join(r.choices("abc/.", k=r.randint(1, 8))) for _ in range(3000)})
    queries = ["a", "abc", "b.", "a", ""]
    got = {}
    for x in search.search_fuzzy_many(paths(spark, *rows), queries, k).orderBy("query", "rank").collect():
        got.setdefault(x.query, []).append(x.path)
    expected = {q: fuzzy_model(rows, q, k) for q in ("a", "abc", "b.")}
    assert got == {**expected, "": sorted(rows, key=lambda p: (len(p), p))[:k]}
    assert search.search_fuzzy_many(paths(spark, *rows), [], k).count() == 0


def aligned_model(rows, query, k):
    """The best of all alignments, tried one by one."""

    def gain(path, at):
        last = path[at - 1] if at else ""
        out = constants.ALIGN_START if at == 0 else 0
        out += constants.ALIGN_AFTER_SEPARATOR if at and last in constants.ALIGN_SEPARATORS else 0
        return out + (constants.ALIGN_CAMEL_CASE if last.islower() and path[at].isupper() else 0)

    hits = []
    for path in rows:
        places = [[i for i, c in enumerate(path) if c.lower() == letter] for letter in query.lower()]
        best = None
        for way in itertools.product(*places):
            if all(a < b for a, b in zip(way, way[1:])):
                score = sum(gain(path, at) for at in way)
                score += sum(constants.ALIGN_ADJACENT for a, b in zip(way, way[1:]) if b == a + 1)
                score -= min(constants.ALIGN_LEADING_GAP * way[0], constants.ALIGN_MOST_LEADING_GAP)
                score -= constants.ALIGN_UNMATCHED * (len(path) - len(query))
                best = score if best is None else max(best, score)
        if best is not None:
            hits.append((-best, len(path), path))
    return [(path, -score) for score, _, path in sorted(hits)[:k]]


@pytest.mark.parametrize("query", ["mg", "a.b", "AB", "\\", "é", "mgA", "aa", "zzz", "]["])
def test_aligned(spark, query):
    r = random.Random(5)
    rows = sorted({"".join(r.choices("amgbAMGé./-_ \\][", k=r.randint(1, 12))) for _ in range(400)})
    got = [(x.path, x.score) for x in search.search_aligned(paths(spark, *rows), query, 25).collect()]
    assert got == aligned_model(rows, query, 25)


def test_aligned_prefers_words(spark):
    rows = ["internal/xmlmagic/gone", "cmd/myGate/main.go", "mg", "images/m/grid", "m/long/way/to/g"]
    got = [x.path for x in search.search_aligned(paths(spark, *rows), "mg", 3).collect()]
    assert got == [p for p, _ in aligned_model(rows, "mg", 3)] and "internal/xmlmagic/gone" not in got
    assert search.search_aligned(paths(spark, *rows), "", 2).where("score = 0").count() == 5
    long = "a/" * 2000 + "zq"
    assert search.search_aligned(paths(spark, long), "aazq", 1).first().score is not None


def test_search_and_preview(spark):
    frame = spark.createDataFrame(
        [("src/main", "one\ntwo\n"), ("main", "two\n"), ("m/a/i/n", "x\n"), ("other", "two\n")],
        "path string, content string",
    )
    rows = search.search_and_preview(frame, "main", 2, "TWO").orderBy("rank", "line_no").collect()
    assert [(r.rank, r.path, r.line_no, r.is_match) for r in rows] == [
        (1, "main", 1, True), (2, "src/main", 1, False), (2, "src/main", 2, True),
    ]


def test_one_case_rule(spark):
    frame = docs(spark, "ΟΔΟΣ\nx", "οδοσ", "οδός", "DİŞ\n", "diş")
    for query, hits in (("Σ", [0, 1]), ("οδοσ", [0, 1]), ("ΟΔΟΣ", [0, 1]), ("dİ", [3, 4]), ("İŞ", [3, 4])):
        assert sorted(r.path for r in search.grep_lines(frame, query).collect()) == hits
        assert sorted(r.path for r in search.match_stats(frame, query).where("match_count > 0").collect()) == hits
        named = paths(spark, "ΟΔΟΣ", "οδοσ", "DİŞ", "diş")
        assert search.search_path(named, query).count() == 2
    shown = search.preview(docs(spark, "a\nΟΔΟΣ\n"), "οδοσ").where("is_match AND is_current").collect()
    assert [r.line_no for r in shown] == [2]


def test_grep(spark):
    frame = docs(spark, "The cat\nno\nOTHER", "none", "x\nthe\n")
    rows = sorted((r.path, r.line_no, r.line) for r in search.grep_lines(frame, "the").collect())
    assert rows == [(0, 0, "The cat"), (0, 2, "OTHER"), (2, 1, "the")]
    assert search.grep_lines(frame, "").count() == 0
    assert search.grep_lines(frame, "cat\nno").count() == 0


@pytest.mark.parametrize("query", ["the", "T.E", "a+", "", "x\ny", "\\E"])
def test_match_stats(spark, query):
    rows = ["The the\nno\nOTHER the", "none", "", "t.e\n\n\nT.e a+", "x\ny", "\\e\\E"]
    for r in search.match_stats(docs(spark, *rows), query).collect():
        lines = rows[r.path].split("\n")
        hits = [i for i, line in enumerate(lines) if query and query.lower() in line.lower()]
        assert (r.line_count, r.match_count, r.first_match) == (len(lines), len(hits), min(hits, default=None))


def preview_model(text, query, max_lines=1000, context=5):
    lines = text.split("\n")[:-1][:max_lines]
    match = [bool(query) and query.lower() in line.lower() for line in lines]
    current = match.index(True) if True in match else 0
    first = max(0, current - context)
    return [(i + 1, lines[i], i == current, match[i]) for i in range(first, len(lines))]


@pytest.mark.parametrize("query", ["needle", "", "LAST", "line 0"])
def test_preview(spark, query):
    rows = [
        "",
        "no line feed",
        "\n",
        "line 0\nline 1\nNeedle\n last",
        "\n".join(f"line {i}" for i in range(40)) + "\nneedle\nx\n",
        "\n".join(f"line {i}" for i in range(1500)) + "\nneedle\n",
        "x\n" * 999 + "last\nafter\n",
    ]
    got = {}
    for r in search.preview(docs(spark, *rows), query).orderBy("path", "line_no").collect():
        got.setdefault(r.path, []).append((r.line_no, r.line, r.is_current, r.is_match))
    for i, text in enumerate(rows):
        assert got.get(i, []) == preview_model(text, query)


def test_preview_leaves_binary_files_out(spark):
    frame = spark.createDataFrame(
        [("a", True, "x\n"), ("b", False, "y\n")], "path string, is_binary boolean, content string"
    )
    assert [r.path for r in search.preview(frame).collect()] == ["b"]
