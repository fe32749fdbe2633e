import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from sheaf.functions.constants import DEFAULT_IGNORE_PATTERNS
from sheaf.functions.globs import glob_to_regex
from sheaf.operators.filters import (
    cap_files,
    filter_ignored,
    filter_size,
    filter_tree_ignored,
    over_size,
)


def glob_matches(pattern, text):
    """A glob without classes, matched by trying every length for a star."""

    @cache
    def rest(i, j):
        if i == len(pattern):
            return j == len(text)
        if pattern[i] == "*":
            return rest(i + 1, j) or (j < len(text) and text[j] != "/" and rest(i, j + 1))
        if j == len(text):
            return False
        return (text[j] != "/" if pattern[i] == "?" else pattern[i] == text[j]) and rest(i + 1, j + 1)

    return rest(0, 0)


def prefixes(path):
    parts = path.split("/")
    return ["/".join(parts[: n + 1]) for n in range(len(parts))]


def scan_keeps(path, patterns):
    def skipped(p):
        return any(
            glob_matches(g, p) or (g.endswith("/*") and p.startswith(g[:-1])) for g in patterns if g.strip()
        )

    return not skipped(".") and not any(map(skipped, prefixes(path)))


def tree_keeps(path, patterns):
    def skipped(p):
        name = p.rsplit("/", 1)[-1]
        return any((glob_matches(g, name) if "*" in g else g in p) for g in patterns if g)

    return not any(map(skipped, prefixes(path)))


def kept(spark, paths, operator, patterns):
    frame = spark.createDataFrame([(p,) for p in paths], "path string")
    return {r.path for r in operator(frame, patterns).collect()}


def test_scan_cases(spark):
    files = ["notes.md", "blob.dat", ".settings", "build/out", "lib/heap.rs"]
    assert kept(spark, files, filter_ignored, []) == set(files)
    expected = {"notes.md", ".settings", "lib/heap.rs"}
    assert kept(spark, files, filter_ignored, ["*.dat", "build/*"]) == expected


def test_scan_globs_see_the_whole_path(spark):
    files = ["node_modules/a.js", "x/node_modules/a.js", "a.bin", "x/a.bin", "deps.txt", "_build/deep/er/f"]
    expected = {"x/node_modules/a.js", "x/a.bin", "deps.txt"}
    assert kept(spark, files, filter_ignored, DEFAULT_IGNORE_PATTERNS) == expected


@pytest.mark.parametrize("pattern", ["*", "?", "."])
def test_scan_pattern_that_matches_the_root(spark, pattern):
    assert kept(spark, ["a", "b/c"], filter_ignored, [pattern]) == set()


@pytest.mark.parametrize("pattern", ["[", "[]a", "a[b-", "x\\", "[-a]", "  ", ""])
def test_malformed_and_blank_patterns_match_nothing(spark, pattern):
    files = ["[", "a", "x\\", "[]a", "  "]
    assert kept(spark, files, filter_ignored, [pattern]) == set(files)


@pytest.mark.parametrize(
    "pattern, path, matches",
    [
        ("[a-c]x", "bx", True),
        ("[^a-c]x", "bx", False),
        ("[^a-c]x", "dx", True),
        ("[\\]]", "]", True),
        ("\\*", "*", True),
        ("\\*", "a", False),
        ("a+(b)", "a+(b)", True),
        ("a.b", "axb", False),
        ("[b-a]", "a", False),
        ("a[/]b", "a/b", True),
    ],
)
def test_globs(spark, pattern, path, matches):
    regex = glob_to_regex(pattern)
    frame = spark.createDataFrame([(path,)], "path string")
    assert frame.select(F.col("path").rlike(f"\\A(?:{regex})\\z").alias("m")).first().m == matches


def test_tree_cases(spark):
    files = ["src/mydeps.go", ".gitignore", "x/node_modules/a", "a/b.bin", "a/b.txt", "a?b", "axb"]
    assert kept(spark, files, filter_tree_ignored, DEFAULT_IGNORE_PATTERNS) == {"a/b.txt", "a?b", "axb"}
    # without a star the rule is a substring; a star never crosses or asks for "/"
    assert kept(spark, files, filter_tree_ignored, ["a?b", "a/*", "*/b*"]) == set(files) - {"a?b"}


@pytest.mark.parametrize("operator, keeps", [(filter_ignored, scan_keeps), (filter_tree_ignored, tree_keeps)])
def test_random_cases_equal_the_walk(spark, operator, keeps):
    r = random.Random(7)
    paths = sorted({"/".join("".join(r.choices("ab.", k=r.randint(1, 3))) for _ in range(r.randint(1, 3)))
                    for _ in range(400)})
    for _ in range(25):
        patterns = ["".join(r.choices("ab.*?/", k=r.randint(1, 4))) for _ in range(r.randint(1, 3))]
        patterns += r.choice([[], ["a/*"], ["b.b"]])
        expected = {p for p in paths if keeps(p, patterns)}
        assert kept(spark, paths, operator, patterns) == expected, patterns


def test_size_filter_and_cap(spark):
    rows = [("notes.md", 13), ("blob.dat", 4), (".settings", 11), ("lib/heap.rs", 29), ("b", 5)]
    frame = spark.createDataFrame(rows, "path string, size bigint")
    assert {r.path for r in filter_size(frame, 5).collect()} == {"blob.dat", "b"}
    assert filter_size(frame, None).count() == 5
    assert tuple(over_size(frame, 5).first()) == (3, 53)
    assert {r.path for r in cap_files(frame, 2).collect()} == {".settings", "b"}
    assert cap_files(frame, 0).count() == 5
    with pytest.raises(ValueError):
        filter_size(frame, -1)
    with pytest.raises(ValueError):
        cap_files(frame, -1)


def test_cap_is_exact_on_repeated_paths(spark):
    frame = spark.createDataFrame([(p, i) for i, p in enumerate("bbbabccb")], "path string, size bigint")
    for n in range(1, 10):
        assert sorted(r.path for r in cap_files(frame, n).collect()) == sorted("bbbabccb")[:n]
    assert cap_files(frame.limit(0), 3).count() == 0


def test_many_stars_do_not_backtrack(spark):
    pattern = "*a" * 30 + "*b"
    files = ["a" * 250, "a" * 250 + "b", "x/" + "a" * 250]
    assert kept(spark, files, filter_ignored, [pattern]) == {files[0], files[2]}
    assert kept(spark, files, filter_tree_ignored, [pattern]) == {files[0], files[2]}
