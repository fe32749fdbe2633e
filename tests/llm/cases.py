"""Small tables with everything that is awkward about a table of documents."""

from __future__ import annotations

import random

ODD_COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, rank int, row int, key string, n int"


def documents(spark, rows, columns: str = "doc_id bigint, text string, lang string, source string"):
    return spark.createDataFrame(rows, columns)


def odd_documents(spark):
    """Nulls everywhere, empty and long texts, ties, repeated rows, clashing column names."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [
        (1, "one two three four five six", "en", "a"),
        (1, "one two three four five six", "en", "a"),
        (2, "one two three four five six", None, None),
        (3, "", "en", "a"),
        (4, None, "de", "b"),
        (None, "seven eight", "de", "b"),
        (None, None, None, None),
        (5, "12 !! 34", "en", "b"),
        (6, long, "en", "c"),
        (7, long + " tail", "en", "c"),
        (8, "line\nline\nline\nline\nline", "en", "c"),
        (9, "é ü 漢字 <|endoftext|> \x00 \u2028", "de", "é"),
        (9, "another text with the same number", "de", "é"),
    ]
    return spark.createDataFrame(
        [(*r, 0, "x", i, 7, "k", None) for i, r in enumerate(rows)], ODD_COLUMNS
    )


def near_copies(seed: int, groups: int, size: int, words: int = 60):
    """(doc_id, text): groups of texts that differ in a few words, and a shared passage."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = rng.choices(vocabulary, k=words // 2)
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=words)
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(words)] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                text = passage + text
            rows.append((len(rows), " ".join(text)))
    return rows
