"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over the words and word beginnings that tell toxic examples from
others. A bounded number of labelled examples is indexed by term in blocks, each with the
largest weight that a term has in the block. For a text these give an upper bound of its
cosine with any example of a block; blocks are visited by falling bound until no bound
reaches the k-th best cosine, so the neighbours are exact. They vote with the square of their
cosine, and a logistic curve, fitted on the examples themselves, each judged without
itself, turns the vote into a probability. The neighbours are returned as evidence.

Examples, chosen terms and the curve come from the bounded sample of labelled rows; the
terms' document frequencies are counted over all documents. The index goes to the tasks
and documents are scored where they lie.

Defined results: a text is its runs of letters in lower case. A text without chosen terms,
be it empty or null, gets the share of toxic examples among examples like it. Of equal
cosines the example that comes first in the index wins. Rows without label, or whose
doc_id has none, are not learned from; several labels of a doc_id count as their largest.
Copies of a text are one example. Without examples of both kinds every score is the share
of toxic ones, 0 if there are none. Repeated rows are scored each; an empty table gives an
empty result. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from sheaf.llm.common import fresh, text_batches, text_of, written
from sheaf.llm.language_id import fold

EXAMPLES = 20_000
"""About so many labelled documents are examples, half of them toxic if there are enough."""
TERMS = 1_500
"""Most chosen terms."""
LIFT = 4.0
"""How much more frequent a chosen term is among toxic examples."""
EVIDENCE = 20.0
"""Least log-likelihood ratio of a chosen term."""
BEGINNINGS = (4, 5, 6)
"""Lengths of word beginnings, in bytes, that are terms beside the words."""
REPEATS = (2, 3, 5)
"""A beginning that comes so often in a text is a further term."""
NEIGHBOURS = 15
BLOCK = 64
"""Examples of a block."""
_PRIOR = 0.25
"""Weight of the overall share in a vote."""

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_LETTERS).split()


def terms_of(word: bytes) -> list[bytes]:
    """The word and, marked, its beginnings."""
    return [word, *(b"^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def all_terms(text: str | None) -> set[bytes]:
    """A text's words, their beginnings, and beginnings that come repeatedly."""
    times: Counter[bytes] = Counter()
    for word, n in Counter(words_of(text)).items():
        for term in terms_of(word):
            times[term] += n
    more = (b"%d" % m + t for t, n in times.items() if t[:1] == b"^" for m in REPEATS if n >= m)
    return {*times, *more}


class Features:
    """Counts of the chosen terms in a text; what a word gives is remembered."""

    def __init__(self, terms: list[bytes]) -> None:
        self.place = {term: i for i, term in enumerate(terms)}
        # A repeated beginning needs the count of the plain one, chosen or not.
        plain = {t[1:] for t in terms if t[:1].isdigit()} - set(terms)
        self.unchosen = {t: -1 - i for i, t in enumerate(sorted(plain))}
        self.more: dict[int, list[tuple[int, int]]] = {}
        for term, i in self.place.items():
            if term[:1].isdigit():
                base = self.place.get(term[1:], self.unchosen.get(term[1:]))
                self.more.setdefault(base, []).append((int(term[:1]), i))
        self.known: dict[bytes, tuple[int, ...]] = {}

    def counts(self, text: str | None) -> dict[int, int]:
        found: dict[int, int] = {}
        known = self.known
        for word in words_of(text):
            places = known.get(word)
            if places is None:
                if len(known) > 200_000:
                    known.clear()
                both = (self.place.get(t, self.unchosen.get(t)) for t in terms_of(word))
                places = tuple(i for i in both if i is not None)
                known[word] = places
            for i in places:
                found[i] = found.get(i, 0) + 1
        for base in found.keys() & self.more.keys():
            n = found[base]
            found.update((i, 1) for m, i in self.more[base] if n >= m)
        return {i: n for i, n in found.items() if i >= 0}


@dataclass
class Neighbours:
    """A block-max index of unit vectors, and what votes become probabilities by."""

    terms: list[bytes]
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    share: np.ndarray
    """How many labelled documents an example stands for."""
    most: np.ndarray
    """blocks x terms: the largest weight of the term in the block, else 0."""
    column: np.ndarray
    """blocks x terms: the term's column in the block's matrix, else -1."""
    blocks: list[np.ndarray]
    without: float = 0.0
    """Score of a text without chosen terms."""
    prior: float = 0.0
    curve: tuple[float, float] = (0.0, 1.0)

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        places = np.array(sorted(counts), dtype="i8")
        weights = (1 + np.log([counts[int(i)] for i in places])) * self.idf[places]
        return places, weights / np.sqrt((weights**2).sum())

    def nearest(self, places: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k nearest examples with a term in common."""
        bounds = self.most[:, places] @ weights
        found, cosines = np.zeros(0, dtype="i8"), np.zeros(0)
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or len(found) == k and bounds[block] < cosines[-1] - 1e-9:
                break
            columns = self.column[block, places]
            here = columns >= 0
            score = self.blocks[block][:, columns[here]] @ weights[here]
            at = np.flatnonzero(score > 0)
            number = at + block * BLOCK
            if skip >= 0:
                at, number = at[number != skip], number[number != skip]
            found = np.concatenate([found, number])
            cosines = np.concatenate([cosines, score[at]])
            best = np.lexsort((found, -cosines))[:k]
            found, cosines = found[best], cosines[best]
        return found, cosines

    def vote(self, found: np.ndarray, cosines: np.ndarray) -> float:
        weight = cosines**2 * self.share[found]
        mean = self.share.mean() if len(self.share) else 1.0
        return float((weight @ self.toxic[found] + _PRIOR * mean * self.prior) / (weight.sum() + _PRIOR * mean))

    def probability(self, vote: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-(a + b * vote))))

    def judge(self, counts: dict[int, int]) -> tuple[float, np.ndarray, np.ndarray]:
        if not counts:
            return self.without, self.ids[:0], np.zeros(0)
        found, cosines = self.nearest(*self.vector(counts), NEIGHBOURS)
        if not len(found):
            return self.without, self.ids[:0], np.zeros(0)
        return self.probability(self.vote(found, cosines)), self.ids[found], cosines


def build(
    terms: list[bytes], idf: np.ndarray, examples: list[tuple[int, int, float, dict[int, int]]]
) -> Neighbours:
    """An index of (doc_id, toxic, share, counts of terms)."""
    weight = np.array([e[2] for e in examples])
    label = np.array([e[1] for e in examples], dtype="f8")
    prior = float((weight @ label) / weight.sum()) if len(examples) else 0.0
    bare = [i for i, e in enumerate(examples) if not e[3]]
    told = [i for i, e in enumerate(examples) if e[3]]
    index = Neighbours(terms, idf, np.zeros(0, "i8"), np.zeros(0), np.zeros(0), np.zeros((0, len(terms))),
                       np.zeros((0, len(terms)), "i4"), [], prior=prior)
    # Two examples' worth of the overall share keeps a few bare examples from deciding alone.
    lean = 2 * weight.mean() if len(examples) else 1.0
    index.without = float((weight[bare] @ label[bare] + lean * prior) / (weight[bare].sum() + lean))
    vectors = [index.vector(examples[i][3]) for i in told]
    # Examples with the same strongest term lie together, which keeps the bounds tight.
    order = sorted(range(len(told)), key=lambda i: (int(vectors[i][0][vectors[i][1].argmax()]), examples[told[i]][0]))
    told, vectors = [told[i] for i in order], [vectors[i] for i in order]
    index.ids = np.array([examples[i][0] for i in told], dtype="i8")
    index.toxic, index.share = label[told], weight[told]
    n = -(-len(told) // BLOCK)
    index.most = np.zeros((n, len(terms)), dtype="f4")
    index.column = np.full((n, len(terms)), -1, dtype="i4")
    for block in range(n):
        own = vectors[block * BLOCK : (block + 1) * BLOCK]
        used = np.unique(np.concatenate([v[0] for v in own]))
        index.column[block, used] = np.arange(len(used))
        matrix = np.zeros((len(own), len(used)), dtype="f4")
        for row, (places, weights) in enumerate(own):
            matrix[row, index.column[block, places]] = weights
        index.blocks.append(matrix)
        index.most[block, used] = matrix.max(axis=0)
    if len(told) and 0 < index.toxic.sum() < len(told):
        votes = np.array([index.vote(*index.nearest(*v, NEIGHBOURS, skip=i)) for i, v in enumerate(vectors)])
        index.curve = _curve(votes, index.toxic, index.share)
    elif len(told):
        index.curve = (np.log(max(index.toxic[0], 0.02) / max(1 - index.toxic[0], 0.02)), 0.0)
    return index


def _curve(votes: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of a logistic curve, by Newton's method with a little ridge."""
    x = np.stack([np.ones_like(votes), votes], axis=1)
    w = weight / weight.mean()
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ beta))
        slope = x.T @ (w * (p - toxic)) + 1e-2 * beta
        bend = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(bend, slope)
        beta = beta - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def _each(make: Callable[[], Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]]):
    """A mapInArrow function that works on slices of some megabytes."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in text_batches(batch):
                yield from work(part)

    return stream


def _chosen_terms(examples: DataFrame) -> list[bytes]:
    """Terms more frequent among toxic examples, the most telling first."""

    def count() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            seen: dict[int, Counter[bytes]] = {0: Counter(), 1: Counter()}
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                seen[toxic].update(all_terms(text))
            for toxic, terms in seen.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(list(terms), pa.binary()),
                        pa.array([toxic] * len(terms), pa.int32()),
                        pa.array(list(terms.values()), pa.int64()),
                    ],
                    names=["term", "toxic", "n"],
                )

        return work

    kinds = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(1) or not kinds.get(0):
        return []
    yes, no = float(kinds[1]), float(kinds[0])
    counts = examples.select("text", "toxic").mapInArrow(_each(count), "term binary, toxic int, n bigint")
    table = counts.groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("a"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("b"),
    )
    a, b, share = F.col("a"), F.col("b"), yes / (yes + no)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = 2 * (
        part(a, (a + b) * share) + part(b, (a + b) * (1 - share))
        + part(yes - a, yes - (a + b) * share) + part(no - b, no - (a + b) * (1 - share))
    )
    telling = table.where((a >= 2) & (a / yes >= LIFT * b / no)).withColumn("ratio", ratio)
    best = telling.where(F.col("ratio") >= EVIDENCE).orderBy(F.desc("ratio"), "term").limit(TERMS)
    return [bytes(r["term"]) for r in best.select("term").collect()]


def _frequencies(docs: DataFrame, terms: list[bytes]) -> np.ndarray:
    """Inverse document frequencies of the terms over all documents."""

    def count() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        features = Features(terms)

        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            seen = np.zeros(len(terms) + 1, dtype="i8")
            for text in part.column(0).to_pylist():
                seen[list(features.counts(text))] += 1
            seen[-1] = part.num_rows
            at = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], names=["place", "n"])

        return work

    told = docs.select(text_of(docs).alias("text")).mapInArrow(_each(count), "place bigint, n bigint")
    sums = {r["place"]: r["n"] for r in told.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    every = sums.get(len(terms), 0)
    seen = np.array([sums.get(i, 0) for i in range(len(terms))], dtype="f8")
    return np.log((1 + every) / (1 + seen)) + 1


def learned(docs: DataFrame, labels: DataFrame, learn: Column, examples: int = EXAMPLES) -> Neighbours:
    """An index of the labelled documents for whose label row ``learn`` holds."""
    rows = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    rows = written(
        rows.groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic")), "labels"
    )
    kinds = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    rare = min(kinds.get(1, 0), examples // 2)
    wanted = {1: rare, 0: examples - rare}
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    share = {kind: min(1.0, wanted[kind] / max(1, n)) for kind, n in kinds.items()}
    bound = F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0))
    chosen = rows.where(order <= bound * float(1 << 40))  # about ``examples`` rows: bounded
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), text_of(docs).alias("text"))
    taken = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic")), "doc_id")
    once = taken.groupBy(F.xxhash64("text").alias("copy")).agg(
        F.min_by("text", "doc_id").alias("text"), F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")
    )
    once = written(once.select("text", "toxic", "doc_id"), "examples")
    terms = _chosen_terms(once)
    idf = _frequencies(docs, terms)

    def count() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        features = Features(terms)

        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            counts = [features.counts(text) for text in part.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(2),
                    part.column(1),
                    pa.array([list(c) for c in counts], pa.list_(pa.int32())),
                    pa.array([list(c.values()) for c in counts], pa.list_(pa.int64())),
                ],
                names=["doc_id", "toxic", "places", "counts"],
            )

        return work

    vectors = once.mapInArrow(_each(count), "doc_id bigint, toxic int, places array<int>, counts array<bigint>")
    table = vectors.toArrow().sort_by("doc_id").to_pylist()
    weigh = {kind: 1 / s for kind, s in share.items() if s}
    return build(
        terms, idf, [(r["doc_id"], r["toxic"], weigh[r["toxic"]], dict(zip(r["places"], r["counts"]))) for r in table]
    )


def score(docs: DataFrame, index: Neighbours) -> DataFrame:
    """The documents with score, predicted, evidence_ids and evidence_cosines."""
    new = ["score", "predicted", "evidence_ids", "evidence_cosines"]
    kept = [c for c in docs.columns if c.lower() not in new]
    text = fresh(kept, stem="text")
    rows = docs.select(*[docs[c] for c in kept], text_of(docs).alias(text))
    schema = StructType(
        [
            *rows.schema.fields[:-1],
            StructField("score", DoubleType()),
            StructField("predicted", IntegerType()),
            StructField("evidence_ids", ArrayType(LongType())),
            StructField("evidence_cosines", ArrayType(DoubleType())),
        ]
    )

    def make() -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        features = Features(index.terms)
        known: dict[tuple, tuple] = {}

        def work(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            judged = []
            for value in part.column(len(kept)).to_pylist():
                counts = features.counts(value)
                mark = tuple(sorted(counts.items()))
                if mark not in known:
                    if len(known) > 20_000:
                        known.clear()
                    known[mark] = index.judge(counts)
                judged.append(known[mark])
            scores = np.array([j[0] for j in judged])
            yield pa.RecordBatch.from_arrays(
                [
                    *part.columns[: len(kept)],
                    pa.array(scores),
                    pa.array((scores >= 0.5).astype("i4")),
                    pa.array([j[1] for j in judged], pa.list_(pa.int64())),
                    pa.array([j[2] for j in judged], pa.list_(pa.float64())),
                ],
                names=[*kept, *new],
            )

        return work

    return rows.mapInArrow(_each(make), schema)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's toxicity, learned from four fifths of the labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    index = learned(docs, labels, fold(labels, 5) != 0)
    rows = docs.select("doc_id", "text", (fold(docs, 5) == 0).alias("held_out"))
    return score(rows, index).select(
        "doc_id", "held_out", "score", "predicted", "evidence_ids", "evidence_cosines"
    )
