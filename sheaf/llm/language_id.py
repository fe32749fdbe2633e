"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's maximum
over a window is kept, and a softmax layer tells the languages apart. The network is
trained in numpy on a bounded sample of labelled text and sent to the tasks, which cut
every whole text into windows of a fixed length, run them in batches and average the
windows' probabilities by their share of bytes. Documents are scored where they lie: no
shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; any other
text gets a learned language and its mean probability. Rows without text or label are
not learned from. Repeated rows are scored each; an empty table gives an empty result.
Without anything to learn from, every text is ``und``. Columns other than text (and, to
learn, the label and the row filter) play no part.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from sheaf.llm.common import text_batches, text_of

WINDOW = 256
EMBEDDING = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
"""Filters of each width."""
PER_LANGUAGE = 800
"""Most labelled documents that training takes of a language; the bound of the sample."""
PIECES = 3
"""Excerpts taken of each of them."""
UNDETERMINED = "und"
_CHUNK = 128


@dataclass
class ByteNetwork:
    """Embedding (256 x e), filters (widest * e x f), and softmax layer (f x languages)."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    layer: np.ndarray
    bias: np.ndarray

    @property
    def widest(self) -> int:
        return self.filters.shape[0] // self.embedding.shape[1]

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all filters at all places, and their maxima."""
        n, length = windows.shape
        e = self.embedding.shape[1]
        # Rows of the embedded bytes lie one after another, so a place's receptive field
        # is a view of consecutive numbers.
        padded = np.zeros((n, length + self.widest - 1, e), dtype="f4")
        padded[:, :length] = self.embedding[windows]
        fields = np.lib.stride_tricks.as_strided(
            padded,
            (n, length, self.widest * e),
            (padded.strides[0], padded.strides[1], padded.strides[2]),
            writeable=False,
        )
        answers = fields.reshape(n * length, -1) @ self.filters
        answers = answers.reshape(n, length, -1)
        return answers, answers.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        scores = np.maximum(self.pooled(windows)[1] + self.shift, 0) @ self.layer + self.bias
        scores = np.exp(scores - scores.max(axis=1, keepdims=True))
        return scores / scores.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts with zeros behind the ends, their texts' numbers and bytes."""
    counts = np.array([max(1, -(-len(t) // window)) for t in texts])
    flat = np.zeros((int(counts.sum()), window), dtype="u1")
    owner = np.repeat(np.arange(len(texts)), counts)
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    sizes = np.full(len(flat), window)
    for text, at, n in zip(texts, starts, counts):
        flat[at : at + n].reshape(-1)[: len(text)] = np.frombuffer(text, dtype="u1")
        sizes[at + n - 1] = len(text) - (n - 1) * window
    return flat, owner, sizes


def train(
    texts: list[bytes], labels: list[str], window: int = WINDOW, seed: int = 7, rounds: int = 8, rate: float = 0.004
) -> ByteNetwork:
    """Fit a network by Adam on windows, some of them shortened at random.

    Languages weigh the same however many examples they have.
    """
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    field = max(WIDTHS)
    f = FILTERS * len(WIDTHS)
    net = ByteNetwork(
        languages,
        random.normal(0, 0.5, (256, EMBEDDING)).astype("f4"),
        random.normal(0, 0.35, (field * EMBEDDING, f)).astype("f4"),
        np.zeros(f, "f4"),
        random.normal(0, 0.2, (f, len(languages))).astype("f4"),
        np.zeros(len(languages), "f4"),
    )
    seen = np.zeros_like(net.filters)  # a filter sees no more bytes than its width
    for k, width in enumerate(WIDTHS):
        seen[: width * EMBEDDING, k * FILTERS : (k + 1) * FILTERS] = 1
    net.filters *= seen
    net.embedding[0] = 0
    x, owner, _ = windows_of(texts, window)
    y = np.array([languages.index(label) for label in labels])[owner]
    weight = (len(y) / (len(languages) * np.bincount(y, minlength=len(languages)).clip(1)))[y].astype("f4")
    names = ("embedding", "filters", "shift", "layer", "bias")
    moments = {name: [np.zeros_like(getattr(net, name)) for _ in range(2)] for name in names}
    step = 0
    for turn in range(rounds):
        for at in np.array_split(random.permutation(len(x)), max(1, len(x) // 64)):
            batch = x[at].copy()
            cut = random.random(len(at)) < 0.4
            ends = np.where(cut, random.integers(8, window + 1, len(at)), window)
            batch[np.arange(window)[None, :] >= ends[:, None]] = 0
            answers, top = net.pooled(batch)
            place = answers.argmax(axis=1)
            hidden = np.maximum(top + net.shift, 0)
            scores = hidden @ net.layer + net.bias
            p = np.exp(scores - scores.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            p *= (weight[at] / len(at))[:, None]
            back = (p @ net.layer.T) * (hidden > 0)
            # The bytes under each filter's best place, (batch, filter, field).
            bytes_at = np.pad(batch, ((0, 0), (0, field - 1)))
            under = bytes_at[np.arange(len(at))[:, None, None], place[:, :, None] + np.arange(field)]
            vectors = net.embedding[under].reshape(len(at), f, -1)
            slopes = {
                "layer": hidden.T @ p + 1e-4 * net.layer,
                "bias": p.sum(axis=0),
                "shift": back.sum(axis=0),
                "filters": np.einsum("nfk,nf->kf", vectors, back) * seen,
                "embedding": np.zeros_like(net.embedding),
            }
            to_bytes = back[:, :, None] * net.filters.T[None]
            np.add.at(slopes["embedding"], under.reshape(-1), to_bytes.reshape(-1, EMBEDDING))
            slopes["embedding"][0] = 0
            step += 1
            pace = rate * (1 - turn / rounds)
            for name, slope in slopes.items():
                first, second = moments[name]
                first += 0.1 * (slope - first)
                second += 0.001 * (slope**2 - second)
                change = first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
                getattr(net, name)[...] -= (pace * change).astype("f4")
    return net


def sample(docs: DataFrame, label: str, learn: Column, per_language: int = PER_LANGUAGE) -> list[tuple[bytes, str]]:
    """Excerpts of at most ``per_language`` documents of each label, chosen by a hash.

    A label's share is known from a count, so each task tells by itself whether a text is
    in the sample; copies of a text count as one, and excerpts have a bounded length.
    """
    texts = docs.select(text_of(docs).alias("text"), docs[label].cast("string").alias("label"), learn.alias("learn"))
    texts = texts.where("learn AND label IS NOT NULL AND text != ''")
    texts = texts.withColumn("order", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    counts = texts.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    share = F.lit(float(per_language)) / F.col("n")
    chosen = texts.join(F.broadcast(counts), "label").where(F.col("order") <= share * float(1 << 40))
    start = F.greatest(F.lit(1), F.length("text") - WINDOW)
    excerpts = [
        F.substring("text", 1 + F.pmod(F.xxhash64("text", F.lit(k)), start).cast("int"), F.lit(WINDOW))
        for k in range(PIECES)
    ]
    parts = chosen.select("label", "order", F.array(*excerpts).alias("parts"))
    parts = parts.groupBy("label", "order").agg(F.first("parts").alias("parts"))
    rows = sorted(parts.collect(), key=lambda r: (r["label"], r["order"]))
    taken: Counter[str] = Counter()
    examples = []
    for row in rows:
        taken[row["label"]] += 1
        if taken[row["label"]] <= per_language:
            examples += [(part.encode(), row["label"]) for part in row["parts"]]
    return examples


def identify(docs: DataFrame, net: ByteNetwork | None, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents with their language and score; columns of these names are replaced."""
    kept = [c for c in docs.columns if c.lower() not in (lang, score)]
    rows = docs.select(*[docs[c] for c in kept])
    at = [c.lower() for c in kept].index("text")  # texts travel once, as they are
    schema = StructType(
        [*rows.schema.fields, StructField(lang, StringType()), StructField(score, DoubleType())]
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}")
        for batch in batches:
            for part in text_batches(batch, 4 << 20):
                texts = [t or "" for t in part.column(at).to_pylist()]
                found: list[str] = [UNDETERMINED] * len(texts)
                scores = np.zeros(len(texts))
                told = [i for i, t in enumerate(texts) if letter.search(t)] if net else []
                if told:
                    shares = _shares(net, [texts[i].encode() for i in told])
                    best = shares.argmax(axis=1)
                    for i, k, p in zip(told, best, shares[np.arange(len(told)), best]):
                        found[i], scores[i] = net.languages[k], min(1.0, float(p))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(found, pa.string()), pa.array(scores)],
                    names=[*kept, lang, score],
                )

    return rows.mapInArrow(judge, schema)


def _shares(net: ByteNetwork, texts: list[bytes]) -> np.ndarray:
    """Mean probabilities of each text's windows, by their bytes."""
    windows, owner, sizes = windows_of(texts)
    p = np.empty((len(windows), len(net.languages)))
    for at in range(0, len(windows), _CHUNK):
        p[at : at + _CHUNK] = net.probabilities(windows[at : at + _CHUNK])
    first = np.searchsorted(owner, np.arange(len(texts)))
    total = np.add.reduceat(p * sizes[:, None], first, axis=0)
    return total / np.maximum(1, np.add.reduceat(sizes, first))[:, None]


def learned(docs: DataFrame, learn: Column, label: str = "lang") -> ByteNetwork | None:
    """A network trained on the rows for which ``learn`` holds; none without examples."""
    examples = sample(docs, label, learn)
    return train(*map(list, zip(*examples))) if examples else None


def fold(docs: DataFrame, parts: int) -> Column:
    """CRC-32 of the doc_id as text, modulo ``parts``; a null doc_id counts as ``''``."""
    return F.crc32(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary")) % parts


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from three quarters of them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held_out = fold(docs, 4) == 2
    net = learned(docs, ~held_out)
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    return identify(rows, net).select("doc_id", "held_out", "lang_pred", "score")
