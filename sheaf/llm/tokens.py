"""Token ids of a public byte-level vocabulary, inside tasks.

The vocabulary's own file decides what the ids are. Its merges as ranks give the same
ids several times faster, so they are used for texts of characters on which all Unicode
versions agree; any other text goes through the vocabulary file itself.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Anything but Latin letters and general punctuation, which no Unicode version changed.
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def default_vocabulary() -> tuple[str, str]:
    """Paths of the vocabulary and of its merges as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None = None) -> Callable[[str], list[int]]:
    """A function from text to ids; strings of special tokens are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    own.encode_special_tokens = True

    def by_file(text: str) -> list[int]:
        return own.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return by_file
    import public_tokenizers
    import tiktoken

    merges = _merges(ranks)
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}
    )

    def by_ranks(text: str) -> list[int]:
        if text.isascii() or not _OTHER.search(text):
            return fast.encode_ordinary(text)
        return by_file(text)

    return by_ranks


@functools.lru_cache(maxsize=2)
def _merges(ranks: str) -> dict[bytes, int]:
    with open(ranks, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def _opening_ids(ranks: str) -> np.ndarray:
    """Which ids are tokens that start with a space."""
    merges = _merges(ranks)
    opens = np.zeros(max(merges.values()) + 1, dtype=bool)
    opens[[i for token, i in merges.items() if token[:1] == b" "]] = True
    return opens


#: Where a space is next to other white space, or at the start of it.
_CROWDED = "[\\t-\\r \\x{85}\\x{A0}] | [\\t-\\r\\x{85}\\x{A0}]"
_OTHER_RE2 = "[^\\x{00}-\\x{24F}\\x{2010}-\\x{2027}\\x{2030}-\\x{205E}]"


def encoded(texts: pa.Array, vocabulary: str, ranks: str | None, end: int) -> Iterator[np.ndarray]:
    """The ids of each text as unsigned 32-bit integers, closed by ``end``; null is empty.

    No token spans the place before a single space, so texts are cut there and every
    distinct piece of the batch is encoded once.
    """
    encode = encoder(vocabulary, ranks)
    texts, whole = _prepared(texts, ranks)
    batch = _Pieces(texts.filter(pa.array(~whole)), encode, ranks)
    pieces = batch.ids()
    for text, alone in zip(texts, whole):
        ids = np.array(encode(text.as_py()), dtype="<u4") if alone else next(pieces)
        yield np.append(ids, np.uint32(end))


def counted(texts: pa.Array, vocabulary: str, ranks: str | None) -> np.ndarray:
    """How many ids ``encoded`` gives for each text, the closing one included."""
    encode = encoder(vocabulary, ranks)
    texts, whole = _prepared(texts, ranks)
    out = np.empty(len(texts), dtype="i8")
    out[~whole] = _Pieces(texts.filter(pa.array(~whole)), encode, ranks).counts()
    out[whole] = [len(encode(t.as_py())) for t in texts.filter(pa.array(whole))]
    return out + 1


def _prepared(texts: pa.Array, ranks: str | None) -> tuple[pa.Array, np.ndarray]:
    """Texts without nulls, and which of them have to be encoded whole."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    if not ranks:
        return texts, np.ones(len(texts), dtype=bool)
    odd = pc.or_(pc.match_substring_regex(texts, _OTHER_RE2), pc.match_substring_regex(texts, _CROWDED))
    return texts, odd.to_numpy(zero_copy_only=False)


class _Pieces:
    """Texts as pieces that start with a space, but for each text's first."""

    def __init__(self, texts: pa.Array, encode: Callable[[str], list[int]], ranks: str | None) -> None:
        self.starts = np.zeros(1, dtype="i8")
        if not len(texts):
            return
        cut = pc.split_pattern(texts, " ")
        starts = cut.offsets.to_numpy()
        coded = cut.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        self.starts = starts = starts.astype("i8") - starts[0]
        words = coded.dictionary
        codes = coded.indices.to_numpy().copy()
        # First pieces have no space in front and so codes of their own.
        own, first_codes = np.unique(codes[starts[:-1]], return_inverse=True)
        codes[starts[:-1]] = len(words) + first_codes
        # All words as one text; the ids that start with a space are where words start.
        filled = pc.binary_length(words).to_numpy() > 0
        some = words.filter(pa.array(filled))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
        ids = np.array(encode(" " + joined) if joined else [], dtype="<u4")
        sizes = np.zeros(len(words), dtype="i8")
        sizes[filled] = np.diff(np.flatnonzero(_opening_ids(ranks)[ids]), append=len(ids))
        place = np.cumsum(sizes) - sizes
        alone = [encode(words[int(i)].as_py()) for i in own]
        tail = np.array([len(a) for a in alone], dtype="i8")
        tail_place = len(ids) + np.cumsum(tail) - tail
        more = [i for a in alone for i in a]
        # An empty piece that is not the first is a space that ends its text.
        sizes[~filled], place[~filled] = 1, len(ids) + len(more)
        self.codes = codes
        self.values = np.concatenate([ids, np.array([*more, *encode(" ")], dtype="<u4")])
        self.sizes = np.concatenate([sizes, tail])
        self.place = np.concatenate([place, tail_place])

    def counts(self) -> np.ndarray:
        if len(self.starts) < 2:
            return np.zeros(0, dtype="i8")
        return np.add.reduceat(self.sizes[self.codes], self.starts[:-1])

    def ids(self) -> Iterator[np.ndarray]:
        """A text's ids at a time; some texts' places are worked out together."""
        counts = np.concatenate([[0], np.cumsum(self.counts())])
        for low in range(0, len(self.starts) - 1, 64):
            high = min(low + 64, len(self.starts) - 1)
            piece = self.codes[self.starts[low] : self.starts[high]]
            n = self.sizes[piece]
            before = np.cumsum(n) - n
            ids = self.values[np.repeat(self.place[piece] - before, n) + np.arange(counts[high] - counts[low])]
            yield from np.split(ids, counts[low + 1 : high] - counts[low])
