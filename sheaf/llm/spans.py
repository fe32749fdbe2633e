"""Texts of an Arrow batch as spans of bytes, found with numpy and never copied."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each text starts, with the end; null is empty."""
    texts = texts.cast(pa.string()).fill_null("")
    _, places, data = texts.buffers()
    starts = np.frombuffer(places, dtype="i4", count=len(texts) + 1, offset=4 * texts.offset).astype("i8")
    whole = np.frombuffer(data, dtype="u1") if data is not None else np.zeros(0, dtype="u1")
    return whole[starts[0] : starts[-1]], starts - starts[0]


def cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings between neighbouring bounds, over the same bytes."""
    places = pa.py_buffer(bounds.astype("i4"))
    return pa.StringArray.from_buffers(len(bounds) - 1, places, pa.py_buffer(data))


def words_of(
    data: np.ndarray, starts: np.ndarray, inside: Callable[[np.ndarray], np.ndarray]
) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, and of each occurrence its word and its text's number, in order.

    A word is a maximal stretch of the bytes that ``inside`` marks, within one text.
    """
    if not len(data):
        return pa.array([], pa.string()), np.zeros(0, "i4"), np.zeros(0, "i8")
    marked = inside(data)
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.not_equal(marked[1:], marked[:-1], out=edge[1:])
    edge[starts[:-1][starts[:-1] < len(data)]] = True
    bounds = np.append(np.flatnonzero(edge), len(data))
    coded = cut(data, bounds).dictionary_encode()
    words = np.flatnonzero(marked[bounds[:-1]])
    code = coded.indices.to_numpy()[words]
    text = np.searchsorted(starts, bounds[words], "right") - 1
    return coded.dictionary, code, text


def joined_by_space(words: pa.Array, code: np.ndarray, text: np.ndarray, texts: int) -> pa.Array:
    """Each text's words with one space between them."""
    counts = np.bincount(text, minlength=texts)
    places = np.concatenate([[0], np.cumsum(counts)]).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(places), words.take(pa.array(code)))
    return pa.compute.binary_join(lists, " ")
