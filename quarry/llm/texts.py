"""Texts in Arrow arrays as plain bytes, for operators that work on bytes with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each begins (and the last ends). A null text is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    if data is None:
        return np.empty(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def parts(data: np.ndarray, at: np.ndarray, most: int = 1 << 22) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The same in parts of whole texts, of about `most` bytes or one long text: first text, last text + 1, bytes, offsets."""
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes for which inside holds, no run going on into the next text."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[at] = True
    start = inside & (edge[:-1] | ~np.r_[False, inside[:-1]])
    end = inside & (edge[1:] | ~np.r_[inside[1:], False])
    return np.flatnonzero(start), np.flatnonzero(end) + 1
