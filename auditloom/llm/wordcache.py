"""Values of words, computed once for each distinct word of a slice and kept between slices."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import starts

#: Words kept between slices, and their longest; the store is emptied when it is full.
KEPT, KEPT_CHARS = 400_000, 64


class WordCache:
    """``compute`` takes a list of words and returns a value for each."""

    def __init__(self, compute: Callable[[list[str]], list], kept: int = KEPT):
        self.compute, self.kept, self.store = compute, kept, {}

    def __call__(self, words: list[str]) -> list:
        store = self.store
        out = [store.get(w) for w in words]
        missing = [i for i, v in enumerate(out) if v is None]
        if missing:
            values = self.compute([words[i] for i in missing])
            if len(store) + len(missing) > self.kept:
                store.clear()
            for i, v in zip(missing, values, strict=True):
                out[i] = v
            if len(missing) <= self.kept:
                store.update((words[i], v) for i, v in zip(missing, values, strict=True) if len(words[i]) <= KEPT_CHARS)
        return out


def coded_words(text: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, each word's place among them, words of each text); words are runs of [^\\x20\\x09-\\x0D]."""
    parts = pc.ascii_split_whitespace(text)
    edges = starts(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
    words = parts.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    counts = np.diff(edges)
    if not full.all():
        counts = np.diff(starts(full.astype(np.int64))[edges])
        words = words.filter(pa.array(full))
    coded = words.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), counts
