"""Vectorised splitting of texts into lower-cased letter runs, on UTF-8 bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A-Z to a-z; every other ASCII byte that is no letter to a space. Bytes above
# 127 (letters of other scripts, and their punctuation) stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))
# A-Z to a-z only
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def translate(column: pa.Array, table: bytes) -> pa.Array:
    """The text column (null: empty) with every byte mapped by ``table``."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    lo, hi = int(offsets[0]), int(offsets[-1])
    mapped = pa.py_buffer(bytes(memoryview(data)[lo:hi]).translate(table)) if hi > lo else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((offsets - lo).tobytes()), mapped)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row bounds, words): words of row i are words[bounds[i]:bounds[i + 1]].

    Cut at bytes 09-0D and 20; empty pieces are dropped.
    """
    lists = pc.ascii_split_whitespace(texts)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    words = lists.flatten()
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.binary_length(words)) > 0
    if not filled.all():
        words = words.filter(pa.array(filled))
        offsets = np.concatenate([[0], np.cumsum(filled)])[offsets]
    return offsets, words


def distinct(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(index of each word, distinct words)."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def word_bytes(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8)
    data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None and len(words) else np.zeros(0, np.uint8)
    return offsets, data
