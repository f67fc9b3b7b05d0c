"""Fill-in-middle transformation with a Fenwick tree over text blocks (operator 11).

A text is cut, at two places drawn from its id, into prefix, middle and suffix,
which are written in one of three forms: ``plain`` (the text), ``psm``
(prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind
its sentinel. Cuts fall between units: a word with the white space before it,
or the white space that ends the text.

The cut after the k-th unit is found through ``BlockTree``: the text's bytes lie
in blocks of fixed size, a Fenwick tree holds how many units end and how many
code points begin in each, a binary-lifting descent finds the block where the
k-th unit ends and the counts before it, and only that block is searched.

Everything is map only. ``restore`` rebuilds the text from output and form
alone, with built-in functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import document_columns, lean, sub_batches, text_rows

# FIXED VALUES: the sentinels before prefix, suffix and middle
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
BLOCK_BYTES = 2048
BATCH_BYTES = 8_000_000
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
FORM_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class BlockTree:
    """Unit and code-point counts of a UTF-8 text, by block, in a Fenwick tree.

    ``tree[i]`` (row 0 is empty) sums the ``lowbit(i)`` blocks that end at block i.
    """

    def __init__(self, text: bytes, block: int = BLOCK_BYTES):
        data = np.frombuffer(text, np.uint8)
        space = SPACE[data]
        self.block = block
        # a unit ends at the last byte of each word and where a text that ends in white space ends
        self.ends = ~space
        if len(data):
            self.ends[:-1] &= space[1:]
            self.ends[-1] = True
        self.starts = (data & 0xC0) != 0x80  # first bytes of code points
        n = -(-len(data) // block)
        totals = np.zeros((n + 1, 2), np.int64)
        if n:
            at = np.arange(0, len(data), block)
            totals[1:, 0] = np.add.reduceat(self.ends, at, dtype=np.int64)
            totals[1:, 1] = np.add.reduceat(self.starts, at, dtype=np.int64)
        running = np.cumsum(totals, axis=0)
        index = np.arange(n + 1)
        self.tree = running - running[index - (index & -index)]
        self.units, self.code_points = (int(x) for x in running[-1])

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the text's first ``k`` units."""
        if k <= 0:
            return 0, 0
        if k > self.units:
            raise IndexError(f"unit {k} of {self.units}")
        blocks, units, points = 0, 0, 0
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:  # the most blocks that together hold fewer than k units
            ahead = blocks + step
            if ahead < len(self.tree) and units + self.tree[ahead, 0] < k:
                blocks, units, points = ahead, units + int(self.tree[ahead, 0]), points + int(self.tree[ahead, 1])
            step >>= 1
        low = blocks * self.block
        inside = int(np.flatnonzero(self.ends[low:low + self.block])[k - units - 1]) + 1
        return low + inside, points + int(np.count_nonzero(self.starts[low:low + inside]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four draws below 2^32 for a document: groups of the SHA-256 of ``seed:doc_id`` (null id: no digits)."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def arrange(text: bytes, doc_id: int | None, rate: int, spm: int, seed: int, block: int = BLOCK_BYTES):
    """(n, form, prefix code points, middle code points, output bytes) of one text."""
    tree = BlockTree(text, block)
    n = tree.units
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    (a, a_points), (b, b_points) = (tree.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm:
        form, parts = "spm", (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
    else:
        form, parts = "psm", (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
    return n, form, a_points, b_points - a_points, b"".join(parts)


def transform(docs: DataFrame, rate: int = 50, spm: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs(doc_id, text)``.

    ``rate`` per cent of the texts are rearranged, ``spm`` per cent of those
    suffix first. Null texts are empty. Empty texts and texts that hold a
    sentinel are plain; in plain rows prefix_chars and middle_chars are null. A
    cut may be at either end of the text and both may coincide, so any part may
    be empty. A null id draws as an id without digits; rows of one id draw
    alike, and repeated rows each give theirs. A text of white space is one
    unit. Long texts need memory for themselves only. An empty table gives an
    empty result; other columns, whatever their names, are ignored.
    """
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                       ("middle_chars", pa.int64()), ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            ids = batch.column("doc_id").to_pylist()
            rows = [arrange(t, i, rate, spm, seed) for i, t in zip(ids, text_rows(batch))]
            n, form, prefix, middle, output = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())], schema=arrow)

    return document_columns(docs).mapInArrow(lean(run), FORM_SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The source text of an output, read back from the output and its form alone.

    A rearranged text holds each sentinel once: no part holds one, and a
    sentinel can't arise across a border, since it starts and ends with
    characters that occur in it once.
    """
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))

    def between(opening: str, closing: str) -> Column:
        """What stands between two sentinels of the output."""
        rest = F.substring_index(output, opening, -1)
        return F.substring_index(rest, closing, 1)

    middle = F.substring_index(output, m, -1)
    psm = F.concat(between(p, s), middle, between(s, m))
    spm = F.concat(between(p, m), middle, between(s, p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
