"""Benchmark decontamination by SimHash item-sized windows (operator 1).

Every document is read in windows as long (in words) as a benchmark item. A
window's SimHash over its five-word shingles is looked up in a multi-index
table of the items of that length: eight blocks of eight bits, each searched
within two bits, so every item fingerprint within 23 bits is found (24 wrong
bits would put three into some block; fewer leave one block with two or less).
The candidates are verified by the exact weighted (multiset) Jaccard
similarity of the shingles.

Windows that share no shingle with any item have similarity zero, so only
windows around shared shingles are fingerprinted; this loses nothing.

The benchmark goes to the tasks in blocks of bounded size (``BLOCK_CHARS``),
one pass over the documents for each block. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, lean, materialize, sub_batches, text_rows

WORD = re.compile(r"\w+")
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_CHARS = 8_000_000  # benchmark text shipped to the tasks at once
BATCH_BYTES = 8_000_000
SPAN = 1 << 15  # shingles fingerprinted at once, so that long texts need bounded memory
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingle_hashes(words: list[str], size: int) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(" ".join(words[i:i + size])) for i in range(len(words) - size + 1)],
                    dtype=np.uint64)


def votes(hashes: np.ndarray) -> np.ndarray:
    """Running sums of each bit's votes, +1 or -1 for each hash; row i sums the first i."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1
    return np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])


def simhash(vote_rows: np.ndarray) -> np.ndarray:
    return np.packbits(vote_rows > 0, axis=1, bitorder="little")


class ItemIndex:
    """Multi-index tables of one block of benchmark items, by shingle size and item length."""

    def __init__(self, items: list[tuple[int, str]], shingle: int):
        self.vocabulary: dict[str, int] = {}
        near = np.array([[bin(a ^ b).count("1") <= BLOCK_RADIUS for b in range(256)] for a in range(256)])
        lengths = defaultdict(list)
        for item_id, text in items:
            words = words_of(text or "")
            if words:
                for w in words:
                    self.vocabulary.setdefault(w, len(self.vocabulary))
                lengths[len(words)].append((item_id, words))
        keys = defaultdict(list)
        self.tables = defaultdict(list)
        for length, group in sorted(lengths.items()):
            size = min(shingle, length)
            prints, counts = [], []
            for _, words in group:
                hashes = shingle_hashes(words, size)
                prints.append(simhash(votes(hashes)[-1:])[0])
                counts.append(Counter(hashes.tolist()))
                keys[size].append(self._keys(np.array([self.vocabulary[w] for w in words]), np.arange(len(hashes)), size))
            prints = np.array(prints)
            # [block, byte] -> which items have a block within BLOCK_RADIUS bits of that byte
            masks = np.stack([near[:, prints[:, b]] for b in range(BLOCKS)])
            self.tables[size].append((length - size + 1, [i for i, _ in group], prints.view("<u8").ravel(), masks, counts))
        self.keys = {size: np.unique(np.concatenate(k)) for size, k in keys.items()}

    @staticmethod
    def _keys(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
        key = np.zeros(len(at), dtype=np.uint64)
        for j in range(size):
            key = (key ^ ids[at + j].astype(np.uint64)) * MULTIPLIER
            key ^= key >> np.uint64(31)
        return key

    def matches(self, text: str, threshold: float) -> dict[int, tuple]:
        """item_id -> (similarity, start, words, hamming) of its best window in the text."""
        found: dict[int, tuple] = {}
        words = words_of(text)
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], dtype=np.int64)
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        for size, tables in self.tables.items():
            n = len(words) - size + 1
            if n <= 0:
                continue
            at = np.flatnonzero(known[size:] - known[:-size] == size)
            if len(at):
                key, table = self._keys(ids, at, size), self.keys[size]
                at = at[table[np.minimum(np.searchsorted(table, key), len(table) - 1)] == key]
            if len(at):
                reach = max(t[0] for t in tables)
                gap = np.flatnonzero((np.diff(at) > 2 * reach) | (np.diff(at // SPAN) > 0)) + 1
                for hits in np.split(at, gap):
                    self._windows(words, n, size, hits, reach, tables, threshold, found)
        return found

    def _windows(self, words, n, size, hits, reach, tables, threshold, found):
        low, high = max(0, int(hits[0]) - reach + 1), min(n, int(hits[-1]) + reach)
        hashes = shingle_hashes(words[low:high + size - 1], size)
        running = votes(hashes)
        for k, item_ids, prints, masks, counts in tables:
            k = min(k, n)  # a text shorter than the item is one window
            mark = np.zeros(high - low + 2, dtype=np.int64)  # windows that hold a hit
            np.add.at(mark, np.maximum(hits - k + 1, low) - low, 1)
            np.add.at(mark, hits + 1 - low, -1)
            starts = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            starts = starts[starts + k <= high - low]
            prints_here = simhash(running[starts + k] - running[starts])
            candidate = np.zeros((len(starts), len(prints)), dtype=bool)
            for b in range(BLOCKS):
                candidate |= masks[b][prints_here[:, b]]
            window, item = np.nonzero(candidate)
            distance = np.bitwise_count(prints_here.view("<u8").ravel()[window] ^ prints[item])
            inside = distance <= RADIUS
            for w, i, d in zip(window[inside].tolist(), item[inside].tolist(), distance[inside].tolist()):
                start = int(starts[w])
                here, there = Counter(hashes[start:start + k].tolist()), counts[i]
                shared = sum(min(c, there[h]) for h, c in here.items() if h in there)
                similarity = shared / (here.total() + there.total() - shared)
                if similarity >= threshold:
                    best = (similarity, -(low + start), k + size - 1, -d)
                    found[item_ids[i]] = max(found.get(item_ids[i], best), best)


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's items in blocks of about ``BLOCK_CHARS``, dealt by hash."""
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"),
                             benchmark["text"].cast("string").alias("text")).where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else items
        yield [(r.item_id, r.text) for r in part.distinct().collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words, hamming): documents that hold an item.

    One row for each row of ``docs`` and item whose best window reaches the
    threshold; of equal windows the first counts. Words are runs of letters,
    digits and underscores, lower-cased. An item (or a text) of fewer words
    than a shingle is one shingle of all its words.

    Null, empty and wordless texts and items match nothing. Equal items match
    under each of their ids, repeated rows of documents each give their rows,
    null ids stay null. An empty table on either side gives an empty result.
    Other columns are ignored.
    """
    docs = document_columns(docs)
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, similarity double, start_word long, n_words long, hamming int"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()),
                       ("start_word", pa.int64()), ("n_words", pa.int64()), ("hamming", pa.int32())])

    def one(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, shingle)
            for batch in batches:
                rows = [(doc, item, s, -start, n, -d)
                        for doc, text in zip(batch.column("doc_id").to_pylist(), text_rows(batch))
                        for item, (s, start, n, d) in index.matches(text.decode("utf-8", "replace"), threshold).items()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        return docs.mapInArrow(lean(run), schema)

    blocks = [one(items) if i == 0 else materialize(one(items), "contaminated")
              for i, items in enumerate(_blocks(benchmark))]
    out = spark.createDataFrame([], schema) if not blocks else blocks[0]
    for more in blocks[1:]:
        out = out.unionByName(more)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; nothing is shuffled.

    Same definitions as ``contaminated``; rows without a text stay.
    """
    at, name = docs.columns.index("text"), "text"

    def dropping(items: list[tuple[int, str]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(items, shingle)
            for batch in batches:
                for piece in sub_batches(iter([batch]), name, BATCH_BYTES):
                    keep = [not t or not index.matches(t, threshold) for t in piece.column(at).to_pylist()]
                    yield piece.filter(pa.array(keep, pa.bool_()))
        return run

    for items in _blocks(benchmark):
        docs = docs.mapInArrow(lean(dropping(items)), docs.schema)
    return docs
