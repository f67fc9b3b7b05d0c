"""Ranked lexical search by dense blocked matrix products (operator 13).

The terms of a block of items form a compact vocabulary. A first pass over the
documents counts, by task, how many documents hold each of its terms, all
documents and all their terms; these counts fix every weight. A second pass
turns a tile of documents into a dense float64 matrix of term impacts and
multiplies the items' weight matrix with it, one vocabulary tile after the
other (BLAS).

All values are integers. A vocabulary tile is no wider than what keeps any
partial sum below 2^53, so that float64 holds it exactly; sums over vocabulary
tiles are kept in int64. The best k of each tile are chosen with all the
documents that tie for the last place, ordered by score and id, and merged with
the best so far, so a tie is never cut by the place of a tile.

Tasks hold one tile and k rows an item. Their rows meet in two shuffles: by item
and group of tasks, then by item.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import translate
from .common import document_columns, lean, materialize, sub_batches

# FIXED VALUES: terms are runs of ASCII letters, digits and all code points from U+0080, A-Z lower-cased; other bytes part them
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b > 127 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
# FIXED VALUES: weight = floor(1000 ln((2N+2)/(2df+1))), impact = (10^9 tf) div (1000 tf + 8 m), m = 100 - 90 + (90 n N) div L
WEIGHT_SCALE, IMPACT_SCALE, TF_SCALE, LENGTH_SCALE, LENGTH_PART = 1000, 1_000_000_000, 1000, 8, 90
EXACT = 1 << 53
MOST_IMPACT = IMPACT_SCALE // TF_SCALE  # an impact is below this

BLOCK_CHARS = 8_000_000    # items' text shipped to the tasks at once
ITEM_ROWS = 1024           # rows of one weight matrix
TILE_DOCS = 1024           # documents of one impact matrix
TILE_TERMS = 4096          # its terms at most; fewer where the weights ask for it
BATCH_BYTES = 8_000_000
TASKS_MERGED = 256         # tasks whose rows meet in the first merge


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(row bounds, terms): terms of row i are terms[bounds[i]:bounds[i + 1]]."""
    lists = pc.split_pattern(translate(texts, TERMS), " ")
    words = lists.flatten()
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    filled = np.asarray(pc.binary_length(words)) > 0
    return np.concatenate([[0], np.cumsum(filled)])[offsets], words.filter(pa.array(filled))


class Items:
    """One block of items: ids, vocabulary, and which terms each item holds (rows of places)."""

    def __init__(self, rows: list[tuple[int, str]]):
        held: dict[int, set[str]] = {}
        for item, text in rows:
            bounds, terms = split_terms(pa.array([text], pa.string()))
            held.setdefault(item, set()).update(terms.to_pylist())
        self.ids = [i for i in sorted(held, key=lambda i: (i is not None, i)) if held[i]]
        self.vocabulary = sorted(set().union(*(held[i] for i in self.ids))) if self.ids else []
        place = {t: j for j, t in enumerate(self.vocabulary)}
        self.terms = [np.array(sorted(place[t] for t in held[i]), dtype=np.int64) for i in self.ids]


def places(terms: pa.Array, vocabulary: pa.Array) -> np.ndarray:
    """Place of each term in the vocabulary, -1 for others."""
    coded = terms.dictionary_encode()
    found = pc.fill_null(pc.index_in(coded.dictionary, value_set=vocabulary), -1)
    return np.asarray(found, dtype=np.int64)[np.asarray(coded.indices)]


def held_terms(bounds: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, tf) of the vocabulary's terms in a batch."""
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    known = at >= 0
    pairs, tf = np.unique(doc[known] * width + at[known], return_counts=True)
    return pairs // width, pairs % width, tf


def collect_statistics(docs: DataFrame, vocabulary: list[str]) -> tuple[int, int, list[int]]:
    """(documents with a term, all their terms, documents holding each vocabulary term).

    Counted by task, summed by a shuffle on the term; one row a term comes back.
    """
    arrow = pa.schema([("place", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.string())
        df, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            bounds, terms = split_terms(batch.column("text"))
            n_docs += int(np.count_nonzero(np.diff(bounds)))
            n_terms += int(bounds[-1])
            _, at, _ = held_terms(bounds, places(terms, known), max(1, len(vocabulary)))
            df += np.bincount(at, minlength=len(vocabulary))
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], held])),
                                          pa.array(np.concatenate([[n_docs, n_terms], df[held]]))], schema=arrow)

    counts = {r.place: r.n for r in docs.select("text").mapInArrow(lean(run), "place long, n long")
              .groupBy("place").agg(F.sum("n").alias("n")).collect()}
    return counts.get(-2, 0), counts.get(-1, 0), [counts.get(j, 0) for j in range(len(vocabulary))]


def weights(n_docs: int, df: list[int]) -> np.ndarray:
    return np.array([math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df], dtype=np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def document_lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents with n terms; in Python's integers, once for each different n."""
    sizes, which = np.unique(n, return_inverse=True)
    return np.array([100 - LENGTH_PART + (LENGTH_PART * int(x) * n_docs) // max(1, n_terms) for x in sizes], dtype=np.int64)[which]


def term_tiles(weight: np.ndarray, most: int = TILE_TERMS) -> list[tuple[int, int]]:
    """Runs of the vocabulary whose weighted impacts sum to less than 2^53 whatever the document."""
    tiles, low, total = [], 0, 0
    for j, w in enumerate(weight.tolist()):
        if w * MOST_IMPACT >= EXACT:
            raise OverflowError("a single term's score may reach 2^53")
        if j > low and (total + w * MOST_IMPACT >= EXACT or j - low >= most):
            tiles, low, total = [*tiles, (low, j)], j, 0
        total += w * MOST_IMPACT
    return [*tiles, (low, len(weight))] if len(weight) else tiles


class Ranking:
    """The best k documents of each item so far: arrays (items x k), score -1 where there is none.

    Order: score descending, then id ascending, null ids first.
    """

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.score = np.full((n_items, k), -1, np.int64)
        self.doc = np.zeros((n_items, k), np.int64)
        self.null = np.zeros((n_items, k), bool)

    def add(self, rows: slice, scores: np.ndarray, doc: np.ndarray, null: np.ndarray) -> None:
        """Take in a tile: scores (items of ``rows`` x documents)."""
        if not scores.size:
            return
        if scores.shape[1] > self.k:
            last = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
        else:
            last = np.full(len(scores), 1)
        bar = np.maximum(np.maximum(last, self.score[rows, -1]), 1)  # every tie for the last place stays
        for i in np.flatnonzero((scores >= bar[:, None]).any(axis=1)).tolist():
            at = np.flatnonzero(scores[i] >= bar[i])
            row = rows.start + i
            score = np.concatenate([self.score[row], scores[i, at]])
            ids, nulls = np.concatenate([self.doc[row], doc[at]]), np.concatenate([self.null[row], null[at]])
            best = np.lexsort((ids, ~nulls, -score))[:self.k]
            self.score[row], self.doc[row], self.null[row] = score[best], ids[best], nulls[best]


def rank_documents(docs: DataFrame, items: Items, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) for one block of items."""
    n_docs, n_terms, df = collect_statistics(docs, items.vocabulary)
    weight = weights(n_docs, df)
    schema = "part long, item int, doc_id long, score long"
    arrow = pa.schema([("part", pa.int64()), ("item", pa.int32()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = pa.array(items.vocabulary, pa.string()), len(items.vocabulary)
        ranking = Ranking(len(items.ids), k)
        item_rows = [slice(r, min(r + ITEM_ROWS, len(items.ids))) for r in range(0, len(items.ids), ITEM_ROWS)]
        tiles = term_tiles(weight)
        blocks = {}
        for rows in item_rows:  # the items' weight matrices, by vocabulary tile
            for tile in tiles:
                w = np.zeros((rows.stop - rows.start, tile[1] - tile[0]))
                for i, terms in enumerate(items.terms[rows]):
                    own = terms[(terms >= tile[0]) & (terms < tile[1])]
                    w[i, own - tile[0]] = weight[own]
                blocks[rows.start, tile] = w
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            bounds, terms = split_terms(batch.column("text"))
            doc, at, tf = held_terms(bounds, places(terms, known), width)
            if not len(doc):
                continue
            m = document_lengths(np.diff(bounds), n_docs, n_terms)
            impact = impacts(tf, m[doc])
            names = batch.column("doc_id")
            null = np.asarray(names.is_null(), dtype=bool)
            ids = np.asarray(pc.fill_null(names, 0), dtype=np.int64)
            for low in range(0, batch.num_rows, TILE_DOCS):
                high = min(low + TILE_DOCS, batch.num_rows)
                a, b = np.searchsorted(doc, (low, high))
                if a == b:
                    continue
                order = np.argsort(at[a:b], kind="stable") + a
                cuts = np.searchsorted(at[order], [t[0] for t in tiles] + [width])
                matrices = []
                for (t0, t1), c0, c1 in zip(tiles, cuts, cuts[1:]):
                    own = order[c0:c1]
                    used, place = np.unique(at[own], return_inverse=True)  # only terms that this tile's documents hold
                    dense = np.zeros((len(used), high - low))
                    dense[place, doc[own] - low] = impact[own]
                    matrices.append((used - t0, dense))
                for rows in item_rows:
                    scores = np.zeros((rows.stop - rows.start, high - low), np.int64)
                    for tile, (used, dense) in zip(tiles, matrices):
                        scores += (blocks[rows.start, tile][:, used] @ dense).astype(np.int64)
                    ranking.add(rows, scores, ids[low:high], null[low:high])
        item, place = np.nonzero(ranking.score > 0)
        if len(item):
            part = TaskContext.get().partitionId() // TASKS_MERGED
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(item), part)), pa.array(item.astype(np.int32)),
                 pa.array(ranking.doc[item, place], mask=ranking.null[item, place]), pa.array(ranking.score[item, place])], schema=arrow)

    best = docs.mapInArrow(lean(run), schema)
    order = (F.desc("score"), F.asc_nulls_first("doc_id"))
    for keys in (("item", "part"), ("item",)):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    names = F.array(*[F.lit(i).cast("long") for i in items.ids])
    return best.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank", "doc_id", "score")


def item_blocks(items: DataFrame) -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_CHARS`` text, dealt by id so that an id's rows stay together."""
    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("string").alias("text")).where("text is not null")
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, math.ceil(chars / BLOCK_CHARS))
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else rows
        block = Items([(r.item_id, r.text) for r in part.distinct().collect()])
        if block.ids:
            yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``docs`` for each of ``items(item_id, text)``.

    Scores are exact integers; only scores above 0 count; equal scores are
    ranked by ascending doc_id, null ids first. Rows of items with one id are
    one item with the terms of all of them (a null id is an id too). Null,
    empty and termless texts are no documents and no items. Repeated rows of
    documents each count and each may be ranked. An empty table on either side
    gives an empty result; other columns, whatever their names, are ignored.

    One pass over the documents for the counts and one for the scores, for each
    ``BLOCK_CHARS`` of items; documents are never shuffled.
    """
    docs = document_columns(docs)
    blocks = list(item_blocks(items))
    out = None
    for block in blocks:
        found = rank_documents(docs, block, k)
        found = found if len(blocks) == 1 else materialize(found, "ranked")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
