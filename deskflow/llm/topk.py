"""Exact top-k search in binary codes by incremental multi-index hashing (operator 10).

A code of B bits is cut into segments; a table per segment finds all codes that
agree with a query's segment up to a radius. When every segment has been
searched to radius r, each code within ``segments * (r + 1) - 1`` bits has been
seen (else every segment would differ by more than r). So the radius grows, one
bit at a time, until a query's k-th verified Hamming distance lies within that
bound: then no unseen code can be closer or tie.

Spark deals the distinct codes over tasks; each task indexes its part and
searches it for a block of queries, and the parts' results meet in one ranking
per query. Copies of a code are folded first to their k smallest ids, as ties
go to the smaller id, so a code that a third of all rows share costs no more
than any other. Queries come in blocks of ``QUERY_BLOCK``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize

MANY_CODES = 1 << 13  # from here on segments have 16 bits, else 8: a table has about as many cells as codes
QUERY_BLOCK = 1 << 16
CODES_PER_TASK = 1 << 18
LOOKUPS = 1 << 20  # table cells visited at once


def sign_codes(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, code): one bit for each component, 1 where it is positive, packed into bytes.

    Null ids, null vectors and empty vectors have no code. A null or NaN
    component is not positive.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.packbits(np.array([x is not None and x > 0 for x in v], dtype=bool), bitorder="little").tobytes()
                     for v in batch.column("v").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(codes, pa.binary())], ["id", "code"])

    chosen = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).alias("v"))
    return chosen.where("id is not null and size(v) > 0").mapInArrow(lean(run), "id long, code binary")


def fold_copies(codes: DataFrame, k: int) -> DataFrame:
    """(code, ids): each distinct code with its ``k`` smallest ids, in order.

    Each task folds its own rows first, so that a code's group holds at most k
    ids for each task and batch, whatever its number of rows.
    """
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.to_pandas().drop_duplicates().sort_values("id").groupby("code", sort=False).head(k)
            yield pa.RecordBatch.from_pandas(part[["id", "code"]], preserve_index=False)

    ranked = codes.mapInArrow(lean(first), "id long, code binary").distinct().withColumn(
        "n", F.row_number().over(Window.partitionBy("code").orderBy("id")))
    return ranked.where(F.col("n") <= k).groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))


class SegmentIndex:
    """Tables of one task's codes, one for each segment."""

    def __init__(self, codes: list[bytes], ids: list[list[int]]):
        width = max(map(len, codes), default=2)
        width += -width % 8
        self.words = self._words(codes, width)
        self.ids, self.copies = ids, np.array([len(i) for i in ids])
        self.cell_type, self.bits = ("<u2", 16) if len(codes) >= MANY_CODES else ("<u1", 8)
        self.segments = self.words.view(self.cell_type).astype(np.int64)
        self.tables = []
        for s in range(self.segments.shape[1]):
            order = np.argsort(self.segments[:, s], kind="stable")
            edges = np.searchsorted(self.segments[order, s], np.arange((1 << self.bits) + 1))
            self.tables.append((order, edges))

    @staticmethod
    def _words(codes: list[bytes], width: int) -> np.ndarray:
        return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in codes), "<u8").reshape(len(codes), width // 8)

    def search(self, queries: list[bytes], k: int) -> Iterator[tuple[int, int, int]]:
        """(query number, id, distance) of each query's k nearest ids among this task's codes."""
        n_segments = self.segments.shape[1]
        q = self._words(queries, self.words.shape[1] * 8)
        q_segments = q.view(self.cell_type).astype(np.int64)
        open_, seen = np.arange(len(q)), [np.empty(0, np.int64)] * len(q)
        for radius in range(self.bits + 1):
            masks = np.array([sum(1 << b for b in bits) for bits in itertools.combinations(range(self.bits), radius)])
            step = max(1, LOOKUPS // len(masks))
            for lo in range(0, len(open_), step):
                part = open_[lo:lo + step]
                hits: list[np.ndarray] = []
                for s, (order, edges) in enumerate(self.tables):
                    cell = q_segments[part, s][:, None] ^ masks[None, :]
                    n = (edges[cell + 1] - edges[cell]).ravel()
                    begin = np.repeat(edges[cell].ravel() - (np.cumsum(n) - n), n)
                    code = order[begin + np.arange(n.sum())]
                    who = np.repeat(np.repeat(np.arange(len(part)), len(masks)), n)
                    hits.append(np.unique(who * len(self.words) + code))
                found = np.unique(np.concatenate(hits))
                for j, codes in zip(part, np.split(found % len(self.words), np.searchsorted(
                        found // len(self.words), np.arange(1, len(part))))):
                    seen[j] = np.union1d(seen[j], codes)
            still = []
            covered = n_segments * (radius + 1) - 1
            for j in open_:
                codes = seen[j]
                distance = np.bitwise_count(self.words[codes] ^ q[j]).sum(axis=1, dtype=np.int64)
                order = np.argsort(distance, kind="stable")
                reach = np.searchsorted(np.cumsum(self.copies[codes[order]]), k)
                kth = distance[order[reach]] if reach < len(order) else math.inf
                if kth > covered and len(codes) < len(self.words):
                    still.append(j)
                    continue
                near = order[distance[order] <= kth]
                best = sorted((int(d), i) for c, d in zip(codes[near], distance[near]) for i in self.ids[c])
                yield from ((int(j), i, d) for d, i in best[:k])
                seen[j] = np.empty(0, np.int64)
            open_ = np.array(still, dtype=np.int64)
            if not len(open_):
                return


def top_k(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest rows of ``codes(id, code)`` to each of ``queries(id, code)``.

    Distances are Hamming distances (a shorter code is padded with zero bits);
    ties go to the smaller id; a query that is a row finds itself. With fewer
    than k ids a query gets them all. Repeated (id, code) rows count once, an
    id with several codes once for each. Either table may be empty: the result
    then is.
    """
    spark = codes.sparkSession
    folded = materialize(fold_copies(codes, k), "folded-codes")
    asked = materialize(queries.select("id", "code").distinct(), "queries")
    n_codes, n_queries = folded.count(), asked.count()
    parts = folded.repartition(max(1, math.ceil(n_codes / CODES_PER_TASK)), "code")
    blocks = max(1, math.ceil(n_queries / QUERY_BLOCK))
    found = []
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id", "code"), F.lit(blocks)) == b)
        rows = [(r.id, bytes(r.code)) for r in block.collect()]

        def search(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            held = [batch for batch in batches if batch.num_rows]
            if not held or not rows:
                return
            index = SegmentIndex([c for x in held for c in x.column("code").to_pylist()],
                                 [i for x in held for i in x.column("ids").to_pylist()])
            hits = pd.DataFrame(index.search([c for _, c in rows], k), columns=["q", "neighbor_id", "distance"])
            hits["query_id"] = np.array([i for i, _ in rows])[hits.q]
            yield pa.RecordBatch.from_pandas(hits[["query_id", "neighbor_id", "distance"]].astype("int64"), preserve_index=False)

        hits = parts.mapInArrow(lean(search), "query_id long, neighbor_id long, distance long")
        found.append(hits if blocks == 1 else materialize(hits, "hits"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "neighbor_id", "distance")
