"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskflow.llm import lexical
from deskflow.llm.common import read_docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(documents, items, k):
    rows = [(i, Counter(t), len(t)) for i, t in ((i, terms(t)) for i, t in documents) if t]
    n_docs, total = len(rows), sum(n for *_, n in rows)
    df = Counter(t for _, c, _ in rows for t in c)
    held = {}
    for item, text in items:
        held.setdefault(item, set()).update(terms(text))
    out = []
    for item, words in held.items():
        scored = []
        for doc, counts, n in rows:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
                    for t in words if t in counts)
            if s > 0:
                scored.append((-s, doc is not None, doc or 0, doc))
        out += [(item, r, doc, -s) for r, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.fixture
def items(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), "item_id long, text string")
    return make


def test_whole_tables(spark, sf_dir):
    d, b = read_docs(spark, sf_dir), read_docs(spark, sf_dir, "benchmark")
    want = brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()], 10)
    assert found(lexical.search(d, b, 10)) == want


def test_edges_and_ties(spark, docs, items, monkeypatch):
    rows = [(i, "alpha beta gamma") for i in range(40, 0, -1)] + [(100 + i, "alpha " * (i + 1)) for i in range(25)]
    rows += [(1000, None), (1001, ""), (1002, "... --"), (None, "alpha beta gamma"), (None, "Alpha"), (5, "alpha beta gamma"), (5, "alpha beta gamma"),
             (1003, "ÀB àb x1 X1 汉字 ünder_score"), (1004, "word " * 60_000 + "alpha"), (1005, "z" * 300_000), (1006, "ÀB")]
    queries = [(1, "Alpha, BETA"), (2, "beta beta gamma"), (3, None), (4, ""), (5, "nowhere"), (6, "Àb X1 汉字 under score"), (7, "?!"), (8, "alpha"),
               (8, "x1"), (None, "gamma"), (1, "Alpha, BETA"), (9, "ZZ ab ÀB word")]
    df = docs(*rows).repartition(7, "doc_id").withColumn("score", F.lit("x")).withColumn("item", F.lit("x"))
    q = items(*queries).withColumn("rank", F.lit("x")).withColumn("doc_id", F.lit(3))
    want = brute(rows, queries, 10)
    assert found(lexical.search(df, q, 10)) == want
    assert found(lexical.search(df, q, 1)) == brute(rows, queries, 1)
    assert found(lexical.search(df.limit(0), q)) == [] and found(lexical.search(df, q.limit(0))) == []
    monkeypatch.setattr(lexical, "BLOCK_CHARS", 12)  # several blocks of items
    assert found(lexical.search(df, q, 10)) == want


def test_tiles_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    scores = rng.integers(0, 6, (5, 300))
    ids = rng.permutation(300) // 2
    null = rng.random(300) < 0.05
    want = [sorted(zip(-s, ~null, np.where(null, 0, ids)))[:7] for s in scores]
    for tile in (1, 3, 64, 300):
        r = lexical.Ranking(5, 7)
        for low in range(0, 300, tile):
            r.add(slice(0, 5), scores[:, low:low + tile], np.where(null, 0, ids)[low:low + tile], null[low:low + tile])
        got = [list(zip(-r.score[i], ~r.null[i], r.doc[i])) for i in range(5)]
        assert got == want


def test_partial_sums_stay_exact():
    weight = np.array([30_000] * 400_000 + [1], dtype=np.int64)
    tiles = lexical.term_tiles(weight, most=10**9)
    assert tiles[0][0] == 0 and tiles[-1][1] == len(weight) and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:]))
    assert all(int(weight[a:b].sum()) * lexical.MOST_IMPACT < lexical.EXACT for a, b in tiles) and len(tiles) == 2
    assert all(b - a <= 4096 for a, b in lexical.term_tiles(weight))
    assert int(lexical.impacts(np.array([10**6]), np.array([10]))[0]) <= lexical.MOST_IMPACT
    with pytest.raises(OverflowError):
        lexical.term_tiles(np.array([1 << 40]))
