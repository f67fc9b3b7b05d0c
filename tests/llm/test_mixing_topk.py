"""Raking and exact search against plain brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskflow.llm import mixing, topk
from deskflow.llm.q_corpus import ORACLE, QUERIES, MIX
from oracle_check import compare, duck_connect, schema_diff


def test_queries_with_sql(spark, sf_dir):
    for name in ("op7_mixing", "op10_topk_hamming"):
        q = QUERIES[name](spark, sf_dir)
        rel = duck_connect(sf_dir).sql(ORACLE[name])
        assert compare(q.toPandas(), rel.df()) is None, name
        assert not schema_diff(q.dtypes, rel.columns, [str(t) for t in rel.types])


def test_rake_fits_given_targets(spark):
    rows = [(s, l, t, (i * 37) % 400 + 1) for i, (s, l, t) in enumerate(
        (s, l, t) for s in ("a", "b", None) for l in ("en", "fr") for t in ("x", "y"))] + [("gone", "en", "x", 0), ("extra", "en", "x", 5)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    share = lambda pairs: spark.createDataFrame(pairs, "value string, share double")
    targets = {"source": share([("a", 5.0), ("b", 3.0), (None, 2.0), ("never", 9.0), ("gone", 4.0)]),
               "lang": share([("en", 0.25), ("fr", 0.75)]), "topic": share([("x", 1.0), ("y", 1.0)])}
    got = mixing.rake(cells, targets, rounds=30).collect()
    total = sum(r.tokens for r in got)
    assert len(got) == len(rows)
    for d, want in (("source", {"a": 0.5, "b": 0.3, None: 0.2, "extra": 0.0, "gone": 0.0}), ("lang", {"en": 0.25, "fr": 0.75}),
                    ("topic", {"x": 0.5, "y": 0.5})):
        for v, w in want.items():
            assert abs(sum(r.factor * r.tokens for r in got if r[d] == v) / total - w) < 1e-6, (d, v)


def test_mixing_edges(spark, docs):
    df = docs(*[(i, f"some words {i} " * (i % 9 + 1), "en" if i % 3 else "fr", f"src{i % 4}") for i in range(200)],
              (900, None), (901, ""), (None, "no id"), (902, "text", None, None), (903, "long " * 90_000), (7, "repeated"), (7, "repeated"))
    df = df.withColumn("topic", F.lit("mine")).withColumn("factor", F.lit(3)).withColumn("_w", F.lit(1))
    plan = mixing.sample_plan(df, **MIX).collect()
    assert len(plan) == df.count()
    assert all(0 <= r.keep_prob <= 1 and (r.weight >= 1 or r.keep_prob == 0) for r in plan)
    assert all(not r.sampled for r in plan if r.doc_id in (900, 901))
    kept = mixing.sample(df, **MIX)
    assert kept.columns == df.columns
    bounded = mixing.mixed(df, **MIX, weighted=False).collect()
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in bounded if r._mix_sampled)
    assert all(r._mix_weight in (0.0, 1.0) or abs(r._mix_weight - 1) < 1e-9 for r in bounded)
    assert mixing.sample_plan(df.limit(0), **MIX).collect() == []
    python = mixing.sample_plan(df, **MIX)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in python and "Arrow" not in python


def test_a_sample_without_weights_meets_its_targets(spark, docs):
    """Small sources are wanted more than their documents give at once: the expected tokens fit all the same."""
    rows = [(i, "w " * (70 + i % 50), ("en", "fr")[i % 2], "big" if i % 20 else "small") for i in range(2000)]
    df = docs(*rows)
    share = lambda pairs: spark.createDataFrame(pairs, "value string, share double")
    targets = {"source": share([("big", 0.92), ("small", 0.08)]), "lang": share([("en", 0.4), ("fr", 0.6)]), "topic": share([("prose", 1.0)])}
    shares = {}
    for weighted in (True, False):
        got = mixing.mixed(df, targets=targets, keep=0.5, weighted=weighted, rounds=30).collect()
        total = sum(r._mix_keep * r._mix_tokens for r in got)
        shares[weighted] = {v: sum(r._mix_keep * r._mix_tokens for r in got if v in (r.source, r.lang)) / total for v in ("small", "big", "en", "fr")}
    assert shares[False] == pytest.approx({"small": 0.08, "big": 0.92, "en": 0.4, "fr": 0.6}, abs=2e-3)
    kept = mixing.sample(df, targets=targets, keep=0.5, rounds=30).collect()
    assert abs(sum(r.source == "small" for r in kept) / len(kept) - 0.08) < 0.02


def brute_top(codes, queries, k):
    out = set()
    for qi, q in queries:
        best = sorted((bin(int.from_bytes(q, "little") ^ int.from_bytes(c, "little")).count("1"), i) for i, c in codes)[:k]
        out |= {(qi, n + 1, i, d) for n, (d, i) in enumerate(best)}
    return out


def test_search_is_exact(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 256, (5, 16), dtype=np.uint8)
    rows = []
    for i in range(900):
        c = centres[i % 5].copy()
        for b in rng.choice(128, int(rng.integers(0, 50)), replace=False):
            c[b // 8] ^= 1 << (b % 8)
        rows.append((int(i), c.tobytes()))
    rows += [(2000 + i, centres[0].tobytes()) for i in range(400)] + [(5, rows[5][1])]
    codes = spark.createDataFrame(rows, "id long, code binary").withColumn("n", F.lit(1)).repartition(6)
    queries = codes.where("id % 100 = 0")
    unique = sorted(set(rows))
    want = brute_top(unique, [r for r in unique if r[0] % 100 == 0], 7)
    monkeypatch.setattr(topk, "CODES_PER_TASK", 300)
    for many, block in ((1, 1 << 16), (1 << 13, 5)):
        monkeypatch.setattr(topk, "MANY_CODES", many)
        monkeypatch.setattr(topk, "QUERY_BLOCK", block)
        assert {tuple(r) for r in topk.top_k(codes, queries, 7).collect()} == want


def test_search_edges(spark):
    rows = [(0, [1.0, -1.0, 0.0]), (1, None), (2, []), (None, [1.0, 1.0, 1.0]), (3, [None, float("nan"), 2.0]), (100, [1.0, -1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(4))
    codes = topk.sign_codes(df, "vec_id", "embedding")
    assert {(r.id, bytes(r.code)) for r in codes.collect()} == {(0, b"\1"), (3, b"\4"), (100, b"\1")}
    got = {tuple(r) for r in topk.top_k(codes, codes.where("id % 100 = 0"), 10).collect()}
    assert got == brute_top([(0, b"\1"), (3, b"\4"), (100, b"\1")], [(0, b"\1"), (100, b"\1")], 10)
    assert topk.top_k(codes.limit(0), codes, 3).collect() == [] and topk.top_k(codes, codes.limit(0), 3).collect() == []
