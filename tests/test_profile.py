"""Exact quartiles, digests, vocabulary and weights against plain computations."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deskflow.operators import profile as P
from deskflow.operators import vectors as V


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [("hot", float(x)) for x in rng.normal(size=3000)] + [("ties", float(x)) for x in rng.integers(0, 3, 500)]
    rows += [("one", 5.0), ("two", 1.0), ("two", 2.0), ("gone", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r.g: r.q for r in P.exact_quantiles(df, "g", "v", shares).collect()}
    assert set(got) == {"hot", "ties", "one", "two"}
    for g, q in got.items():
        assert np.allclose(q, np.quantile([v for h, v in rows if h == g], shares), rtol=1e-12)
    assert P.exact_quantiles(df.limit(0), "g", "v").collect() == []


def test_no_statistic_keeps_all_values_of_a_column(spark, sf_dir):
    from deskflow.sources import fixtures as FX
    df = P.with_engineered(FX.corpus(spark, sf_dir), "instruction")
    for q in (P.describe_features(df), P.boxplot(df, "category", "text_length")):
        assert "percentile" not in q._jdf.queryExecution().optimizedPlan().toString()


def test_correlations_match_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 3))
    x[:, 1] = 1e7 + x[:, 0] * 0.5 + x[:, 1]
    df = spark.createDataFrame([(*map(float, r), 7) for r in x], "a double, b double, c double, k int")
    got = {(r.feature_a, r.feature_b): r.r for r in P.correlation_matrix(df, ["a", "b", "c", "k"]).collect()}
    want = np.corrcoef(x.T)
    for (i, a), (j, b) in ((p, q) for p in enumerate("abc") for q in enumerate("abc") if p[0] > q[0]):
        assert got[a, b] == pytest.approx(want[i, j], abs=2e-6)
    assert all(got["k", c] is None for c in "abc")
    assert P.correlation_matrix(df.limit(0), ["a", "b"]).first().r is None


def test_distinct_texts_by_digest(spark):
    texts = ["a", "b", "a", None, "", "", "é", "a" * 100_000, None, "b"]
    df = spark.createDataFrame([(i, t, "x", str(i % 2)) for i, t in enumerate(texts)], "id long, text string, intent string, category string")
    r = P.uniqueness_ratio(df, "text").first()
    assert (r.total_texts, r.unique_texts, r.verdict) == (10, 5, "WARNING")
    s = P.corpus_summary(df, "text", "intent", "category").first()
    assert (s.total_rows, s.unique_texts, s.num_intents, s.num_categories) == (10, 5, 1, 2)
    assert sorted((r.id, r.text) for r in P.clean_corpus(df, "text", "id").collect()) == [(0, "a"), (1, "b"), (4, ""), (6, "é"), (7, "a" * 100_000)]
    empty = df.limit(0)
    assert P.uniqueness_ratio(empty, "text").first().asDict()["total_texts"] == 0 and P.clean_corpus(empty, "text", "id").collect() == []


@pytest.mark.parametrize("k, min_df, max_df", [(5, 1, 1.0), (20, 2, 0.5), (10_000, 2, 0.9)])
def test_vocabulary(spark, k, min_df, max_df):
    rng = np.random.default_rng(k)
    docs = [[f"w{x}" for x in np.minimum(rng.zipf(1.3, rng.integers(0, 60)), 700)] + ["all"] * int(i % 3 > 0) for i in range(80)]
    lists = spark.createDataFrame(list(enumerate(docs)), "id long, terms array<string>")
    cf, df = Counter(t for d in docs for t in d), Counter(t for d in docs for t in set(d))
    want = sorted((t for t in cf if min_df <= df[t] <= max_df * len(docs)), key=lambda t: (-cf[t], t))[:k]
    got = V.vocabulary(V.term_counts(lists, "id", F.col("terms")), F.lit(float(len(docs))), k, min_df, max_df).collect()
    assert sorted((r.term, r.df, r.idx) for r in got) == [(t, df[t], i) for i, t in enumerate(sorted(want))]


def test_weights(spark):
    docs = [["a", "a", "b"], ["b", "c", "c", "c"], [], ["d"]]
    lists = spark.createDataFrame(list(enumerate(docs)), "id long, terms array<string>")
    tf = V.term_counts(lists, "id", F.col("terms"))
    vocab = V.with_idf(V.vocabulary(tf, F.lit(4.0), 3), F.lit(4.0))
    got = {(r.id, r.term): r.weight for r in V.weigh(tf, "id", vocab, 3, True).collect()}
    df = {"a": 1, "b": 2, "c": 1}
    for i, d in enumerate(docs):
        w = {t: (1 + math.log(n)) * (math.log(5 / (1 + df[t])) + 1) for t, n in Counter(d).items() if t in df}
        norm = math.sqrt(sum(x * x for x in w.values()))
        assert {t: got[i, t] for t in w} == pytest.approx({t: x / norm for t, x in w.items()})
    assert len(got) == 4


def test_label_codes_of_many_values(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else f"v{i * 7 % 200:03d}") for i in range(900)], "id long, c string")
    got = V.label_encode(df, "c").collect()
    values = sorted({r.c or "Unknown" for r in got})
    assert len(got) == 900 and all(r.decoded == (r.c or "Unknown") and values[r.code] == r.decoded for r in got)
