"""Terms counted and weighed in their rows, against the relational form."""

import pytest
from pyspark.sql import functions as F

from deskflow.operators import terms as TM
from deskflow.operators import vectors as V
from deskflow.plans import queries

TEXTS = [None, "", "a b c", "Be be, not2be ... to be", "ends with", "with starts", "ünï cödé KKelvin İs it", "x" * 5 + "9" + "yy",
         "to be to be to be", "be\nto\tbe", "  ", "with starts with"]


@pytest.mark.parametrize("rows", [3, 10_000])
def test_terms_of_a_row_are_the_relational_ones(spark, monkeypatch, rows):
    monkeypatch.setattr(TM, "TEXT_ROWS", rows)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    tf = V.term_counts(docs, "id", V.ngram_terms, V.clean_tokens("text"))
    want = {r.term: (r.df, r.cf) for r in tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).collect()}
    assert len(want) > 15
    for tokens in ("text", V.clean_tokens("text")):
        assert {r.term: (r.df, r.cf) for r in TM.statistics(docs, tokens, 2).collect()} == want
    vocab = V.with_idf(V.vocabulary(tf, F.lit(float(len(TEXTS))), 9), F.lit(float(len(TEXTS)))).checkpoint()
    for tokens in ("text", V.clean_tokens("text")):
        for sublinear in (True, False):
            old = {(r.id, r.term): r.weight for r in V.weigh(tf, "id", vocab, 9, sublinear).collect()}
            new = {(r.id, r.term): r.weight for r in TM.weight_rows(docs, "id", tokens, vocab, 2, sublinear).collect()}
            assert old.keys() == new.keys() and all(abs(old[k] - new[k]) < 1e-12 for k in old)
    lists = TM.weight_arrays(docs, "text", vocab, 2, True).collect()
    assert {r.id: len(r.indices) for r in lists} == {i: sum(k[0] == i for k in old) for i in range(len(TEXTS))}
    assert all(r.indices == sorted(r.indices) for r in lists)


def test_documents_do_not_shuffle_their_terms(spark, sf_dir):
    for name in ("tfidf_weights", "tfidf_stopwords"):
        plan = queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan, name


def test_texts_of_one_file_are_spread_over_the_cores(spark, sf_dir):
    one = spark.read.parquet(f"{sf_dir}/events.parquet").coalesce(1)
    assert TM.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = one.repartition(spark.sparkContext.defaultParallelism + 1)
    assert TM.spread(wide) is wide


def test_only_pairs_of_frequent_words_are_counted(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS * 2 + ["to to be", "seldom seen", "starts with to be"])], "id long, text string").repartition(3)
    n = F.lit(float(docs.count()))
    every = {r.term: (r.df, r.cf) for r in TM.statistics(docs, "text", 2).collect()}
    for most in (1, 2, 3, 4, 5, 500):
        for limit in (100, 0):
            found = TM.frequent(docs, "text", most, 2, F.lit(0.5) * n, limit)
            kept = {r.term: (r.df, r.cf) for r in found.collect()}
            assert len(kept) == found.count() and kept.items() <= every.items()
            want, got = ({(r.term, r.idx) for r in V.most_counted(stats, n, most, 2, 0.5).collect()} for stats in (TM.statistics(docs, "text", 2), found))
            assert got == want
            assert ("seldom seen" in kept) == (limit == 0 or most == 500), (most, limit)  # of words that occur once
