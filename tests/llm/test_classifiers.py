"""Language ID and toxicity: held-out accuracy, folds, bounds and edge cases."""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from deskflow.llm import language, toxicity
from deskflow.llm.common import read_docs


def fold(doc_id, m):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % m


def test_language_held_out(spark, sf_dir):
    docs = read_docs(spark, sf_dir)
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95


def test_language_edges(spark, docs):
    rows = [(i, f"the words of this {i}" if i % 2 else f"les mots de cette {i}", "en" if i % 2 else "fr") for i in range(60)]
    df = docs(*rows, (100, None), (101, ""), (102, "12 345 !?"), (103, "—…"), (None, "the words"), (104, "the " * 50_000),
              (105, "ж" * 70_000), (106, "the words", None), (106, "the words", None)).withColumn("score", F.lit("x"))
    got = language.identify(df, steps=60).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (100, 101, 102, 103))
    assert all(by[i].lang_pred in ("en", "fr") for i in (104, 105, 106, None))
    kept = language.keep_identified(df, steps=60)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == set(by) - {100, 101, 102, 103}
    assert {r.lang for r in kept.collect() if r.doc_id == 106} == {by[106].lang_pred}  # a missing language is filled
    assert all(r.lang == {0: "fr", 1: "en"}[r.doc_id % 2] for r in kept.collect() if r.doc_id is not None and r.doc_id < 60)
    for wanted in ("en", "fr"):  # the model decides
        only = language.keep_identified(df, languages={wanted}, steps=60).collect()
        assert {r.doc_id for r in only} == {i for i, r in by.items() if r.lang_pred == wanted}
    assert language.keep_identified(df, min_score=1.1, steps=60).collect() == []
    assert language.identify(df.limit(0)).collect() == []
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_learns_long_runs(spark, docs):
    rows = [(i, "the words of this" if i % 2 else "的是不我有大在人了中" * 20, "en" if i % 2 else "zh") for i in range(60)]
    df = docs(*rows)
    assert language.fit(df, steps=60).languages == ["en", "zh"]
    assert all(r.lang_pred == ("en" if r.doc_id % 2 else "zh") for r in language.identify(df, steps=60).collect())
    long = "aé的😀" * 100
    parts = language.cut_long(long)
    assert "".join(parts) == long and max(len(p.encode()) for p in parts) <= language.PIECE
    assert language.cut_long("a" * language.LONGEST) == ["a" * language.LONGEST]


def test_language_keeps_letters_without_a_model(spark, docs):
    df = docs((1, "some words", None), (2, "—… 12", None), (3, None, None), (4, "слова", None), (5, "", None))
    assert {r.doc_id for r in language.keep_identified(df).collect()} == {1, 4}


def test_language_positions_and_gradients():
    net = language.ByteBiGru(["a", "b", "c"], hidden=5)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    pieces = np.array([[10, 20, 30, 40], [11, 20, 31, 41]])
    label = np.array([0, 2])
    p = net.positions(pieces)
    assert p.shape == (4, 2, 3) and np.allclose(p.sum(axis=2), 1)
    g = net.gradients(pieces, label)
    loss = lambda: -np.log(net.positions(pieces)[:, np.arange(2), label]).mean()
    for k, grad in g.items():
        for i in np.argsort(-np.abs(grad).ravel())[:3]:
            at = np.unravel_index(i, grad.shape)
            keep = net.w[k][at]
            net.w[k][at] = keep + 1e-5
            up = loss()
            net.w[k][at] = keep - 1e-5
            down = loss()
            net.w[k][at] = keep
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-4 + 0.02 * abs(grad[at])


def test_language_counts_every_occurrence():
    net = language.ByteBiGru(["a", "b"])
    one = lambda w: net.positions(np.frombuffer(w, np.uint8)[None, :]).sum(axis=(0, 1))
    want = 2 * one(b"abc") + one(b"de")
    _, score = language.label_texts(net, pa.array(["ABC, de abc!"]))
    assert abs(score[0].as_py() - want.max() / want.sum()) < 1e-6


def labelled(docs, spark):
    bad = ["wretchword", "vileterm", "nastygram"]
    rows = [(i, " ".join(f"plain{(i * 7 + j) % 90}" for j in range(30)) + (f" {bad[i % 3]} " if i % 4 == 0 else " ")
             + f"tail{i % 9}") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(600)], "doc_id long, toxic int")
    return rows, labels


def test_toxicity_held_out_and_misspelled(spark, docs):
    rows, labels = labelled(docs, spark)
    extra = [(9001, "plain1 plain2 plain3 wretchwrod plain4"), (9002, "plain8 " * 40_000 + " vileterm and " + "plain9 " * 40_000),
             (9003, "plain8 " * 60_000), (9004, None), (9005, ""), (9006, "!!! 123"), (None, "plain1 vileterm plain2"),
             (9007, "plain1 plain2"), (9007, "plain1 plain2")]
    df = docs(*rows, *extra).withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x"))
    got = toxicity.toxicity(df, labels.withColumn("text", F.lit("label text")))
    out = got.collect()
    assert len(out) == df.count()
    by = {r.doc_id: r for r in out}
    assert all(r.held_out == (fold(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    held = [i for i in range(600) if fold(i, 5) == 0]
    assert np.mean([by[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    assert by[9001].predicted and by[9002].predicted and by[None].predicted
    assert not any(by[i].predicted for i in (9003, 9004, 9005, 9006, 9007))


def test_toxicity_without_labels_or_rows(spark, docs):
    rows, labels = labelled(docs, spark)
    df = docs(*rows[:20])
    assert {r.score for r in toxicity.toxicity(df, labels.where("toxic = 0")).collect()} == {0.0}
    assert {r.score for r in toxicity.toxicity(df, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(df.limit(0), labels).collect() == []


def test_windows_against_brute_force():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 3, 6, 7, 20, 0]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    margin = rng.normal(size=bounds[-1])
    best, first = toxicity.window_margins(margin, bounds)
    for i, n in enumerate(sizes):
        m = margin[bounds[i]:bounds[i + 1]]
        w = toxicity.WINDOW
        want = [m[j:j + w].mean() for j in range(max(1, n - w + 1))] if n else [0.0]
        assert abs(best[i] - max(want)) < 1e-12
        assert first[i] == (bounds[i] + int(np.argmax(want)) if n else -1)
