"""Language-model scores: exact base scores, a proper distribution, better than the base on held-out texts."""

import collections
import math
import os
import zlib

import numpy as np
from pyspark.sql import functions as F

from deskflow.llm import lm
from deskflow.llm.common import read_docs

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text):
    return (text or "").encode().translate(LOWER).split() + [b""]


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def check_base(rows, got):
    counts = collections.Counter()
    for r in rows:
        if not held(r.doc_id):
            counts.update(tokens(r.text))
    n, v = sum(counts.values()), len(counts)
    want = sorted(((r.doc_id, held(r.doc_id), len(tokens(r.text)), sum(counts[w] > 0 for w in tokens(r.text)), n,
                    round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r.text)), 6)) for r in rows), key=repr)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr)
    assert have == want


def test_documents(spark, sf_dir):
    docs = read_docs(spark, sf_dir)
    got = lm.score_documents(docs).collect()
    check_base(docs.select("doc_id", "text").collect(), got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert all(r.score <= 0 and math.isfinite(r.score) for r in got)


def test_edges(spark, docs):
    df = docs((1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " \x0b "), (None, "a B\tc"), (5, "x" * 200_000), (6, "a " * 20_000))
    df = df.withColumn("score", F.lit(1)).withColumn("chunk", F.lit("x")).withColumn("c", F.lit(2))
    got = lm.score_documents(df).collect()
    check_base(df.select("doc_id", "text").collect(), got)
    assert lm.score_documents(df.limit(0)).collect() == []
    only_held = df.where("doc_id is not null").withColumn("doc_id", F.lit(next(i for i in range(99) if held(i))).cast("long"))
    assert {(r.base_score, r.score, r.n_known) for r in lm.score_documents(only_held).collect()} == {(0.0, 0.0, 0)}


def test_probabilities_sum_to_one_and_state_is_carried():
    rng = np.random.default_rng(0)
    net = lm.ClassGru(70)
    net.start_from(rng.integers(5, 900, 70).astype(float), np.where(np.arange(lm.BANDS) < 9, 40.0, 0.0))
    states = rng.normal(0, 1, (3, lm.HIDDEN)).astype(np.float32)
    every = np.arange(70 + lm.BANDS)
    for s in states:
        ln, _ = net.log_probability(np.repeat(s[None], len(every), axis=0), every)
        assert abs(np.exp(ln.astype(float)).sum() - 1) < 1e-4
    # windows of one document give what one pass over it gives, in any company
    doc = rng.integers(0, 70 + 9, 300)
    other = rng.integers(0, 70 + 9, 40)
    both = net.score(np.concatenate([other, doc]), np.array([0, 40, 340]))
    alone = net.score(doc, np.array([0, 300]))
    state, previous, ln = np.zeros((1, lm.HIDDEN), np.float32), np.array([net.symbols - 1]), 0.0
    for x in doc:
        state, _ = lm.gru.forward(net.w["x"][previous], state, net.w["u"])
        ln += float(net.log_probability(state, np.array([x]))[0][0])
        previous = np.array([x])
    assert abs(alone[0] - ln) < 1e-2 and abs(both[1] - ln) < 1e-2


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    net = lm.ClassGru(40)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    target = rng.integers(0, 44, (2, 5))
    seen = {}

    def loss():
        state, previous, total = np.zeros((2, lm.HIDDEN)), np.full(2, net.symbols - 1), 0.0
        states = []
        for t in range(5):
            state, _ = lm.gru.forward(net.w["x"][previous], state, net.w["u"])
            states.append(state)
            previous = target[:, t]
        return -float(net.log_probability(np.concatenate(states), target.T.ravel())[0].mean())

    class Probe(lm.Trainer):
        pass
    probe = Probe(net, 0.0)
    real = {k: v.copy() for k, v in net.w.items()}
    probe.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}
    probe._window(target, np.zeros((2, 5), bool), np.zeros((2, lm.HIDDEN)), np.full(2, net.symbols - 1))
    for k in ("u", "x", "class", "word"):
        seen[k] = probe.moments[k][0] / 0.1
        net.w[k] = real[k]
    for k in ("u", "class", "x", "word"):
        flat = np.argsort(-np.abs(seen[k]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, net.w[k].shape)
            keep = net.w[k][at]
            net.w[k][at] = keep + 1e-5
            up = loss()
            net.w[k][at] = keep - 1e-5
            down = loss()
            net.w[k][at] = keep
            assert abs((up - down) / 2e-5 - seen[k][at]) < 1e-4 + 0.02 * abs(seen[k][at])


def test_averaging_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 3)
    rows = [(t, t + 1, (np.arange(4.0) * t * (t + 1)).tobytes()) for t in range(11)]
    df = spark.createDataFrame(rows, "task long, seen long, packed binary")
    want = sum(np.frombuffer(p) for _, _, p in rows) / sum(s for _, s, _ in rows)
    assert np.allclose(lm.average(df, 11), want)


def test_every_training_document_gives_gradient_steps(spark, docs):
    # each id alone: one training document moves the network, whichever it is
    for i in [i for i in range(12) if not held(i)][:3]:
        df = docs((i, "a b c d " * 100), (next(j for j in range(99) if held(j)), "a b c d a b c d"))
        score = {rounds: {r.doc_id: r.score for r in lm.score_documents(df, rounds=rounds).collect()}[i] for rounds in (0, 1)}
        assert score[1] > score[0] + 1


def test_last_symbols_of_a_lesson_are_learned():
    net = lm.ClassGru(70)
    trainer = lm.Trainer(net, 0.02)
    symbols, ends = np.zeros(100, dtype=np.int64), np.zeros(100, bool)  # three lanes of 33 symbols and one more
    symbols[-1], ends[-1] = 40, True  # the only word of its class
    before = net.w["word"].copy()
    trainer.train(symbols, ends)
    assert trainer.seen == 100
    assert (net.w["word"][32:64] != before[32:64]).any() and (net.w["word"][64:] == before[64:]).all()


def test_stored_tables_are_smaller_than_the_texts(spark, docs, monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{i * 7919 % 99991}" for i in np.minimum(rng.zipf(1.3, 800), 60_000)) for _ in range(150)]
    kept, write = {}, lm.materialize

    def noted(df, name):
        out = write(df, name)
        kept[name] = sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(lm, "materialize", noted)
    lm.score_documents(docs(*enumerate(texts)).coalesce(1), rounds=0).count()
    assert kept.keys() == {"lm-chunks", "lm-lexicon", "lm-coded"}
    assert sum(kept.values()) < 0.75 * sum(map(len, texts))


def test_counts_come_back_to_every_chunk(spark, docs, monkeypatch):
    # many chunks and parts, a word in every one, words of one chunk only, words never learned
    monkeypatch.setattr(lm, "CHUNK_BYTES", 400)
    monkeypatch.setattr(lm, "PART_CHUNKS", 1)
    monkeypatch.setattr(lm, "HEAD", 32)
    df = docs(*((i, f"common {'x' * (i % 5)} rare{i} rare{i // 3} " + "b cé " * (i % 4)) for i in range(120)))
    check_base(df.select("doc_id", "text").collect(), lm.score_documents(df, rounds=0).collect())


def test_numbers_come_back_from_their_packed_forms():
    for x in ([], [0], [3, 255], [256, 7, 65536], [2**32 - 1, 0, 1]):
        x = np.array(x, np.int64)
        assert lm.unsqueeze(lm.squeeze(x), len(x)).tolist() == x.tolist() == lm.widen(lm.narrow(x), len(x)).tolist()
    assert lm.widen(lm.narrow(np.array([2**40, 1])), 2).tolist() == [2**40, 1]


def test_columns_of_sequences_step_as_rows_do():
    rng = np.random.default_rng(2)
    n, h, width = 6, 5, 7
    x, u = rng.normal(0, 1, (n, width, 3 * h)), rng.normal(0, 1, (h, 3 * h))
    state, goes_on, d = rng.normal(0, 1, (width, h)), (rng.random((n, width)) > 0.3).astype(float), rng.normal(0, 1, (n, width, h))
    after, last, kept = lm.gru.steps(np.ascontiguousarray(x.transpose(0, 2, 1)), state.T, u, goes_on)
    d_inputs, d_u = lm.gru.steps_back(np.ascontiguousarray(d.transpose(0, 2, 1)), kept, u, goes_on)
    saved = []
    for t in range(n):
        state, keep = lm.gru.forward(x[t], state, u)
        saved.append(keep)
        assert np.allclose(after[t].T, state)
        state = state * goes_on[t][:, None]
    assert np.allclose(last.T, state)
    back, want_u = np.zeros((width, h)), 0
    for t in range(n - 1, -1, -1):
        back, d_in, part = lm.gru.backward(back * goes_on[t][:, None] + d[t], saved[t], u)
        want_u = want_u + part
        assert np.allclose(d_inputs[t].T, d_in)
    assert np.allclose(d_u, want_u)
