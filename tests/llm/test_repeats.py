"""Removal of repeated strings: corpus order and whole operator against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deskflow.llm import repeats
from deskflow.llm.common import read_docs
from deskflow.llm.q_corpus import op12_suffix_array_dedup


def brute(rows, length):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(b[p:p + length]) for _, b in texts for p in range(len(b) - length + 1))
    maybe = Counter(b[p:p + length] for _, b in texts for p in range(len(b) - length + 1) if seen[hash(b[p:p + length])] > 1)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b) + 1, np.int8)
        for p in range(len(b) - length + 1):
            if maybe.get(b[p:p + length], 0) > 1:
                gone[p:p + length] = 1
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digests(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=repr)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.binary(min_size=5, max_size=40).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6), st.sampled_from([1, 2, 4]),
       st.sampled_from([1, 2, 5, 50]))
def test_corpus_order_is_the_suffix_array(strings, gram, step):
    starts = np.array([len(s) - 4 for s in strings])
    which, place = repeats.corpus_order(strings, starts, gram, step)
    got = [strings[j][p:] for j, p in zip(which.tolist(), place.tolist())]
    assert got == sorted(s[p:] for s, n in zip(strings, starts.tolist()) for p in range(n))
    classes = repeats.equal_classes(strings, starts, 5)
    cut = [s[p:p + 5] for s, n in zip(strings, starts.tolist()) for p in range(n)]
    assert len(set(zip(classes.tolist(), cut))) == len(set(cut)) == len(set(classes.tolist()))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 2 for x in b)), max_size=5), st.sampled_from([(12, 7, 4), (12, 1, 4), (20, 12, 8), (8, 8, 1)]))
def test_every_start_has_one_trigger_that_its_string_decides(texts, how):
    length, span, gram = how
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.cumsum([0] + [len(t) for t in texts])
    text, trigger, first, last = repeats.records(data, bounds, length, span, gram)
    found = {}
    for i, t, a, b in zip(text.tolist(), trigger.tolist(), first.tolist(), last.tolist()):
        for p in range(a, b + 1):
            assert bounds[i] <= p and p + length <= bounds[i + 1] and 0 <= t - p < span
            assert found.setdefault(data[p:p + length].tobytes(), t - p) == t - p
    assert sum((last - first + 1).tolist()) == sum(max(0, len(t) - length + 1) for t in texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.binary(max_size=9).map(lambda b: bytes(x % 2 for x in b))), min_size=1, max_size=8), st.integers(0, 9))
def test_agreement_is_the_longest_with_any_other(rows, most):
    rows.sort(key=lambda r: r[0])
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    want = [max([0, *(min(most, common(p, q)) for j, (h, q) in enumerate(rows) if j != i and h == g)]) for i, (g, p) in enumerate(rows)]
    assert repeats.agreement([p for _, p in rows], np.array([g for g, _ in rows]), most).tolist() == want


def test_long_texts_are_hashed_in_chunks(monkeypatch):
    rng = np.random.default_rng(1)
    data, bounds = rng.integers(0, 4, 5000).astype(np.uint8), np.array([0, 1700, 1700, 5000])
    want = repeats.records(data, bounds, 30, 18, 8)
    monkeypatch.setattr(repeats, "CHUNK", 97)
    assert all(np.array_equal(a, b) for a, b in zip(want, repeats.records(data, bounds, 30, 18, 8)))


def mixed(seed, n, length):
    """Random texts that share passages of about ``length`` bytes, at their edges too."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randrange(1, 6)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(length // 2)[:length + d] for d in (-1, 0, 1, 5, 40, 3 * length)]
    out = []
    for i in range(n):
        parts = [prose(r.randrange(0, 30))]
        for _ in range(r.randrange(0, 3)):
            p = r.choice(passages)
            parts += [p if r.random() < 0.6 else p[r.randrange(0, 9):], prose(r.randrange(0, 12))]
        out.append((i, "".join(parts)))
    return out


@pytest.mark.parametrize("entries", [2048, 1])  # with 1, every key with two entries is dealt over shares
def test_brute_force(spark, docs, monkeypatch, entries):
    monkeypatch.setattr(repeats, "ENTRIES", entries)
    monkeypatch.setattr(repeats, "ORDER_BYTES", 500)
    rows = mixed(entries, 120, 24)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 40, 4)] + [(2000, "a" * 500), (2001, "ab" * 100), (2002, "abc" * 9), (2003, "x" + "a" * 23)]
    got = digests(repeats.removal_digests(docs(*rows).repartition(5, "doc_id"), length=24, span=12))
    assert got == brute(rows, 24)
    assert sum(r[2] > 0 for r in got) > 40 and sum(r[2] == 0 for r in got) > 10


def test_edges(spark, docs):
    long = "".join(random.Random(5).choices("abcdefgh ", k=300_000))
    rows = [(1, None), (2, ""), (3, "short"), (4, long), (5, long[1000:1400] + "!"), (6, long[2000:2399]), (7, "é" * 300), (8, "z" * 400), (9, "z" * 401 + "y"),
            (None, long[5000:5500]), (None, None), (10, "twice " * 200), (10, "twice " * 200), (11, long[-400:]), (12, "1" + long[:400])]
    df = docs(*rows).withColumn("text_hash", F.lit("clash")).withColumn("key", F.lit("clash"))
    assert digests(repeats.removal_digests(df)) == brute(rows, 400)
    cut = {r.doc_id: r for r in repeats.cut_documents(df).collect()}
    assert bytes(cut[5].kept) == b"!" and [(s.start, s.end) for s in cut[5].spans] == [(0, 400)] and 6 not in cut
    assert [(s.start, s.end) for s in cut[4].spans] == [(0, 400), (1000, 1400), (5000, 5500), (299_600, 300_000)]
    assert repeats.removal_digests(df.limit(0)).collect() == []


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in read_docs(spark, sf_dir).collect()]
    assert digests(op12_suffix_array_dedup(spark, sf_dir)) == brute(rows, 400)
