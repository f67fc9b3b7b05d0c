"""Contaminated documents against a brute-force scan of all windows."""

from collections import Counter

from pyspark.sql import functions as F

from deskflow.llm import decontaminate as D
from deskflow.llm.common import read_docs

ITEM = ("the quick brown fox jumps over the lazy dog while seven wizards quietly boil strange potions near "
        "an old mill and nobody dares to ask them why the water turned blue last winter")


def brute(docs, items, threshold=0.8):
    out = set()
    shingles = lambda w, s: [tuple(w[i:i + s]) for i in range(len(w) - s + 1)]
    for d in docs:
        words = D.words_of(d.text or "")
        for item in items:
            want = D.words_of(item.text or "")
            if not want:
                continue
            size = min(5, len(want))
            there, here = Counter(shingles(want, size)), shingles(words, size)
            k = min(len(want) - size + 1, len(here))
            best = 0.0
            for i in range(len(here) - k + 1 if k > 0 else 0):
                shared = (Counter(here[i:i + k]) & there).total()
                best = max(best, shared / (k + there.total() - shared))
            if best >= threshold:
                out.add((d.doc_id, item.item_id, round(best, 9)))
    return out


def check(docs, bench):
    got = D.contaminated(docs, bench).collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in got} == brute(docs.collect(), bench.collect())
    return got


def test_documents(spark, sf_dir):
    docs, bench = read_docs(spark, sf_dir), read_docs(spark, sf_dir, "benchmark")
    got = check(docs, bench)
    hit = {r.doc_id for r in got}
    kept = D.clean(docs, bench)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - hit


def test_edges(spark, docs):
    bench = spark.createDataFrame([(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "two words"), (6, "...")],
                                  "item_id long, text string")
    words = ITEM.split()
    one_off = " ".join(["begin"] + words[:20] + ["changed"] + words[21:] + ["end"])
    cut = " ".join(words[:len(words) // 2])
    upper = "Intro text. " + ITEM.upper() + "!! and more"
    df = docs((1, "before " + ITEM + " after"), (2, one_off), (3, cut), (4, upper), (5, None), (6, ""), (7, "two, words"),
              (8, "two"), (None, ITEM), (1, "before " + ITEM + " after"), (9, ("filler text here " * 30000) + ITEM),
              (10, (ITEM + " ") * 3)).withColumn("item_id", F.lit(7)).withColumn("similarity", F.lit("x"))
    got = check(df, bench)
    assert {r.doc_id for r in got} >= {1, 4, 7, 9, 10, None} and not {3, 5, 6, 8} & {r.doc_id for r in got}
    assert len([r for r in got if r.doc_id == 1]) == 4  # two rows, two equal items
    kept = D.clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(
        {2, 3, 5, 6, 8} - {r.doc_id for r in got})
    assert D.contaminated(df.limit(0), bench).collect() == [] and D.contaminated(df, bench.limit(0)).collect() == []
    assert D.clean(df, bench.limit(0)).count() == df.count()


def test_benchmark_in_blocks_gives_the_same(spark, docs, monkeypatch):
    items = [(i, f"item {i} " + " ".join(f"word{(i * 7 + j) % 50}" for j in range(20))) for i in range(40)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = docs(*[(i, "some text " + t + " tail") for i, t in items[::3]])
    whole = sorted(map(tuple, D.contaminated(df, bench).collect()))
    monkeypatch.setattr(D, "BLOCK_CHARS", 800)
    assert sorted(map(tuple, D.contaminated(df, bench).collect())) == whole


def test_multi_index_finds_everything_in_the_radius():
    import numpy as np
    rng = np.random.default_rng(1)
    near = np.array([[bin(a ^ b).count("1") <= D.BLOCK_RADIUS for b in range(256)] for a in range(256)])
    prints = rng.integers(0, 256, (300, 8), dtype=np.uint8)
    masks = np.stack([near[:, prints[:, b]] for b in range(8)])
    for _ in range(300):
        i = rng.integers(300)
        q = prints[i:i + 1].view("<u8").copy()
        for bit in rng.choice(64, D.RADIUS, replace=False):
            q ^= np.uint64(1) << np.uint64(bit)
        bytes_ = q.view(np.uint8).ravel()
        assert any(masks[b][bytes_[b]][i] for b in range(8))
