"""Near-duplicates against brute force over all pairs of fingerprints."""

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from deskflow.llm import simhash_dedup as S
from deskflow.llm.common import read_docs


def slow_fingerprint(text, shingle=4):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ")
             .replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    """Component number of each fingerprint, by comparing all pairs."""
    keys = sorted(set(fps))
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return [root(f) for f in fps]


def check(df, shingle=4, radius=4):
    rows = df.select("doc_id", "text").collect()
    got = sorted(S.near_duplicates(df, shingle, radius).collect(), key=repr)
    fps = [slow_fingerprint(r.text, shingle) for r in rows]
    parts = slow_components(fps, radius)
    least = {}
    for r, p in zip(rows, parts):
        if r.doc_id is not None:
            least[p] = min(least.get(p, r.doc_id), r.doc_id)
    want = sorted(((r.doc_id, f"{f:016x}", least.get(p)) for r, f, p in zip(rows, fps, parts)), key=repr)
    assert sorted([tuple(r) for r in got], key=repr) == sorted(want, key=repr)


def test_fingerprint_is_spark_xxhash64(spark):
    text = "One two\tTHREE four é five"
    spark_hash = spark.sql("select xxhash64('one two three four') h").first().h & (2 ** 64 - 1)
    assert xxhash.xxh64_intdigest("one two three four", 42) == spark_hash
    assert S.fingerprint(text.encode()) == slow_fingerprint(text)
    assert S.fingerprint(b"one two") == xxhash.xxh64_intdigest("one two", 42)
    assert S.fingerprint(b" \n ") == 0
    long = " ".join(f"w{i % 97}" for i in range(3000))
    assert S.fingerprint(long.encode()) == slow_fingerprint(long)


def test_ball_sizes():
    assert len(S.ball(0)) == 1 and len(S.ball(1)) == 65
    masks = S.ball(2)
    assert len(masks) == len(np.unique(masks)) == 2081
    assert int(np.bitwise_count(masks).max()) == 2


def test_links_span_all_pairs_within_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2 ** 64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:12].tolist():  # chains of near fingerprints at every distance up to 6
        for d in range(1, 7):
            for _ in range(6):
                x = b
                for bit in rng.choice(64, d, replace=False):
                    x ^= 1 << int(bit)
                fps.add(x)
    signed = [x - 2 ** 64 if x >= 2 ** 63 else x for x in sorted(fps)]
    df = spark.createDataFrame([(x,) for x in signed], "fp long").repartition(5)
    links = [(r.a & (2 ** 64 - 1), r.b & (2 ** 64 - 1)) for r in S.ball_links(df, 4).collect()]
    assert all(bin(a ^ b).count("1") <= 4 for a, b in links)
    keys = sorted(fps)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    ours, brute = [root(k) for k in keys], slow_components(keys)
    assert len(set(zip(ours, brute))) == len(set(ours)) == len(set(brute))


def test_stranger_with_the_same_key_loses_no_link():
    """Owners of two different variants under one key: both groups stay linked."""
    a, b = 0, (1 << 63) | (1 << 40) | (1 << 20) | (1 << 10) | (1 << 5) | 1
    owners = np.array([a, a ^ 2, a ^ 4, b, b ^ 2], dtype=np.uint64)
    order = np.arange(5, dtype=np.uint64)  # one key for all, positions 0..4
    links = {tuple(sorted(map(int, x))) for x in S._meet(order, owners, 3, 4)}
    assert (0, 2) in links and (0, 4) in links and tuple(sorted((b, b ^ 2))) in links
    assert all(bin(x ^ y).count("1") <= 4 for x, y in links)


def test_documents_against_brute_force(spark, sf_dir):
    check(read_docs(spark, sf_dir))


def test_edge_cases(spark, docs):
    words = " ".join(f"word{i}" for i in range(400))
    near = words.replace("word7 ", "other ")
    df = docs((5, words), (3, words), (3, words), (9, near), (None, words), (11, None), (12, ""), (13, " \t\n"),
              (14, "one"), (15, "ONE"), (None, None), (16, words * 200))
    check(df.withColumn("fp", F.lit(1)).withColumn("component", F.lit("x")))
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows) == [3, 11, 14]  # 16 repeats the text: the same fingerprint
    assert S.near_duplicates(df.limit(0)).collect() == [] and S.keep_one(df.limit(0)).collect() == []


def test_null_ids_only(spark, docs):
    df = docs((None, "a b c d e"), (None, "a b c d e"), (None, "other words in here now"))
    assert [r.component_id for r in S.near_duplicates(df).collect()] == [None] * 3
    assert S.keep_one(df).count() == 2


def test_wide_group_of_near_copies(spark, docs):
    """A third of all rows around one text: links stay few, one component."""
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(200):
        w = list(words)
        w[i % 300] = f"x{i}"
        rows.append((i, " ".join(w)))
    check(docs(*rows, *[(1000 + i, f"alone {i} " * 9) for i in range(50)]))


def test_bytes_a_variant_stay_flat():
    """From the fingerprints of 0.5 GB of texts to those of 300 GB and far beyond."""
    masks, rng = S.ball(2), np.random.default_rng(4)
    fps = np.sort(rng.integers(0, 1 << 64, S.FPS_PER_TASK, dtype=np.uint64))
    sizes = {}
    for total in (235_000, 2_000_000, 13_800_000, 140_000_000, 1_400_000_000):
        bucket_bits, key_bits, whole = S.layout(total, len(masks))
        payloads = S._emit_whole(fps, masks, bucket_bits) if whole else S._emit(fps, masks, key_bits, bucket_bits)
        sizes[total] = sum(len(p) for _, p in payloads) / (len(fps) * len(masks))
    assert sizes[235_000] < 4 and max(sizes.values()) < 9, sizes


@pytest.mark.parametrize("bucket_bits", [0, 3, 12])
def test_whole_variants_come_back(bucket_bits):
    masks, rng = S.ball(2), np.random.default_rng(bucket_bits)
    fps = rng.integers(0, 1 << 64, 40, dtype=np.uint64)
    local = 30
    seen = set()
    for bucket, payload in S._emit_whole(fps, masks, bucket_bits):
        key, owner, table = S._unpack(payload, local, masks, bucket, bucket_bits)
        seen |= {(bucket, k, f) for k, f in zip(key.tolist(), table[owner].tolist())}
    want = set()
    for f in fps:
        v = f ^ masks
        S._mix(v)
        b = v >> np.uint64(64 - bucket_bits) if bucket_bits else np.zeros(len(v), np.uint64)
        k = (v << np.uint64(bucket_bits)) >> np.uint64(64 - local)
        want |= set(zip(b.tolist(), k.tolist(), [int(f)] * len(v)))
    assert seen == want


def test_links_do_not_depend_on_the_layout(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 1 << 64, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (30, 9, 3), dtype=np.uint64)
    fps = np.unique((centres[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel())
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")

    def parts():
        return sorted((r.node, r.component) for r in S.connected_components(S.ball_links(df, 4)).collect())

    want = parts()
    monkeypatch.setattr(S, "ENTRIES_PER_BUCKET", 1 << 12)
    assert parts() == want
    monkeypatch.setattr(S, "WHOLE_BYTES", 0)
    assert parts() == want and len(want) > 200
