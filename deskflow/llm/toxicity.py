"""Toxicity scores from subword-bag embeddings and a linear softmax (operator 3).

A word is the bag of its hashed character n-grams (3 to 5 bytes, with word
marks) and of the whole word; its vector is the mean of their embeddings. A
window of ``WINDOW`` consecutive words is the mean of its word vectors, and a
linear softmax over it gives the probability of the toxic class. A word that
follows itself counts once, so that windows always hold several words. A text's
score is that of its most toxic window, so a few words count in a text of any
length.
Unseen misspellings share n-grams, and thereby vectors, with the words seen.

Embeddings and softmax are trained jointly in numpy (Adagrad): first on whole
texts, then on each text's most toxic window. The classifier is fitted on a
bounded sample of labelled rows: about ``docs_per_class`` texts of each class,
drawn by a hash of their content. Scoring covers every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytewords import LETTERS, distinct, split_words, translate, word_bytes
from .common import crc_fold, lean, materialize, sub_batches

BUCKETS, DIM = 1 << 17, 6
GRAMS = (3, 4, 5)
WINDOW = 6
LONGEST = 40  # bytes of a word that make n-grams together; longer words are cut into parts
BATCH_BYTES = 12_000_000


def subwords(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, subword buckets) for all words, grouped by length; a row per word or part."""
    offsets, data = word_bytes(words)
    start, size = offsets[:-1], np.diff(offsets)
    count = np.maximum(1, -(-size // LONGEST))
    word = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    begin, length = start[word] + nth * LONGEST, np.minimum(LONGEST, size[word] - nth * LONGEST)
    order = np.argsort(length, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
        if not len(group) or not length[group[0]]:
            continue
        m = int(length[group[0]])
        for lo in range(0, len(group), 8192):
            part = group[lo:lo + 8192]
            letters = np.full((m + 2, len(part)), 60, dtype=np.uint64)  # '<' and '>' mark the ends
            letters[m + 1] = 62
            letters[1:m + 1] = data[begin[part][None, :] + np.arange(m)[:, None]]
            columns = []
            for n in sorted({*(g for g in GRAMS if g <= m + 2), m + 2}):
                for i in range(m + 3 - n):
                    h = np.full(len(part), 1469598103934665603 + n, dtype=np.uint64)
                    for j in range(n):
                        h ^= letters[i + j]
                        h *= np.uint64(1099511628211)
                    columns.append((h ^ (h >> np.uint64(29))) % np.uint64(BUCKETS))
            yield word[part], np.stack(columns, axis=1).astype(np.int32)


class SubwordSoftmax:
    """Embeddings of the subword buckets and a two-class linear softmax."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.embed = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM
        self.out = rng.normal(0, 1.0, (DIM, 2))
        self.bias = np.zeros(2)

    def margins(self) -> np.ndarray:
        """Toxic minus clean logit of each subword."""
        return (self.embed @ (self.out[:, 1] - self.out[:, 0])).astype(np.float32)

    def margin_bias(self) -> float:
        return float(self.bias[1] - self.bias[0])


def window_margins(margin: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best mean margin, its first word) over the windows of each text; an empty text has 0 and -1."""
    n = np.diff(bounds)
    sums = np.concatenate([[0.0], np.cumsum(margin)])
    starts = np.arange(len(margin))
    row_end = np.repeat(bounds[1:], n)
    row_start = np.repeat(bounds[:-1], n)
    end = np.minimum(starts + WINDOW, row_end)
    mean = (sums[end] - sums[starts]) / (end - starts)
    mean[(end - starts < WINDOW) & (starts > row_start)] = -np.inf  # a short window only where the text is short
    best, first = np.zeros(len(n)), np.full(len(n), -1)
    filled = np.flatnonzero(n > 0)
    if len(filled):
        best[filled] = np.maximum.reduceat(mean, bounds[filled])
        hit = np.flatnonzero(mean == np.repeat(best, n))
        rows = np.searchsorted(bounds, hit, side="right") - 1
        first[rows[::-1]] = hit[::-1]
    return best, first


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row bounds, word numbers, vocabulary) of the texts, a word's direct repeats dropped."""
    bounds, words = split_words(translate(texts, LETTERS))
    index, vocabulary = distinct(words)
    keep = np.ones(len(index), dtype=bool)
    keep[1:] = index[1:] != index[:-1]
    keep[bounds[:-1][np.diff(bounds) > 0]] = True
    return np.concatenate([[0], np.cumsum(keep)])[bounds], index[keep], vocabulary


def _train(texts: list[str], labels: np.ndarray, rounds: int, seed: int = 3) -> SubwordSoftmax:
    net, rng = SubwordSoftmax(), np.random.default_rng(seed)
    bounds, index, vocabulary = coded_words(pa.array(texts, pa.large_string()))
    sizes = np.zeros(len(vocabulary) + 1, dtype=np.int64)
    found = list(subwords(vocabulary))
    for word, grams in found:
        np.add.at(sizes, word + 1, grams.shape[1])
    place = np.cumsum(sizes)
    flat = np.empty(place[-1], dtype=np.int32)
    cursor = place[:-1].copy()
    for word, grams in found:
        if len(np.unique(word)) == len(word):
            flat[cursor[word][:, None] + np.arange(grams.shape[1])] = grams
            cursor[word] += grams.shape[1]
        else:
            for w, g in zip(word.tolist(), grams):
                flat[cursor[w]:cursor[w] + len(g)] = g
                cursor[w] += len(g)
    del found
    scale_e, scale_o, scale_b = np.full((BUCKETS, DIM), 1e-6), np.full((DIM, 2), 1e-6), np.full(2, 1e-6)
    balance = np.sqrt(len(labels) / (2 * np.maximum(np.bincount(labels, minlength=2), 1)))

    def step(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rate: float) -> None:
        """One Adagrad step on bags of words: their numbers, and how often each is in the bag."""
        w, times = (np.concatenate(x) for x in zip(*bags))
        bag = np.repeat(np.arange(len(bags)), [len(b) for b, _ in bags])
        share = times / np.bincount(bag, times)[bag]
        count = place[w + 1] - place[w]
        first = np.cumsum(count) - count
        gram = flat[np.arange(count.sum()) + np.repeat(place[w] - first, count)]
        part = np.repeat(share / count, count)  # weight of a subword in its bag's mean
        owner = np.repeat(bag, count)
        mean = np.stack([np.bincount(owner, net.embed[gram, k] * part, len(bags)) for k in range(DIM)], axis=1)
        logit = mean @ net.out + net.bias
        p = np.exp(logit - logit.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= balance[y][:, None] / len(y)
        g_out, g_bias, g_mean = mean.T @ p, p.sum(axis=0), p @ net.out.T
        used, at = np.unique(gram, return_inverse=True)
        g_embed = np.stack([np.bincount(at, g_mean[owner, k] * part, len(used)) for k in range(DIM)], axis=1)
        scale_e[used] += g_embed ** 2
        net.embed[used] -= rate * g_embed / np.sqrt(scale_e[used])
        scale_o[:] += g_out ** 2
        net.out -= rate * g_out / np.sqrt(scale_o)
        scale_b[:] += g_bias ** 2
        net.bias -= rate * g_bias / np.sqrt(scale_b)

    filled = np.flatnonzero(np.diff(bounds) > 0)
    whole = {r: np.unique(index[bounds[r]:bounds[r + 1]], return_counts=True) for r in filled.tolist()}
    for epoch in range(rounds):
        margin = Scorer(net.margins(), 0.0).word_margins(vocabulary)[index]
        _, first = window_margins(margin, bounds)
        order = rng.permutation(filled)
        for lo in range(0, len(order), 256):
            rows = order[lo:lo + 256]
            if epoch < 2:  # all words of the texts
                bags = [whole[r] for r in rows.tolist()]
            else:
                windows = [index[first[r]:min(first[r] + WINDOW, bounds[r + 1])] for r in rows]
                bags = [(w, np.ones(len(w), np.int64)) for w in windows]
            step(bags, labels[rows], 0.1)
    return net


class Scorer:
    """What scoring needs of a trained network: each subword's margin and the bias."""

    def __init__(self, table: np.ndarray, bias: float):
        self.table, self.bias = table, bias

    def word_margins(self, words: pa.Array) -> np.ndarray:
        """Toxic minus clean logit of each word on its own, without the bias."""
        total, count = np.zeros(len(words)), np.zeros(len(words))
        for word, grams in subwords(words):
            np.add.at(total, word, self.table[grams].sum(axis=1))
            np.add.at(count, word, grams.shape[1])
        return total / np.maximum(count, 1)


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 2500, rounds: int = 30, max_bytes: int = 64_000_000) -> Scorer | None:
    """Train on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``; None without rows of both classes.

    Only ids meet the labels. The sample's ids (at most three times
    ``docs_per_class``) then fetch their texts' sizes, and, in the order of a
    hash, whole texts up to ``max_bytes`` in all (but one of each class at
    least); one task trains on them.
    """
    known = labels.where("toxic in (0, 1)").join(docs.where("text is not null").select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        return None
    rate = F.when(F.col("toxic") == 1, min(1.0, docs_per_class / counts[1])).otherwise(min(1.0, docs_per_class / counts[0]))
    order = F.xxhash64("doc_id", F.lit("sample"))
    draw = F.pmod(order, F.lit(1 << 30)) / float(1 << 30)
    chosen = materialize(known.where(draw < rate).orderBy(order).limit(3 * docs_per_class), "labelled-sample")
    sizes = docs.where("text is not null").select("doc_id", F.octet_length("text").alias("size")).join(F.broadcast(chosen), "doc_id")
    sizes = sizes.groupBy("doc_id", "toxic").agg(F.sum("size").alias("size"))  # a row for each chosen id at most
    by_class = Window.partitionBy("toxic").orderBy(order, "doc_id")
    fits = sizes.withColumn("_n", F.row_number().over(by_class)).withColumn("_sum", F.sum("size").over(Window.orderBy(order, "doc_id")))
    chosen = materialize(fits.where((F.col("_sum") <= max_bytes) | (F.col("_n") == 1)).select("doc_id", "toxic"), "labelled-sample")
    sample = docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "toxic")  # bounded by the limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()))
        if rows:
            net = _train([t for t, _ in rows], np.array([y for _, y in rows]), rounds)
            yield pa.RecordBatch.from_arrays([pa.array([net.margins().tobytes()], pa.binary()),
                                              pa.array([net.margin_bias()])], ["margins", "bias"])

    row = sample.repartition(1).mapInArrow(lean(run), "margins binary, bias double").first()
    return Scorer(np.frombuffer(row.margins, np.float32), row.bias) if row else None


def score_texts(net: Scorer | None, texts: pa.Array) -> np.ndarray:
    """Toxic probability of each text's most toxic window (no word: that of the bias alone, at most 0.499)."""
    if net is None:
        return np.zeros(len(texts))
    bounds, index, vocabulary = coded_words(texts)
    best = np.zeros(len(texts))
    if len(index):
        best, _ = window_margins(net.word_margins(vocabulary)[index], bounds)
    score = 1 / (1 + np.exp(-np.clip(best + net.bias, -50, 50)))
    return np.where(np.diff(bounds) > 0, score, np.minimum(score, 0.499))


def toxicity(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    Learns ``labels(doc_id, toxic)`` of the documents whose crc32(doc_id) mod 5
    is not 0; the bounds are those of ``fit``. Labels, language, source and id
    are never inputs of a score.

    Null, empty and wordless texts are scored as clean (below 0.5). Without
    labels of both classes every score is 0. Labels other than 0 and 1, and
    labels without a document, are not learned. Repeated rows are kept; a null
    id stays null. An empty table gives an empty result; other columns are
    ignored.
    """
    held = crc_fold("doc_id", 5) == 0
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).distinct()
    net = fit(base.where(~held), known, **bounds)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score_texts(net, batch.column("text")))], schema=schema)

    return base.mapInArrow(lean(run), "doc_id long, score double").select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
