"""Language identification by a bidirectional gated recurrent network over bytes (operator 6).

The network reads a letter run (a word) forwards and backwards, one byte at a
time, and gives every byte position a distribution over the languages. A
document's probabilities are the mean over all its positions. The state starts
anew at each word, so equal words get equal labels: each distinct word of a
batch is run once and counted as often as it occurs. Words longer than
``PIECE`` bytes are read in pieces of that length (8 characters of three bytes),
the state starting anew at each. All bytes above 127 count as letters, also the
punctuation of other scripts; digits, spaces and ASCII punctuation get no label.

Training is backpropagation through time in numpy with Adam. The classifier is
fitted on a bounded sample of the labelled rows: about ``docs_per_language``
documents of each language drawn by a hash of their content, of which at most
``sample_words`` distinct (language, word) pairs are used; runs of more than
``LONGEST`` characters, as scripts without spaces have, are learned in pieces.
Prediction covers
every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .bytewords import LETTERS, distinct, split_words, translate, word_bytes
from .common import crc_fold, lean, sub_batches

PIECE = 24  # bytes read without a break
LONGEST = 64  # characters of a word that goes into the sample whole
HIDDEN = 12
BATCH_BYTES = 8_000_000
UNDETERMINED = "und"


class ByteBiGru:
    """Two gated recurrent layers over bytes and a softmax on each position."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 7):
        rng = np.random.default_rng(seed)
        n, h = len(languages), hidden
        self.languages, self.hidden = languages, h
        self.w = {"out": rng.normal(0, 0.3, (2 * h, n)), "bias": np.zeros(n)}
        for d in "fb":  # forward, backward; input rows hold update, reset and candidate parts side by side
            self.w[f"x{d}"] = rng.normal(0, 0.5, (256, 3 * h))
            self.w[f"u{d}"] = rng.normal(0, 0.4, (h, 3 * h))
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    def _states(self, pieces: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden state after every byte, (length, n, hidden), in reading order of the text."""
        h, (n, length) = self.hidden, pieces.shape
        x, u = self.w[f"x{d}"], self.w[f"u{d}"]
        state = np.zeros((n, h), np.float32)
        out = np.empty((length, n, h), np.float32)
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            state, back = gru.forward(x[pieces[:, t]], state, u)
            if keep is not None:
                keep.append((t, back))
            out[t] = state
        return out

    def positions(self, pieces: np.ndarray) -> np.ndarray:
        """Language probabilities of each byte, (length, n, languages)."""
        h, out = self.hidden, self.w["out"]
        logits = self._states(pieces, "f") @ out[:h] + self._states(pieces, "b") @ out[h:] + self.w["bias"]
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def gradients(self, pieces: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy over all positions, through time."""
        h, (n, length) = self.hidden, pieces.shape
        out, g = self.w["out"], {}
        kept = {"f": [], "b": []}
        states = {d: self._states(pieces, d, kept[d]) for d in "fb"}
        logits = states["f"] @ out[:h] + states["b"] @ out[h:] + self.w["bias"]
        logits = np.exp(logits - logits.max(axis=2, keepdims=True))
        delta = logits / logits.sum(axis=2, keepdims=True)
        delta[:, np.arange(n), label] -= 1
        delta /= n * length
        flat = delta.reshape(-1, delta.shape[2])
        g["out"] = np.concatenate([states[d].reshape(-1, h).T @ flat for d in "fb"])
        g["bias"] = flat.sum(axis=0)
        for d, rows in (("f", out[:h]), ("b", out[h:])):
            from_out = delta @ rows.T
            u = self.w[f"u{d}"]
            gx, gu = np.zeros_like(self.w[f"x{d}"]), np.zeros_like(u)
            back = np.zeros((n, h), np.float32)
            for t, step in reversed(kept[d]):
                back, d_in, d_u = gru.backward(back + from_out[t], step, u)
                np.add.at(gx, pieces[:, t], d_in)
                gu += d_u
            g[f"x{d}"], g[f"u{d}"] = gx, gu
        return g


def pieces_of(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word numbers, byte matrix) of all pieces, grouped by their length."""
    offsets, data = word_bytes(words)
    start, size = offsets[:-1], np.diff(offsets)
    count = np.maximum(1, -(-size // PIECE))
    word = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
    begin = start[word] + nth * PIECE
    length = np.minimum(PIECE, size[word] - nth * PIECE)
    order = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    for group in np.split(order, cuts):
        if len(group) and length[group[0]] > 0:
            for lo in range(0, len(group), 4096):
                part = group[lo:lo + 4096]
                yield word[part], data[begin[part][:, None] + np.arange(length[part[0]])]


def train(sample: list[tuple[str, str, int]], steps: int = 700, batch: int = 256, seed: int = 11) -> ByteBiGru:
    """Fit on (language, word, count) rows; batches draw languages evenly, words by square root of count."""
    languages = sorted({lang for lang, _, _ in sample})
    net = ByteBiGru(languages)
    rng = np.random.default_rng(seed)
    number = {lang: i for i, lang in enumerate(languages)}
    sample = sorted(sample)
    label = np.array([number[lang] for lang, _, _ in sample])
    weight = np.sqrt(np.array([c for _, _, c in sample], dtype=np.float64))
    weight /= np.bincount(label, weights=weight)[label]
    groups = [(label[w], weight[w], p) for w, p in pieces_of(pa.array([w for _, w, _ in sample]))]
    odds = np.array([g[1].sum() * g[2].shape[1] for g in groups])
    odds /= odds.sum()
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.w.items()}
    for step in range(1, steps + 1):
        labels, weights, pieces = groups[rng.choice(len(groups), p=odds)]
        pick = rng.choice(len(labels), size=batch, p=weights / weights.sum())
        rate = 0.02 * min(1, step / 20) * (1 - 0.9 * step / steps)
        for k, g in net.gradients(pieces[pick], labels[pick]).items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            net.w[k] -= (rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)).astype(np.float32)
    return net


def cut_long(word: str) -> list[str]:
    """The word, or if it is over ``LONGEST`` characters its parts of at most ``PIECE`` bytes, cut between characters."""
    if len(word) <= LONGEST:
        return [word]
    data, parts, at = word.encode(), [], 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        parts.append(data[at:end].decode())
        at = end
    return parts


def sample_words(labelled: DataFrame, docs_per_language: int, sample_words: int) -> list[tuple[str, str, int]]:
    """A bounded sample of (language, word, count), alike on every run over the same rows."""
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    rate = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, docs_per_language / n))])
    draw = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = labelled.where(draw < rate[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sub_batches(iter([batch]), "text", BATCH_BYTES):
                bounds, words = split_words(translate(piece.column("text"), LETTERS))
                lang = piece.column("lang").take(pa.array(np.repeat(np.arange(piece.num_rows), np.diff(bounds))))
                table = pa.table({"lang": lang, "word": words}).group_by(["lang", "word"]).aggregate([([], "count_all")])
                table = table.select(["lang", "word", "count_all"]).rename_columns(["lang", "word", "n"])
                long = pc.greater(pc.utf8_length(table["word"]), LONGEST)
                if pc.any(long).as_py():
                    cut = [(r["lang"], w, r["n"]) for r in table.filter(long).to_pylist() for w in cut_long(r["word"])]
                    cut = pa.table([pa.array(c, f.type) for c, f in zip(zip(*cut), table.schema)], table.schema)
                    table = pa.concat_tables([table.filter(pc.invert(long)), cut])
                for part in table.to_batches():
                    yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.string()), part.column(1).cast(pa.string()),
                                                      part.column(2)], ["lang", "word", "n"])

    words = (chosen.select("lang", "text").mapInArrow(lean(run), "lang string, word string, n long")
             .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    # each language gets an equal part of the bound; its rarest words go first
    share = max(1, sample_words // len(counts))
    least = words.selectExpr(
        "*", "row_number() over (partition by lang order by n desc, xxhash64(word), word) as k")
    return [(r.lang, r.word, r.n) for r in least.where(F.col("k") <= share).select("lang", "word", "n").collect()]


def predict(docs: DataFrame, net: ByteBiGru | None) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of ``docs(doc_id, text)``; extra input columns are dropped."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            langs, scores = label_texts(net, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), langs, scores], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lean(run), "doc_id long, lang_pred string, score double")


def label_texts(net: ByteBiGru | None, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Predicted language and its pooled probability of each text."""
    n = len(texts)
    bounds, words = split_words(translate(texts, LETTERS))
    if net is None or not len(words):
        return pa.array([UNDETERMINED] * n, pa.string()), pa.array([0.0] * n)
    index, vocabulary = distinct(words)
    sums = np.zeros((len(vocabulary), len(net.languages)))
    for word, pieces in pieces_of(vocabulary):
        np.add.at(sums, word, net.positions(pieces).sum(axis=0))
    row = np.repeat(np.arange(n), np.diff(bounds))
    pooled = np.stack([np.bincount(row, weights=sums[index, k], minlength=n) for k in range(len(net.languages))], axis=1)
    total = pooled.sum(axis=1)
    best = pooled.argmax(axis=1)
    score = np.minimum(1.0, pooled[np.arange(n), best] / np.maximum(total, 1e-300))
    known = has_letters(texts, bounds)
    return (pa.array([net.languages[b] if k else UNDETERMINED for b, k in zip(best.tolist(), known.tolist())], pa.string()),
            pa.array(np.where(known, score, 0.0)))


def has_letters(texts: pa.Array, bounds: np.ndarray) -> np.ndarray:
    """Whether each text holds a letter; ``bounds`` are those of its letter runs."""
    known = np.diff(bounds) > 0
    # a text without ASCII letters may hold no letter at all
    plain = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"[A-Za-z]"), False))
    for i in np.flatnonzero(known & ~plain).tolist():
        known[i] = any(ch.isalpha() for ch in texts[i].as_py())
    return known


def fit(docs: DataFrame, docs_per_language: int = 250, max_words: int = 40_000, steps: int = 700) -> ByteBiGru | None:
    """Train on rows of ``docs(doc_id, text, lang)``; None if no row has a language and a text."""
    labelled = docs.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = sample_words(labelled, docs_per_language, max_words)
    return train(sample, steps) if sample else None


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text, lang)``.

    Learns from rows with a language whose crc32(doc_id) mod 4 is not 2;
    language, source and id are never inputs of a prediction. The bounds are
    those of ``fit``.

    A null text and a text without a letter get ``und`` and score 0; so does
    every row if there is no row to learn from. Repeated rows are kept, a null
    id stays null, equal probabilities go to the first language by name. An
    empty table gives an empty result; further columns are ignored.
    """
    held = crc_fold("doc_id", 4) == 2
    base = docs.select("doc_id", "text", "lang")
    net = fit(base.where(~held), **bounds)
    return predict(base, net).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, languages: set[str] | None = None, min_score: float = 0.0, **bounds) -> DataFrame:
    """The rows of ``docs`` whose text has a recognised language, with all columns; a null ``lang`` is filled with the prediction.

    Rejected are the rows that ``identify`` labels ``und`` under a model, which
    learns from the same fold (null texts, texts without a letter), those that
    it scores below ``min_score``, and, where ``languages`` are given, those
    that it labels otherwise. Languages that are already there are not changed.
    Without a row to learn from, every text with a letter stays as it is.
    """
    held = crc_fold("doc_id", 4) == 2
    net = fit(docs.select("doc_id", "text", "lang").where(~held), **bounds)
    at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in sub_batches(iter([batch]), docs_text, BATCH_BYTES):
                texts = piece.column(at)
                if net is None:
                    yield piece.filter(pa.array(has_letters(texts, split_words(translate(texts, LETTERS))[0])))
                    continue
                predicted, scores = label_texts(net, texts)
                keep = pc.and_(pc.not_equal(predicted, UNDETERMINED), pc.greater_equal(scores, min_score))
                if languages is not None:
                    keep = pc.and_(keep, pc.is_in(predicted, value_set=pa.array(sorted(languages), pa.string())))
                known = piece.column(lang_at)
                piece = piece.set_column(lang_at, piece.schema.field(lang_at), pc.coalesce(known, predicted.cast(known.type)))
                yield piece.filter(keep)

    docs_text = docs.columns[at]
    return docs.mapInArrow(lean(run), docs.schema)
