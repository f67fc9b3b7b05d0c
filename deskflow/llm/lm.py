"""Language-model scores from a gated recurrent network over words (operator 2).

Vocabulary. Spark counts every word of the training documents. The most
frequent words, as many as the root of the number of different words (``HEAD``
at least), are modelled one by one; every other word belongs to
the band of its count (1, 2-3, 4-7, ...), and words never seen in training are
one unknown word, the band of count 0.

Model. A gated recurrent unit reads the previous symbol (head word or band).
The output is factored into classes: P(word) = P(class | state) x
P(word | class), where a class is either 32 head words of similar frequency,
with a softmax of their own over the state, or one band, inside which words are
in proportion to their counts. Probabilities over all training words and the
unknown word sum to one.

Training. Truncated backpropagation through time in numpy, in parallel: each
task trains on every word of the training documents of its rows, then the
tasks' weights are averaged, for ``ROUNDS`` rounds. In training a rare word is banded by its count without the
occurrence at hand, so words seen once teach what unknown words look like.

Scoring. All documents of a chunk advance together; the state of each is
carried from window to window, so a score is that of the complete document.

Words and counts. Documents are coded in chunks with a dictionary each, so the
shuffle for counts carries each distinct word of a chunk once, not each word,
packed by chunk and part of the vocabulary. A part answers each chunk with the
counts of its words alone, in their order; codes are kept compressed, once for
training and scoring.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import gru
from .bytewords import LOWER, distinct, split_words, translate
from .common import crc_fold, lean, materialize, sub_batches

CHUNK_BYTES = 8_000_000
HEAD, PER_CLASS = 1024, 32
BANDS = 48  # by powers of two of the count; band 0 is the unknown word
HIDDEN = 24
ROUNDS = 2
STREAMS, WINDOW = 192, 16
ROWS = 1 << 14  # symbols scored at once
FAN_IN = 64
PART_CHUNKS = 4  # chunks whose words are worth a part of the vocabulary
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = ""  # the end of a document; no word is empty


def band_of(count: np.ndarray) -> np.ndarray:
    """0 for 0, else 1 + floor(log2(count))."""
    return np.minimum(np.frexp(count.astype(np.float64))[1], BANDS - 1).astype(np.int64)


def ascending(x: np.ndarray, n: int) -> np.ndarray:
    """A stable order of numbers below ``n``; two bytes are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if n <= 1 << 16 else x, kind="stable")


class ClassGru:
    """The network; all weights in one dictionary of float32 arrays."""

    def __init__(self, n_head: int, n_bands: int = BANDS, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.n_head = n_head
        self.head_classes = -(-n_head // PER_CLASS)
        self.symbols = n_head + n_bands + 1  # the last one stands before a document
        c, h = self.head_classes + n_bands, HIDDEN
        w = {"x": rng.normal(0, 0.1, (self.symbols, 3 * h)), "u": rng.normal(0, 0.2, (h, 3 * h)),
             "class": rng.normal(0, 0.05, (h, c)), "class_bias": np.zeros(c),
             "word": rng.normal(0, 0.05, (self.head_classes * PER_CLASS, h)),
             "word_bias": np.zeros(self.head_classes * PER_CLASS)}
        w["word_bias"][n_head:] = -1e9  # places of the last class that no word has
        w["x"][:, :h] += 0.5
        self.w = {k: v.astype(np.float32) for k, v in w.items()}

    def start_from(self, head_counts: np.ndarray, band_mass: np.ndarray) -> None:
        """Biases that reproduce the training frequencies, before any gradient step."""
        padded = np.zeros(self.head_classes * PER_CLASS)
        padded[:self.n_head] = head_counts
        by_class = np.concatenate([padded.reshape(-1, PER_CLASS).sum(axis=1), band_mass])
        self.w["class_bias"] = np.log(np.maximum(by_class, 0.5) / max(1.0, by_class.sum())).astype(np.float32)
        self.w["word_bias"][:self.n_head] = np.log(np.maximum(head_counts, 0.5))

    def pack(self) -> bytes:
        return b"".join(self.w[k].tobytes() for k in sorted(self.w))

    def unpack(self, flat: np.ndarray) -> None:
        at = 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = flat[at:at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n

    def class_of(self, symbol: np.ndarray) -> np.ndarray:
        return np.where(symbol < self.n_head, symbol // PER_CLASS, self.head_classes + symbol - self.n_head)

    def log_probability(self, states: np.ndarray, symbol: np.ndarray, gradients: dict | None = None):
        """ln P of each symbol given its state (of a band: of the band); fills ``gradients`` and returns d states too.

        Rows are columns of all large arrays, so that sums over classes run along rows.
        """
        w, n = self.w, len(symbol)
        kind, every = self.class_of(symbol), np.arange(n)
        logits = w["class"].T @ states.T
        logits += w["class_bias"][:, None]
        logits -= logits.max(axis=0)
        picked = logits[kind, every]
        np.exp(logits, out=logits)
        total = logits.sum(axis=0)
        out = picked - np.log(total)
        d_states = None
        if gradients is not None:
            total *= n
            logits /= total
            logits[kind, every] -= 1 / n
            gradients["class"], gradients["class_bias"] = (logits @ states).T, logits.sum(axis=1)
            gradients["word"], gradients["word_bias"] = np.zeros_like(w["word"]), np.zeros_like(w["word_bias"])
            d_states = logits.T @ w["class"].T
        order = ascending(kind, len(w["class_bias"]))
        edges = np.searchsorted(kind[order], np.arange(self.head_classes + 1))
        order = order[:edges[-1]]
        if not len(order):
            return out, d_states
        # all head words by class: a product for each class, the rest for all at once
        own, at, every = states[order], symbol[order] % PER_CLASS, np.arange(len(order))
        inside = np.empty((PER_CLASS, len(order)), own.dtype)
        pieces = [(slice(lo, hi), slice(c * PER_CLASS, (c + 1) * PER_CLASS))
                  for c, (lo, hi) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if hi > lo]
        for rows, part in pieces:
            np.matmul(w["word"][part], own[rows].T, out=inside[:, rows])
        inside += np.repeat(w["word_bias"].reshape(-1, PER_CLASS).T, np.diff(edges), axis=1)
        inside -= inside.max(axis=0)
        picked = inside[at, every]
        np.exp(inside, out=inside)
        total = inside.sum(axis=0)
        out[order] += picked - np.log(total)
        if gradients is not None:
            total *= n
            inside /= total
            inside[at, every] -= 1 / n
            back = np.empty_like(own)
            for rows, part in pieces:
                np.matmul(inside[:, rows], own[rows], out=gradients["word"][part])
                np.matmul(inside[:, rows].T, w["word"][part], out=back[rows])
            filled = np.flatnonzero(np.diff(edges))
            gradients["word_bias"].reshape(-1, PER_CLASS)[filled] = np.add.reduceat(inside, edges[filled], axis=1).T
            d_states[order] += back
        return out, d_states

    def inputs(self, symbols: np.ndarray) -> np.ndarray:
        """The network's inputs (steps, 3 h, sequences) for previous ``symbols`` (steps, sequences)."""
        return np.ascontiguousarray(self.w["x"][symbols].transpose(0, 2, 1))

    def score(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """ln P of each document's symbols; windows follow each other with the state carried on."""
        size = np.diff(bounds)
        order = np.argsort(-size, kind="stable")
        size, start = size[order], bounds[:-1][order]
        result = np.zeros(len(size))
        state = np.zeros((HIDDEN, len(size)), np.float32)
        previous = np.full(len(size), self.symbols - 1)
        t, longest = 0, int(size[0]) if len(size) else 0
        while t < longest:
            active = int(np.searchsorted(-size, -t, side="left"))
            steps = min(longest - t, max(1, min(64, ROWS // active)))
            # one window; documents that end in it run on to its end, uncounted
            at = t + np.arange(steps)[:, None]
            inside = at < size[:active]
            target = symbols[np.minimum(start[:active] + at, len(symbols) - 1)]
            before = np.concatenate([previous[None, :active], target[:-1]])
            states, state, _ = gru.steps(self.inputs(before), state[:, :active], self.w["u"])
            ln = np.zeros(inside.shape)
            ln[inside], _ = self.log_probability(states.transpose(0, 2, 1)[inside], target[inside])
            result[:active] += ln.sum(axis=0)
            previous = target[-1]
            t += steps
        back = np.empty(len(size))
        back[order] = result
        return back


class Trainer:
    """Truncated backpropagation through time with Adam, over parallel streams of documents."""

    def __init__(self, net: ClassGru, rate: float):
        self.net, self.rate, self.steps, self.seen = net, rate, 0, 0
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.w.items()}

    def train(self, symbols: np.ndarray, ends: np.ndarray) -> None:
        """``symbols``: documents one after another; ``ends``: True at the last symbol of each."""
        if not len(symbols):
            return
        lanes = min(STREAMS, max(1, len(symbols) // (2 * WINDOW)))
        edges = np.arange(lanes + 1) * len(symbols) // lanes
        length = int(np.diff(edges).max())
        at = edges[:-1, None] + np.arange(length)
        used = at < edges[1:, None]  # a lane one symbol shorter is padded
        at = np.minimum(at, len(symbols) - 1)
        streams, last = symbols[at], ends[at]
        state = np.zeros((lanes, HIDDEN), np.float32)
        previous = np.full(lanes, self.net.symbols - 1)
        for lo in range(0, length, WINDOW):
            part = slice(lo, lo + WINDOW)
            state, previous = self._window(streams[:, part], last[:, part], state, previous, used[:, part])
        self.seen += len(symbols)

    def _window(self, target: np.ndarray, last: np.ndarray, state: np.ndarray, previous: np.ndarray, used: np.ndarray | None = None):
        w, net = self.net.w, self.net
        target, last = np.ascontiguousarray(target.T), np.ascontiguousarray(last.T)
        after = np.where(last, net.symbols - 1, target)  # a document begins with an empty state and the start symbol
        goes_on = (~last).astype(w["u"].dtype)
        inputs = np.concatenate([previous[None], after[:-1]])
        states, state, kept = gru.steps(net.inputs(inputs), state.T, w["u"], goes_on)
        g: dict[str, np.ndarray] = {}
        every, symbol = states.transpose(0, 2, 1).reshape(-1, HIDDEN), target.ravel()
        if used is None or used.all():
            _, d_states = net.log_probability(every, symbol, g)
        else:  # padding gives no gradient
            rows = np.flatnonzero(used.T.ravel())
            d_states = np.zeros_like(every)
            _, d_states[rows] = net.log_probability(every[rows], symbol[rows], g)
        d_states = np.ascontiguousarray(d_states.reshape(*target.shape, HIDDEN).transpose(0, 2, 1))
        d_inputs, g["u"] = gru.steps_back(d_states, kept, w["u"], goes_on)
        g["x"] = np.zeros_like(w["x"])
        symbol = inputs.ravel()
        order = ascending(symbol, net.symbols)
        first = np.flatnonzero(np.diff(symbol[order], prepend=-1))
        g["x"][symbol[order[first]]] = np.add.reduceat(
            d_inputs.transpose(0, 2, 1).reshape(-1, 3 * HIDDEN)[order], first, axis=0)
        self.steps += 1
        rate = self.rate * min(1.0, self.steps / 10)
        for k, grad in g.items():  # Adam, in place
            m, v = self.moments[k]
            m *= 0.9
            v *= 0.98
            m += 0.1 * grad
            grad *= grad
            grad *= 0.02
            v += grad
            np.sqrt(v, out=grad)
            grad *= 1 / math.sqrt(1 - 0.98 ** self.steps)
            grad += 1e-7
            np.divide(m, grad, out=grad)
            grad *= rate / (1 - 0.9 ** self.steps)
            w[k] -= grad
        return state.T, after[-1]


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32, their lowest bytes first, then the next ones, compressed."""
    data = np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return pa.compress(data, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    data = pa.decompress(data, 4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, n).T).view("<u4").ravel()


def narrow(numbers: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def widen(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def lines(words: pa.Array, starts: np.ndarray) -> pa.Array:
    """The words of each piece [starts[i], starts[i + 1]) as one text; no word holds a line feed."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), words.cast(pa.string())), "\n")


def unlines(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(starts of the pieces, their words)."""
    pieces = pc.split_pattern(texts, "\n")
    return np.asarray(pieces.offsets, dtype=np.int64), pieces.values


def coded_chunks(docs: DataFrame, held) -> DataFrame:
    """Rows of about ``CHUNK_BYTES`` of text: documents as numbers of the chunk's own dictionary, whose frequent words come first."""
    schema = pa.schema([("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                        ("sizes", pa.list_(pa.int64())), ("tokens", pa.binary()), ("words", pa.string()), ("train_n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in sub_batches(batches, "text", CHUNK_BYTES):
            bounds, words = split_words(translate(batch.column("text"), LOWER))
            index, vocabulary = distinct(words) if len(words) else (np.zeros(0, np.int32), pa.array([], pa.string()))
            vocabulary = pa.concat_arrays([vocabulary.cast(pa.string()), pa.array([END])])
            n = np.diff(bounds)
            tokens = np.full(len(index) + len(n), len(vocabulary) - 1, dtype=np.int32)
            tokens[np.arange(len(index)) + np.repeat(np.arange(len(n)), n)] = index
            order = np.argsort(-np.bincount(tokens, minlength=len(vocabulary)), kind="stable")
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            tokens = place[tokens]
            held_rows = np.asarray(batch.column("held"))
            train = np.bincount(tokens[~np.repeat(held_rows, n + 1)], minlength=len(vocabulary))
            row = [[chunk], [batch.column("doc_id").to_pylist()], [held_rows.tolist()], [n + 1], [squeeze(tokens)],
                   lines(vocabulary.take(pa.array(order)), np.array([0, len(order)])), [narrow(train)]]
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, f.type) for v, f in zip(row, schema)], schema=schema)
            chunk += 1

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held"))
    return base.mapInArrow(lean(run), "chunk long, doc_ids array<bigint>, held array<boolean>, sizes array<bigint>, tokens binary, "
                                "words string, train_n binary")


def by_part(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): words[order[starts[p]:starts[p + 1]]] are dealt to part p, by hash."""
    part = (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def counted(chunks: DataFrame, parts: int, most: int) -> DataFrame:
    """Training counts of all words, by a shuffle of the chunks' dictionaries in ``parts`` parts.

    Three kinds of rows: (chunk, part, counts) answers a chunk for its words of
    the part, in their order; (word, c) are a part's ``most`` most frequent words,
    the end first; (sums) has a part's tokens, words, and by band the tokens and
    the tokens banded without the occurrence at hand.
    """
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, words = unlines(row.column("words"))
                train = widen(row.column("train_n")[0].as_py(), len(words))
                order, starts = by_part(words, parts)
                filled = np.flatnonzero(np.diff(starts))
                texts = lines(words.take(pa.array(order)), starts).take(pa.array(filled))
                train = [narrow(train[order[starts[p]:starts[p + 1]]]) for p in filled.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(filled), row.column("chunk")[0].as_py()), pa.int64()), pa.array(filled, pa.int32()),
                     texts, pa.array(train, pa.binary())], ["chunk", "part", "words", "train_n"])

    names = ["chunk", "part", "counts", "word", "c", "sums"]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int64())]

    def rows(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds)], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        starts, words = unlines(table.column("words").combine_chunks())
        index, vocabulary = distinct(words)
        train = np.concatenate([widen(t.as_py(), n) for t, n in zip(table.column("train_n"), np.diff(starts).tolist())])
        counts = np.bincount(index, weights=train, minlength=len(vocabulary)).astype(np.int64)
        answers = [narrow(counts[index[lo:hi]]) for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist())]
        yield rows(table.num_rows, chunk=table.column("chunk").combine_chunks(), part=table.column("part").combine_chunks(), counts=answers)
        seen = np.flatnonzero(counts)
        c, band = counts[seen], band_of(counts[seen])
        edge = c & (c - 1) == 0
        by_band = [np.bincount(b, weights=c, minlength=BANDS).astype(np.int64) for b in (band, band - edge)]
        yield rows(1, sums=[np.concatenate([[c.sum(), len(c)], *by_band])])
        met = vocabulary.take(pa.array(seen))
        is_end = np.asarray(pc.equal(met, END))
        if len(c) > most:  # only these can be the most frequent of all
            keep = np.flatnonzero(is_end | (c >= np.partition(c, -most)[-most]))
            c, met, is_end = c[keep], met.take(pa.array(keep)), is_end[keep]
        found = pa.table({"end": is_end, "c": c, "word": met})
        found = found.take(pc.sort_indices(found, [("end", "descending"), ("c", "descending"), ("word", "ascending")])[:most]).combine_chunks()
        yield rows(found.num_rows, word=found.column("word").combine_chunks(), c=found.column("c").combine_chunks())

    dealt = chunks.select("chunk", "words", "train_n").mapInArrow(lean(deal), "chunk long, part int, words string, train_n binary")
    return dealt.repartition(parts, "part").mapInArrow(
        lean(count), "chunk long, part int, counts binary, word string, c long, sums array<bigint>")


def head_size(types: int) -> int:
    """How many words are modelled one by one: the root of the vocabulary's size, whole classes, ``HEAD`` at least."""
    return max(HEAD, PER_CLASS * math.ceil(math.sqrt(types) / PER_CLASS))


def average(weights: DataFrame, tasks: int) -> np.ndarray | None:
    """Mean of the rows' packed weights by their symbols, summed in a tree of groups of ``FAN_IN``."""
    def merge(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, "<f8") for p in group.packed)
        return pd.DataFrame({"task": [int(group.task.iloc[0]) // FAN_IN], "seen": [int(group.seen.sum())], "packed": [total.tobytes()]})

    while tasks > FAN_IN:
        weights = weights.groupBy((F.col("task") / FAN_IN).cast("long")).applyInPandas(merge, weights.schema)
        tasks = math.ceil(tasks / FAN_IN)
    rows = weights.collect()  # at most FAN_IN rows of some hundred KB
    seen = sum(r.seen for r in rows)
    return sum(np.frombuffer(r.packed, "<f8") for r in rows) / seen if seen else None


def score_documents(docs: DataFrame, rounds: int = ROUNDS, rate: float = 0.02) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs(doc_id, text)``.

    Learns from rows whose crc32(doc_id) mod 7 is not 2. Words are lower-cased
    (A-Z) runs without white space; every document ends with one end token.
    base_score is the log10 probability under add-one word frequencies, score
    the network's.

    A null text is empty: its only token is the end. Rows are scored one by
    one, so repeated rows and equal ids each give a row; a null id stays null.
    Without any training row all words are unknown and both scores are 0. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    held = crc_fold("doc_id", 7) == 2
    chunks = materialize(coded_chunks(docs, held), "lm-chunks")
    n_chunks = chunks.count()
    if not n_chunks:
        return spark.createDataFrame([], SCORES)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_chunks)  # so that a task holds few chunks
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_chunks / PART_CHUNKS))
    entries = chunks.select(F.sum(F.length("words") - F.length(F.replace("words", F.lit("\n"))) + 1)).first()[0]
    known = materialize(counted(chunks, parts, head_size(entries)), "lm-lexicon")
    sums = {r.pos: r.n for r in known.where("sums is not null").select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("n")).collect()}
    total, types, *by_band = (sums[k] for k in range(2 + 2 * BANDS))
    head = known.where("word is not null").orderBy(F.col("word") != END, F.desc("c"), "word").limit(head_size(types)).select("word", "c").collect()
    head = sorted(head, key=lambda r: (-r.c, r.word))
    head_words, head_counts = [r.word for r in head], np.array([r.c for r in head], dtype=np.float64)
    # bands of the tail: mass and, without the occurrence at hand, what training will see of each
    mass, seen_less = (np.array(x, dtype=np.float64) for x in (by_band[:BANDS], by_band[BANDS:]))
    for word_count in head_counts.astype(np.int64).tolist():
        b = int(band_of(np.array([word_count]))[0])
        mass[b] -= word_count
        seen_less[b - 1 if word_count & (word_count - 1) == 0 else b] -= word_count
    n_head = len(head_words)
    n_bands = int(np.flatnonzero(mass > 0).max(initial=0)) + 1  # bands that some word of the tail is in
    floor = math.log10(total + types + 1)
    # a code is a head word, or a band and whether it is one less without the occurrence at hand
    bands = np.repeat(np.arange(n_bands), 2)
    symbol_of = np.concatenate([np.arange(n_head), n_head + bands])
    less_of = np.concatenate([np.arange(n_head), n_head + np.maximum(bands - np.arange(2 * n_bands) % 2, 0)])

    coded_schema = pa.schema([
        ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_tokens", pa.list_(pa.int64())),
        ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("tail", pa.list_(pa.float64())), ("codes", pa.binary())])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(head_words, pa.string())
        in_band = np.maximum(mass, 1)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                _, words = unlines(row.column("words"))
                order, starts = by_part(words, parts)
                counts = np.zeros(len(words), np.int64)
                for answer in row.column("answers")[0].as_py():
                    own = order[starts[answer["part"]]:starts[answer["part"] + 1]]
                    counts[own] = widen(answer["counts"], len(own))
                ids = np.asarray(pc.fill_null(pc.index_in(words, vocabulary), -1)).astype(np.int64)
                bands = band_of(counts)
                edge = (counts > 0) & (counts & (counts - 1) == 0)
                symbol = np.where(ids >= 0, ids, n_head + 2 * bands + edge)
                tail = np.where((ids >= 0) | (counts == 0), 0.0, np.log10(np.maximum(counts, 1) / in_band[bands]))
                sizes = np.asarray(row.column("sizes")[0].values)
                tokens = unsqueeze(row.column("tokens")[0].as_py(), int(sizes.sum()))
                first = np.cumsum(sizes) - sizes
                out = [row.column("doc_ids"), row.column("held"), [sizes], [np.add.reduceat(counts[tokens] > 0, first, dtype=np.int64)],
                       [np.add.reduceat(np.log10(counts + 1.0)[tokens], first) - floor * sizes], [np.add.reduceat(tail[tokens], first)],
                       [squeeze(symbol[tokens])]]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v, pa.Array) else pa.array(v, f.type)
                                                  for v, f in zip(out, coded_schema)], schema=coded_schema)

    answers = known.where("chunk is not null").select("chunk", "part", "counts").repartition(tasks, "chunk").groupBy("chunk").agg(
        F.collect_list(F.struct("part", "counts")).alias("answers"))  # counts of one chunk's words
    met = chunks.drop("train_n").repartition(tasks, "chunk").join(answers, "chunk")
    coded = met.select("doc_ids", "held", "sizes", "tokens", "words", "answers").mapInArrow(
        lean(code), "doc_ids array<bigint>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, "
              "tail array<double>, codes binary")
    coded = materialize(coded, "lm-coded")

    net = ClassGru(n_head, n_bands)
    net.start_from(head_counts, np.maximum(seen_less, 0)[:n_bands])
    lessons = coded.select("held", "n_tokens", "codes")
    tasks = lessons.rdd.getNumPartitions()
    for k in range(rounds):
        start = np.frombuffer(net.pack(), np.float32)

        def teach(batches: Iterator[pa.RecordBatch], start=start, rate=rate / (1 + 2 * k)) -> Iterator[pa.RecordBatch]:
            own = ClassGru(n_head, n_bands)
            own.unpack(start)
            trainer = Trainer(own, rate)
            for batch in batches:
                for held_rows, sizes, codes in zip(*(batch.column(c) for c in ("held", "n_tokens", "codes"))):
                    learned, sizes = ~held_rows.values.to_numpy(zero_copy_only=False), np.asarray(sizes.values)
                    lesson = less_of[unsqueeze(codes.as_py(), int(sizes.sum()))[np.repeat(learned, sizes)]]
                    ends = np.zeros(len(lesson), dtype=bool)
                    ends[np.cumsum(sizes[learned]) - 1] = True
                    trainer.train(lesson, ends)
            if trainer.seen:
                packed = np.frombuffer(own.pack(), np.float32).astype("<f8") * trainer.seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([trainer.seen], pa.int64()),
                     pa.array([packed.tobytes()], pa.binary())], ["task", "seen", "packed"])

        mean = average(lessons.mapInArrow(lean(teach), "task long, seen long, packed binary"), tasks)
        if mean is not None:
            net.unpack(mean)
    weights = np.frombuffer(net.pack(), np.float32)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ClassGru(n_head, n_bands)
        own.unpack(weights)
        for batch in batches:
            for row in batch.to_pylist():
                symbols = symbol_of[unsqueeze(row["codes"], sum(row["n_tokens"]))]
                if total:
                    ln = own.score(symbols, np.concatenate([[0], np.cumsum(row["n_tokens"])]))
                else:  # nothing was learned: the unknown word is the only one
                    ln = np.zeros(len(row["n_tokens"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["n_tokens"], pa.int64()),
                     pa.array(row["n_known"], pa.int64()), pa.array([total] * len(ln), pa.int64()), pa.array(row["base"]),
                     pa.array(ln / math.log(10) + np.array(row["tail"]))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(lean(score), SCORES)
