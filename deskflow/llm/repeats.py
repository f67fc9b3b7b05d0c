"""Exact removal of repeated byte strings by prefix-free parsing (operator 12).

A byte goes if a string of ``length`` bytes that covers it also starts anywhere
else in the corpus. The suffix array of the whole corpus would show such strings
as neighbours; prefix-free parsing gets there without sorting every suffix.

1. Parse. A rolling hash runs over every text. Each start of a string has a
   trigger: the smallest hash (the first, if several) among the next ``span``
   positions, which the string's own bytes decide. So equal strings have their
   trigger at the same place, and a text's triggers cut it into phrases of at
   most ``span`` bytes. All starts with one trigger make one record.
2. Dictionary. Records are counted by the bytes after their trigger that every
   one of their strings holds (``key``). Only keys seen twice can hold a repeat;
   all other phrases end here. Records that agree in all their bytes
   (``context``) are one entry with a count; a count of two settles every string
   in it.
3. Corpus order. The remaining entries of a key meet in one task, many keys at a
   time. Put in order after the trigger, and before it backwards, neighbours tell
   how far each entry agrees with any other, which leaves few starts. These are
   parsed again (``corpus_order``): the suffix array of the dictionary of distinct
   phrases and the suffix array of the parse (both by prefix doubling) combine
   into the order of all their strings, and neighbours are compared byte by byte.

A key with very many entries is dealt over several tasks by entry. Each of them
settles what it can by the same order and passes one digest for each string that
is left, or for each class of equal ones; these digests are counted by a shuffle
that sums before it sends. Nothing is dropped or capped, and no group is ever
whole in one task.

Texts are shuffled once, to meet their records; documents without records
shared with others are not touched again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, sub_batches, text_rows

GRAM = 16               # bytes under the rolling hash
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
BATCH_BYTES = 4_000_000
CHUNK = 1 << 19         # positions hashed at once, so that long texts need bounded memory
PLACE_BITS = 20         # more than a chunk's places need
ENTRIES = 1 << 14       # entries of a key that one task takes; further ones go to further tasks
ORDER_BYTES = 4_000_000  # entries' bytes put in order at once
TASK_BYTES = 16_000_000  # entries' bytes for a task
PHRASE_GRAM, PHRASE_STEP = 8, 32  # triggers inside a task: windows of 8 bytes, one in 32


def rolling(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every window of ``gram`` (a power of two) bytes."""
    h, width, base = data.astype(np.uint64) + np.uint64(1), 1, BASE
    with np.errstate(over="ignore"):
        while width < gram:
            h = h[:-width] * base + h[width:]
            base, width = base * base, 2 * width
        h ^= h >> np.uint64(29)
        h *= MIX
    h ^= h >> np.uint64(32)
    return h


def first_smallest(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the smallest of the hashes' upper 44 bits, the first of equal ones, in every window of ``span`` hashes."""
    low = np.uint64((1 << PLACE_BITS) - 1)
    best, width = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while width < span:
        step = min(width, span - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    return (best & low).astype(np.int64)


def records(data: np.ndarray, bounds: np.ndarray, length: int, span: int, gram: int):
    """(text, trigger, first, last): each trigger with the run of starts that have it, as places in ``data``.

    ``bounds``: where each text starts in ``data``, and the end.
    """
    pieces = []
    for low in range(0, len(data) - length + 1, CHUNK):
        high = min(low + CHUNK, len(data) - length + 1)
        part = data[low:high + span + gram - 2]
        pieces.append(first_smallest(rolling(part, gram), span)[:high - low] + low)
    if not pieces:
        return (np.zeros(0, np.int64),) * 4
    trigger = np.concatenate(pieces)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:len(trigger)]
    start = np.flatnonzero(np.arange(len(trigger)) + length <= bounds[text + 1])  # strings lie inside one text
    text, trigger = text[start], trigger[start]
    new = np.flatnonzero(np.concatenate([[True], (np.diff(trigger) != 0) | (np.diff(text) != 0)])) if len(start) else start
    return text[new], trigger[new], start[new], start[np.append(new[1:], len(start)) - 1] if len(start) else start


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, bounds)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]] if data is not None and bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    return whole, bounds - bounds[0]


# --- corpus order of a set of byte strings ------------------------------------

def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rank of every suffix (up to its segment's end) by content; equal suffixes have equal ranks.

    Prefix doubling; ``ends[i]`` is the end of the segment that place i is in.
    """
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64) + 1
    classes, width, here = int(rank.max(initial=0)), 1, np.arange(len(symbols))
    while True:
        ahead = here + width
        inside = ahead < ends
        if not inside.any():
            return rank
        after = np.where(inside, rank[np.minimum(ahead, len(rank) - 1)], 0)
        rank = np.unique(rank * (classes + 1) + after, return_inverse=True)[1].astype(np.int64) + 1
        more = int(rank.max())
        if more == classes:
            return rank
        classes, width = more, 2 * width


def corpus_order(strings: list[bytes], starts: np.ndarray, gram: int = PHRASE_GRAM, step: int = PHRASE_STEP):
    """(string, place): the first ``starts[j]`` suffixes of every string j, in lexicographic order.

    Prefix-free parsing: a phrase runs from one trigger window to the end of the
    next, the last to the end mark. No phrase's end is a proper prefix of
    another's, so the suffix at a place is ordered by the rank of what is left
    of its phrase (dictionary), then by the rank of the phrases after (parse).
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    begin = np.cumsum(sizes + gram) - (sizes + gram)
    text = np.zeros(int(sizes.sum()) + gram * len(strings), np.uint16)  # 0 marks ends, bytes are 1 to 256
    owner = np.repeat(np.arange(len(strings)), sizes + gram)
    inside = np.arange(len(text)) - begin[owner] < sizes[owner]
    text[inside] = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint16) + 1

    cut = np.zeros(len(text), bool)
    if len(text) >= gram:
        cut[:len(text) - gram + 1] = rolling(text, gram) % np.uint64(step) == 0
    cut &= np.arange(len(text)) + gram <= (begin + sizes)[owner]  # windows of real bytes only
    cut[begin] = True
    phrase_at = np.flatnonzero(cut)
    phrase_end = np.append(phrase_at[1:], len(text)) + gram
    last = np.append(owner[phrase_at[1:]] != owner[phrase_at[:-1]], True)
    phrase_end[last] -= gram  # the end mark is already part of the string

    raw, dictionary = text.tobytes(), {}
    code = np.array([dictionary.setdefault(raw[2 * a:2 * b], len(dictionary)) for a, b in zip(phrase_at.tolist(), phrase_end.tolist())])
    entry = np.array([len(p) // 2 for p in dictionary], dtype=np.int64)
    entry_at = np.cumsum(entry) - entry
    suffixes = suffix_ranks(np.frombuffer(b"".join(dictionary), np.uint16), np.repeat(entry_at + entry, entry))
    parse_end = np.searchsorted(owner[phrase_at], owner[phrase_at], side="right")
    parse = suffix_ranks(suffixes[entry_at][code], parse_end)

    which = np.repeat(np.arange(len(strings)), starts)
    place = np.arange(int(starts.sum())) - np.repeat(np.cumsum(starts) - starts, starts)
    at = begin[which] + place
    phrase = np.searchsorted(phrase_at, at, side="right") - 1
    left = suffixes[entry_at[code[phrase]] + at - phrase_at[phrase]]
    following = np.where(phrase + 1 < parse_end[phrase], np.append(parse, 0)[phrase + 1], 0)
    order = np.lexsort((following, left))
    return which[order], place[order]


def equal_classes(strings: list[bytes], starts: np.ndarray, length: int) -> np.ndarray:
    """Class of every string of ``length`` bytes at the first ``starts[j]`` places of string j; equal strings share one."""
    which, place = corpus_order(strings, starts)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    data = np.frombuffer(b"".join(strings), np.uint8)
    windows = np.lib.stride_tricks.sliding_window_view(data, length)
    at = (np.cumsum(sizes) - sizes)[which] + place
    same = np.zeros(len(at), bool)
    for low in range(1, len(at), 8192):  # neighbours in corpus order, byte by byte
        high = min(low + 8192, len(at))
        same[low:high] = (windows[at[low:high]] == windows[at[low - 1:high - 1]]).all(axis=1)
    classes = np.cumsum(~same) - 1
    out = np.empty(len(at), np.int64)
    out[(np.cumsum(starts) - starts)[which] + place] = classes
    return out


# --- Spark -------------------------------------------------------------------

def runs(places: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive places."""
    for part in np.split(places, np.flatnonzero(np.diff(places) != 1) + 1):
        if len(part):
            yield int(part[0]), int(part[-1])


def _identified(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash); rows that agree in id and text are one document for this operator."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["text_hash"] == b["text_hash"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def spans_of(column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """Each row's (first, last) pairs of a column of arrays of them (null: none)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(column), 0), dtype=np.int64)).tolist()
    pairs = list(zip(*(c.to_pylist() for c in column.flatten().flatten())))
    return (pairs[a:b] for a, b in zip([0, *ends], ends))


class Parser:
    def __init__(self, length: int, span: int | None, gram: int):
        self.length, self.gram = length, min(gram, 1 << (max(1, length // 4)).bit_length() - 1)
        self.span = span or max(1, length * 5 // 8)
        self.key_bytes = length - self.span + 1
        if self.span + self.gram - 1 > length or self.span > 1 << 15:
            raise ValueError("a string must hold the windows that decide its trigger")

    def records(self, data: np.ndarray, bounds: np.ndarray):
        return records(data, bounds, self.length, self.span, self.gram)


def _parse(texts: DataFrame, parser: Parser) -> DataFrame:
    """(key, context, doc_id, text_hash, at, lead, run): the records of every text.

    at: the trigger; lead: the first start is so far before it; run: the last
    start is so far after the first.
    """
    schema = "key long, context long, doc_id long, text_hash long, at int, lead smallint, run smallint"
    arrow = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32()),
                       ("lead", pa.int16()), ("run", pa.int16())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            data, bounds = text_bytes(batch.column("text"))
            text, trigger, first, last = parser.records(data, bounds)
            raw, size = memoryview(data), parser.key_bytes
            key = np.array([digest(raw[t:t + size]) for t in trigger.tolist()], dtype=np.uint64)
            context = np.array([digest(raw[a:b], 1) for a, b in zip(first.tolist(), (last + parser.length).tolist())], dtype=np.uint64)
            rows = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(context.view(np.int64)),
                                              batch.column("doc_id").take(rows), batch.column("text_hash").take(rows),
                                              pa.array((trigger - bounds[text]).astype(np.int32)), pa.array((trigger - first).astype(np.int16)),
                                              pa.array((last - first).astype(np.int16))], schema=arrow)

    return texts.mapInArrow(lean(run), schema)


def _entries(touched: DataFrame, length: int) -> DataFrame:
    """(key, share, shares, settled, doc_id, text_hash, first, lead, bytes) of the records that stand for their entry."""
    schema = "key long, share int, shares int, settled boolean, doc_id long, text_hash long, first int, lead smallint, bytes binary"
    arrow = pa.schema([("key", pa.int64()), ("share", pa.int32()), ("shares", pa.int32()), ("settled", pa.bool_()), ("doc_id", pa.int64()),
                       ("text_hash", pa.int64()), ("first", pa.int32()), ("lead", pa.int16()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            rows = []
            for text, doc, text_hash, marks in zip(text_rows(batch), *(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "stand"))):
                for m in marks:
                    first = m["at"] - m["lead"]
                    rows.append((m["key"], m["share"], m["shares"], m["settled"], doc, text_hash, first, m["lead"], text[first:first + m["run"] + length]))
                if len(rows) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return touched.where(F.size("stand") > 0).select("doc_id", "text_hash", "text", "stand").mapInArrow(lean(run), schema)


def agreement(parts: list[bytes], groups: np.ndarray, most: int) -> np.ndarray:
    """With how many of its first bytes (``most`` at most) each part agrees with any other part of its group.

    Neighbours in lexicographic order agree furthest.
    """
    parts = [p[:most] for p in parts]
    order = sorted(range(len(parts)), key=lambda i: (groups[i], parts[i]))
    sizes = np.array([len(parts[i]) for i in order], dtype=np.int64)
    table = np.zeros((len(parts), most + 1), np.uint8)
    table[np.arange(most + 1) < sizes[:, None]] = np.frombuffer(b"".join(parts[i] for i in order), np.uint8)
    differ = table[1:] != table[:-1]
    differ[:, most] = True
    shared = np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))
    shared[groups[order][1:] != groups[order][:-1]] = 0
    out = np.zeros(len(parts), np.int64)
    out[order] = np.maximum(np.append(0, shared), np.append(shared, 0))
    return out


def _in_order(entries: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_hash, first, last, digest): starts of repeated strings, found through the corpus order of each key's entries.

    Where a key has several shares, rows with a digest (of the string) are left
    to be counted: those with ``first`` are starts not settled in their share,
    those without stand for a class of equal strings that is.
    """
    schema = "doc_id long, text_hash long, first int, last int, digest binary"
    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("digest", pa.binary())])

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        """``rows`` hold whole keys, or whole shares of keys that have several."""
        strings = [r[8] for r in rows]
        starts = np.array([len(s) - length + 1 for s in strings], dtype=np.int64)
        groups = np.cumsum([False] + [a[:2] != b[:2] for a, b in zip(rows, rows[1:])])
        lead = np.array([r[7] for r in rows], dtype=np.int64)
        after = agreement([s[a:] for s, a in zip(strings, lead.tolist())], groups, length)
        before = agreement([s[:a][::-1] for s, a in zip(strings, lead.tolist())], groups, int(lead.max(initial=0)))
        # a start so far before the trigger agrees with another entry's there, and in the rest of its bytes after it
        low, high = np.maximum(lead - before, 0), np.minimum(lead - (length - after), starts - 1) + 1
        shared = np.array([r[2] > 1 for r in rows])  # entries of other shares are not seen here
        low, high = np.where(shared, 0, low), np.where(shared, starts, high)
        some = np.flatnonzero(low < high)
        if not len(some):
            return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in arrow], schema=arrow)
        low, number = low[some], (high - low)[some]
        strings = [strings[i][a:a + n + length - 1] for i, a, n in zip(some.tolist(), low.tolist(), number.tolist())]
        classes = equal_classes(strings, number, length)
        copies = np.repeat([2 if rows[i][3] else 1 for i in some.tolist()], number)
        repeated = np.bincount(classes, weights=copies)[classes] > 1
        out, passed, at = [], set(), 0
        for i, string, a, n in zip(some.tolist(), strings, low.tolist(), number.tolist()):
            _, _, shares, settled, doc, text_hash, first, _, _ = rows[i]
            found = repeated[at:at + n]
            first += a
            if not settled:
                out += [(doc, text_hash, first + p, first + q, None) for p, q in runs(np.flatnonzero(found))]
            if shares > 1:
                for p in range(n):
                    if not found[p]:
                        out.append((doc, text_hash, first + p, first + p, xxhash.xxh3_128_digest(string[p:p + length])))
                    elif (c := int(classes[at + p])) not in passed:
                        passed.add(c)
                        out.append((None, None, None, None, xxhash.xxh3_128_digest(string[p:p + length])))
            at += n
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)] if out else [pa.array([], f.type) for f in arrow],
                                          schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, group = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= ORDER_BYTES and row[:2] != group:  # the rows of a key and share stay together
                    yield settle(held)
                    held, size = [], 0
                group = row[:2]
                held.append(row)
                size += len(row[8])
        if held:
            yield settle(held)

    return entries.mapInArrow(lean(run), schema)


def _marked(texts: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, text_hash, whole, stand): of every document, its records that others share.

    whole: (first, last) starts of the records that another one agrees with in
    all their bytes; stand: the records that stand for their entry where its key
    has others, with the key and its share of entries.
    """
    parsed = materialize(_parse(texts, parser), "parse")
    again = materialize(parsed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "repeated")
    shared = materialize(parsed.join(again, "key", "left_semi"), "shared")
    one = F.min(F.struct("doc_id", "text_hash", "at", "lead", "run"))
    entries = materialize(shared.groupBy("key", "context").agg(F.count(F.lit(1)).alias("n"), one.alias("one")), "dictionary")
    keys = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "keys")
    shares = F.ceil(F.col("m") / F.lit(ENTRIES)).cast("int")
    stand = entries.join(keys, "key").select("one.doc_id", "one.text_hash", F.lit(None).cast("struct<first:int,last:int>").alias("w"), F.struct(
        "key", F.pmod("context", shares).cast("int").alias("share"), shares.alias("shares"), (F.col("n") > 1).alias("settled"),
        "one.at", "one.lead", "one.run").alias("s"))
    settled = materialize(entries.where("n > 1").select("key", "context"), "settled")
    first = (F.col("at") - F.col("lead")).cast("int")
    whole = shared.join(settled, ["key", "context"], "left_semi").select(
        "doc_id", "text_hash", F.struct(first.alias("first"), (first + F.col("run")).cast("int").alias("last")).alias("w"),
        F.lit(None).cast(stand.schema["s"].dataType).alias("s"))
    return whole.unionByName(stand).groupBy("doc_id", "text_hash").agg(F.collect_set("w").alias("whole"), F.collect_set("s").alias("stand"))


def _touched(texts: DataFrame, parser: Parser) -> DataFrame:
    """(doc_id, text_hash, text, whole, stand) of the documents with shared records."""
    marked = _marked(texts, parser)
    return texts.join(marked, _same(texts, marked)).select(texts["doc_id"], texts["text_hash"], "text", "whole", "stand")


def cut_documents(docs: DataFrame, length: int = 400, span: int | None = None, gram: int = GRAM) -> DataFrame:
    """(doc_id, text_hash, spans, kept): the documents of ``docs(doc_id, text)`` that lose bytes.

    spans: the maximal removed runs, array of (start, end) in bytes, ascending;
    kept: the other bytes, concatenated (binary: a cut may part a code point);
    text_hash: xxhash64 of the text, which with doc_id identifies its rows.

    Strings never cross documents. Every string of ``length`` bytes that occurs
    twice counts, also twice in one document and also overlapping itself;
    strings are judged on the input. So equal texts of ``length`` bytes or more
    lose everything, in every one of their rows, repeated rows included. Rows
    that agree in id (null is an id) and text give one row here. Null, empty and
    shorter texts lose nothing, nor does an empty table. Other columns, whatever
    their names, are ignored.
    """
    parser = Parser(length, span, gram)
    texts = _identified(docs).where(F.octet_length("text") >= length)
    touched = materialize(_touched(texts, parser), "touched")
    entries = materialize(_entries(touched, length), "entries")
    size = entries.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    dealt = entries.repartition(tasks, "key", "share").sortWithinPartitions("key", "share")
    found = materialize(_in_order(dealt, length), "found")
    left = found.where("digest is not null")
    twice = materialize(left.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "twice")
    met = left.where("first is not null").join(twice, "digest", "left_semi")
    starts = found.where("digest is null").unionByName(met).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("first", "last")).alias("starts"))
    both = touched.join(starts, _same(touched, starts), "left").select(touched["doc_id"], touched["text_hash"], "text", "whole", "starts")
    schema = "doc_id long, text_hash long, spans array<struct<start:int,end:int>>, kept binary"
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    arrow = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("spans", span_type), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash"))
            for text, doc, text_hash, *starts in zip(text_rows(batch), *columns, spans_of(batch.column("whole")), spans_of(batch.column("starts"))):
                spans = []
                for a, b in sorted(starts[0] + starts[1]):
                    if spans and a <= spans[-1][1]:
                        spans[-1][1] = max(b + length, spans[-1][1])
                    else:
                        spans.append([a, b + length])
                if spans:
                    edges = [0, *(x for s in spans for x in s), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    rows.append((doc, text_hash, [{"start": a, "end": b} for a, b in spans], kept))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return both.mapInArrow(lean(run), schema)


def removal_digests(docs: DataFrame, length: int = 400, span: int | None = None, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row of ``docs``.

    Documents that lose nothing are digested where they are read; only digests
    meet the cut documents. Cases as in ``cut_documents``; an empty text has no
    bytes and the digest of none.
    """
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    cut = cut_documents(docs, length, span, gram).select(
        "doc_id", "text_hash", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256")).dropDuplicates(["doc_id", "text_hash"])
    whole = _identified(docs).select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"),
                                     F.sha2(F.col("text").cast("binary"), 256).alias("whole_sha256"))
    return whole.join(cut, _same(whole, cut), "left").select(
        whole["doc_id"], "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
