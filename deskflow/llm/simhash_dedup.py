"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 8).

Two fingerprints at most ``2h`` bits apart have a common point at most ``h``
bits from each. So every distinct fingerprint emits all its variants within
``h`` bits (2 081 for 64 bits and h = 2), equal variants meet in a shuffle, and
the fingerprints that meet are verified by their exact Hamming distance. No
pair within the radius is lost, and no two fingerprints that share no variant
are ever compared.

What is shuffled is packed: a task takes up to 4 096 fingerprints, hashes each
variant to a short key (bits grow with the logarithm of the number of variants,
so about one variant in 128 meets a stranger, which the verification drops),
sorts the keys and writes, per bucket of the key space, two bytes of key and
twelve bits of owner for each variant, besides a table of the owners. Where there
are so many buckets that a batch leaves too little in each to pay for the table,
the whole variant is written instead, in the order of its hash, with the number
of its mask: owner = variant ^ mask. That takes less than nine bytes a variant
however many buckets there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import document_columns, lean, materialize, text_rows
from .components import connected_components

SEED = 42
OWNER_BITS = 12
FPS_PER_TASK = 3600  # average; a batch holds at most 2**OWNER_BITS
ENTRIES_PER_BUCKET = 1 << 23
WHOLE_BYTES = 9         # more than a whole variant takes, packed


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the text's word shingles (no word: 0)."""
    words = text.lower().split()  # bytes.lower() is A-Z only; bytes.split() cuts at 09-0D and 20
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[:-shingle] + 1).tolist()]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
    n = len(hashes)
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n - n % 255
    ones = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) for every row; null and empty texts get fingerprint 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t, shingle) for t in text_rows(batch)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return document_columns(docs).mapInArrow(lean(run), "doc_id long, fp long")


def ball(half: int) -> np.ndarray:
    """XOR masks of all points within ``half`` bits of zero."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = rim = np.zeros(1, dtype=np.uint64)
    top = np.full(1, -1)
    for _ in range(half):
        pick = [(r | one[t + 1:], np.arange(t + 1, 64)) for r, t in zip(rim, top)]
        rim, top = (np.concatenate(x) for x in zip(*pick))
        masks = np.concatenate([masks, rim])
    return masks


def _mix(v: np.ndarray) -> None:
    """Spread variants over the key space, in place."""
    v ^= v >> np.uint64(32)
    v *= np.uint64(0x9E3779B97F4A7C15)
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)


def _unmix(v: np.ndarray) -> None:
    """What ``_mix`` made, back in place."""
    v *= np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    v ^= (v >> np.uint64(29)) ^ (v >> np.uint64(58))
    v *= np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    v ^= v >> np.uint64(32)


def _emit(fps: np.ndarray, masks: np.ndarray, key_bits: int, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    """Pack the variants of up to 4 096 fingerprints into one payload per bucket."""
    entries = np.empty(len(fps) * len(masks), dtype=np.uint64)
    for lo in range(0, len(fps), 32):  # small slices stay in cache
        part = fps[lo:lo + 32, None] ^ masks[None, :]
        _mix(part)
        part >>= np.uint64(64 - key_bits)
        part <<= np.uint64(OWNER_BITS)
        part |= np.arange(lo, lo + len(part), dtype=np.uint64)[:, None]
        entries[lo * len(masks):(lo + len(part)) * len(masks)] = part.ravel()
    entries.sort()
    local = key_bits - bucket_bits  # key bits inside a bucket; the low 16 are stored, the rest counted
    for bucket, lo, hi in _parted(entries, bucket_bits, local + OWNER_BITS):
        part = entries[lo:hi]
        owner = (part & np.uint64((1 << OWNER_BITS) - 1)).astype(np.uint16)
        key = (part >> np.uint64(OWNER_BITS)) & np.uint64((1 << local) - 1)
        counts = _counted(key >> np.uint64(16), local - 16)
        if hi - lo < len(fps):  # few entries: carry only the fingerprints they name
            used, owner = np.unique(owner, return_inverse=True)
            table, owner = fps[used], owner.astype(np.uint16)
        else:
            table = fps
        if len(owner) % 2:
            owner = np.append(owner, np.uint16(0))
        a, b = owner[0::2], owner[1::2]
        packed = np.stack([a & 255, (a >> 8) | ((b & 15) << 4), b >> 4], axis=1).astype(np.uint8)
        head = np.array([len(table), hi - lo, counts.itemsize], dtype="<u4")
        yield bucket, b"".join(x.tobytes() for x in (head, table, counts, key.astype("<u2"), packed))


def _parted(ordered: np.ndarray, bucket_bits: int, below: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that some of the ordered numbers are in; it is their bits from ``below`` on."""
    edges = np.searchsorted(ordered, np.arange(1, 1 << bucket_bits, dtype=np.uint64) << np.uint64(below))
    for bucket, (lo, hi) in enumerate(zip([0, *edges.tolist()], [*edges.tolist(), len(ordered)])):
        if lo < hi:
            yield bucket, lo, hi


def _counted(slot: np.ndarray, bits: int) -> np.ndarray:
    counts = np.bincount(slot.astype(np.int64), minlength=1 << bits)
    return counts.astype("<u1" if counts.max() < 256 else "<u4")


def _emit_whole(fps: np.ndarray, masks: np.ndarray, bucket_bits: int) -> Iterator[tuple[int, bytes]]:
    """As ``_emit``, with whole variants: the leading bits counted, the others and the mask's number packed."""
    mixed = (fps[:, None] ^ masks[None, :]).ravel()
    _mix(mixed)
    order = np.argsort(mixed)
    mixed = mixed[order]
    mask = (order % len(masks)).astype(np.uint64)
    mask_bits = (len(masks) - 1).bit_length()
    for bucket, lo, hi in _parted(mixed, bucket_bits, 64 - bucket_bits):
        local = 64 - bucket_bits
        part = mixed[lo:hi] & np.uint64((1 << local) - 1)
        slots = max(local + mask_bits - 64, min(local, (hi - lo).bit_length() - 1))  # leading bits that are counted
        counts = _counted(part >> np.uint64(local - slots), slots) if slots else np.array([hi - lo], "<u4")
        rest = ((part & np.uint64((1 << (local - slots)) - 1)) << np.uint64(mask_bits)) | mask[lo:hi]
        width = -(-(local - slots + mask_bits) // 8)
        packed = rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
        head = np.array([0, hi - lo, counts.itemsize | slots << 8], dtype="<u4")
        yield bucket, b"".join(x.tobytes() for x in (head, counts, packed))


def _unpack(payload: bytes, local: int, masks: np.ndarray, bucket: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(local key of every entry, its owner's place in the table, table of fingerprints) of one payload."""
    n_table, n, width = np.frombuffer(payload, "<u4", 3).tolist()
    at = 12
    if not n_table:  # whole variants
        slots, width = width >> 8, width & 255
        counts = np.frombuffer(payload, f"<u{width}", 1 << slots, at)
        at += width * len(counts)
        inside, mask_bits = 64 - bucket_bits, (len(masks) - 1).bit_length()
        rest = np.zeros((n, 8), np.uint8)
        size = -(-(inside - slots + mask_bits) // 8)
        rest[:, :size] = np.frombuffer(payload, np.uint8, n * size, at).reshape(n, size)
        rest = rest.view("<u8").ravel()
        variant = np.repeat(np.arange(len(counts), dtype=np.uint64), counts) << np.uint64(inside - slots) if slots else np.zeros(n, np.uint64)
        variant |= rest >> np.uint64(mask_bits)
        key = variant >> np.uint64(inside - local)
        if bucket_bits:
            variant |= np.uint64(bucket << inside)
        _unmix(variant)
        return key, np.arange(n), variant ^ masks[(rest & np.uint64((1 << mask_bits) - 1)).astype(np.int64)]
    table = np.frombuffer(payload, "<u8", n_table, at)
    at += 8 * n_table
    counts = np.frombuffer(payload, f"<u{width}", 1 << (local - 16), at)
    at += width * len(counts)
    low = np.frombuffer(payload, "<u2", n, at)
    at += 2 * n
    x = np.frombuffer(payload, np.uint8, (n + n % 2) // 2 * 3, at).reshape(-1, 3).astype(np.uint16)
    owner = np.stack([x[:, 0] | ((x[:, 1] & 15) << 8), (x[:, 1] >> 4) | (x[:, 2] << 4)], axis=1).ravel()[:n]
    high = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    high <<= np.uint64(16)
    high |= low
    return high, owner, table


def _gather(payloads: list[bytes], local: int, masks: np.ndarray, bucket: int, bucket_bits: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Entries of one bucket sorted by key (key and owner's number in one word); fingerprint of each number; number bits."""
    heads = [(t or n, n) for t, n in (np.frombuffer(p, "<u4", 2).tolist() for p in payloads)]
    span = max(1, sum(n for n, _ in heads).bit_length())
    order, tables, at, known = np.empty(sum(n for _, n in heads), np.uint64), [], 0, 0
    for payload, (n_table, n) in zip(payloads, heads):
        key, owner, table = _unpack(payload, local, masks, bucket, bucket_bits)
        key <<= np.uint64(span)
        key |= owner.astype(np.uint64) + np.uint64(known)
        order[at:at + n] = key
        tables.append(table)
        at, known = at + n, known + n_table
    order.sort()
    return order, np.concatenate(tables), span


def _meet(order: np.ndarray, owner: np.ndarray, span: int, radius: int) -> np.ndarray:
    """Links (m, 2) between owners that share a key and lie within ``radius`` bits.

    ``order`` has key and owner's number (the lower ``span`` bits), sorted;
    ``owner`` the fingerprint of each number. Of the owners of one key, the
    smallest is compared with all. Owners of the same variant lie within the
    radius of it, so they all hang on it. Owners beyond (strangers with the same
    key) are compared with every owner of the key, so no link is lost. Pairwise
    links are not written out: linked owners end up in one component either way.
    """
    same = (order[1:] ^ order[:-1]) < np.uint64(1 << span)
    shared = np.zeros(len(order), dtype=bool)
    shared[1:] |= same
    shared[:-1] |= same
    hit = order[shared]
    if not len(hit):
        return np.empty((0, 2), dtype=np.uint64)
    run_key = hit >> np.uint64(span)
    who = owner[(hit & np.uint64((1 << span) - 1)).astype(np.int64)]
    first = np.concatenate([[True], run_key[1:] != run_key[:-1]])
    begin = np.flatnonzero(first)
    run = np.cumsum(first) - 1
    centre = np.minimum.reduceat(who, begin)[run]
    far = np.bitwise_count(who ^ centre) > radius
    near = ~far & (who != centre)
    links = [np.stack([centre[near], who[near]], axis=1)]
    size = np.diff(np.append(begin, len(who)))
    for r in np.unique(run[far]):
        if size[r] < 3:
            continue
        group = np.unique(who[begin[r]:begin[r] + size[r]])
        rest = group[np.bitwise_count(group ^ group[0]) > radius]
        for x in rest:
            near_x = group[(np.bitwise_count(group ^ x) <= radius) & (group != x)]
            links.append(np.stack([np.full(len(near_x), x), near_x], axis=1))
    return np.concatenate(links)


def _forest(links: np.ndarray) -> np.ndarray:
    """A spanning forest of the links: as many rows as needed to keep every connection."""
    nodes, flat = np.unique(links, return_inverse=True)
    flat = flat.reshape(links.shape)
    pairs = np.unique(flat.min(axis=1) * np.int64(len(nodes)) + flat.max(axis=1))
    parent = list(range(len(nodes)))
    kept = []
    for p in pairs.tolist():
        a, b = divmod(p, len(nodes))
        x, y = a, b
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return nodes[np.array(kept, dtype=np.int64).reshape(-1, 2)]


def layout(total: int, n_masks: int) -> tuple[int, int, bool]:
    """(bits of a bucket's number, bits of a key, whether whole variants are written) for so many distinct fingerprints."""
    entries = max(1, total * n_masks)
    bucket_bits = max(0, math.ceil(math.log2(entries / ENTRIES_PER_BUCKET)))
    key_bits = max(math.ceil(math.log2(entries)) + 7, bucket_bits + 17)
    # with owners' table and counts a payload costs 8 bytes for each owner it names and one for every 2^16 keys, besides 3.5 an entry
    left = FPS_PER_TASK * n_masks / (1 << bucket_bits)
    whole = 3.5 + 8 * min(1, FPS_PER_TASK / left) + (1 << (key_bits - bucket_bits - 16)) / left > WHOLE_BYTES
    return bucket_bits, key_bits, whole


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) that connect all distinct ``fps(fp)`` within ``radius`` bits.

    The result spans the same components as all pairs within the radius would;
    each bucket's task writes a spanning forest of the links it found.
    """
    total = fps.count()
    masks = ball((radius + 1) // 2)
    bucket_bits, key_bits, whole = layout(total, len(masks))
    local = key_bits - bucket_bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.asarray(batch.column(0))])
            while len(held) >= 1 << OWNER_BITS:
                yield from rows(held[:1 << OWNER_BITS])
                held = held[1 << OWNER_BITS:]
        if len(held):
            yield from rows(held)

    def rows(part: np.ndarray) -> Iterator[pa.RecordBatch]:
        fps = np.sort(part.view(np.uint64))
        for bucket, payload in _emit_whole(fps, masks, bucket_bits) if whole else _emit(fps, masks, key_bits, bucket_bits):
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([payload], pa.binary())],
                                             ["bucket", "payload"])

    def collide(group: pd.DataFrame) -> pd.DataFrame:
        links = _forest(_meet(*_gather(list(group.payload), local, masks, int(group.bucket.iloc[0]), bucket_bits), radius))
        return pd.DataFrame({"a": links[:, 0].view(np.int64), "b": links[:, 1].view(np.int64)})

    tasks = max(1, math.ceil(total / FPS_PER_TASK))
    packed = fps.select("fp").repartition(tasks, "fp").mapInArrow(lean(emit), "bucket int, payload binary")
    packed = packed.repartition(1 << bucket_bits, "bucket")  # about a bucket a task
    return packed.groupBy("bucket").applyInPandas(collide, "a long, b long")


def _named(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint in ``marked(doc_id, fp)``."""
    distinct = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fps")
    parts = connected_components(ball_links(distinct, radius))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Exact copies share a fingerprint, so they are folded to one before the
    ball hashing; near copies are linked at ``radius`` bits or fewer.
    component_id is the smallest doc_id reachable, the row's own included.

    Null and empty texts and texts without a word have fingerprint zero and
    link like any other. Texts of fewer words than a shingle are one shingle.
    Repeated rows are kept. A null doc_id keeps its row and never names a
    component (a component of null ids only has a null component_id). An empty
    table gives an empty result; other columns are ignored.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    return marked.join(_named(marked, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component stays.

    That row has the component's smallest doc_id. Of several rows with that id
    (ties, repeated rows) the first by text and then by the other columns
    stays; of a component without any id, the first row by the same order.

    Only ids meet the documents: the join with the ids that go is a broadcast
    while Spark finds their table small, a shuffle join beyond.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    named = materialize(_named(marked, radius), "components")
    repeated = materialize(marked.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_id")), "repeated")
    gone = marked.join(named, "fp").where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"))
    gone = materialize(gone.union(repeated).distinct(), "dropped-ids")
    kept = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["_id"]), "left_anti")
    if repeated.isEmpty():
        return kept

    # ids on several rows: decide by row, with the row's own fingerprint
    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        raw = (fingerprint((t or "").encode(), shingle) for t in texts)
        return pd.Series(np.fromiter(raw, dtype=np.uint64, count=len(texts)).view(np.int64))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(repeated, docs["doc_id"].cast("long").eqNullSafe(repeated["_id"]), "left_semi")
    rows = rows.select(F.struct(*columns).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                       F.col("text").cast("string").alias("_text"), print_of(F.col("text").cast("string")).alias("fp"))
    rows = rows.join(named, "fp").where(F.col("_id").eqNullSafe(F.col("component_id")))
    first = rows.groupBy("component").agg(F.min(F.struct("_text", "_row")).alias("_first"))
    return kept.unionByName(first.select("_first._row.*"))
