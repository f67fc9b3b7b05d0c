"""Token ids of whole texts in checksummed binary blocks (operator 9).

``write_tokens`` tokenizes every document, orders all of them by id with a
range partitioning (no task sees more than its range), and writes blocks of
whole documents coded by ``rangecoder``. A file row is one block: its place
(part, block), its documents' ids and token counts, and the coded payload.
Spark's Parquet writer is the container, so the files reach any shared store
and a lost executor's attempt never leaves half a file. ``read_tokens`` decodes
the blocks, alone and in any order, and verifies both checksums of each.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rangecoder
from .bytewords import LOWER, distinct, split_words, translate
from .common import document_columns, lean, sub_batches

BLOCK_TOKENS = 1 << 21
BATCH_BYTES = 12_000_000
END_ID = 1
FILE_SCHEMA = ("part int, block int, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, payload binary")
SAME = bytes(range(256))
LINE = 64  # runs tokenized in one call
KNOWN_RUNS = 300_000  # runs whose ids a worker keeps (about 40 bytes each); further ones are tokenized again
# the pre-tokenizer pattern that cuts_runs knows, the words it cuts as PARTS does (no apostrophe, no sign of an added token,
# no letter whose lower case or composition changes its class), and their parts in lower case
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = "^[!-&(-;=-~À-ÖØ-öø-ÿ]+$"
PARTS = "([a-zÀ-ÖØ-öø-ÿ]+|[0-9]|[^a-z0-9À-ÖØ-öø-ÿ]+)"


def load_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def cuts_runs(tokenizer) -> bool:
    """Whether the tokenizer lower-cases and then takes runs of letters, single digits and runs of other signs one by one.

    Only then can ``SIMPLE`` words be cut there and lower-cased before it. No
    such word may hold an added token.
    """
    parts = json.loads(tokenizer.to_str())
    listed = lambda part, inner: (part or {}).get(inner) or [part or {}]
    normal = [step.get("type") for step in listed(parts["normalizer"], "normalizers")]
    first = listed(parts["pre_tokenizer"], "pretokenizers")[0]
    return (normal[-1] == "Lowercase" and set(normal) <= {"NFC", "Replace", "Lowercase"} and parts["post_processor"] is None
            and all(s["pattern"] == {"Regex": r"\s+"} for s in listed(parts["normalizer"], "normalizers") if s["type"] == "Replace")
            and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", {"Regex": RUNS}, "Removed", True)
            and not any(re.search(SIMPLE, t["content"]) for t in parts["added_tokens"]))


def ragged(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that begin at ``place``, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(place - ends + size, size) + np.arange(int(ends[-1]) if len(ends) else 0)


def each_alone(tokenizer, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, how many each has)."""
    found = [e.ids for lo in range(0, len(words), 20_000) for e in tokenizer.encode_batch(words[lo:lo + 20_000], add_special_tokens=False)]
    return np.array([i for p in found for i in p], dtype=np.uint32), np.array([len(p) for p in found], dtype=np.int64)


def runs_in_line(tokenizer, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``each_alone`` of runs that the tokenizer takes one by one, ``LINE`` of them in a call."""
    ids, sizes = [], []
    for lo in range(0, len(runs), LINE):
        line = runs[lo:lo + LINE]
        found = tokenizer.encode(" ".join(line), add_special_tokens=False)
        size = np.bincount(np.array(found.word_ids, dtype=np.int64), minlength=len(line))
        if len(size) != len(line) or not size.all():
            raise ValueError("the tokenizer does not take runs one by one")
        ids.append(np.array(found.ids, dtype=np.uint32))
        sizes.append(size)
    return np.concatenate([np.zeros(0, np.uint32), *ids]), np.concatenate([np.zeros(0, np.int64), *sizes])


class Known:
    """Runs that this process has tokenized before, ``most`` at most: the tasks of a worker meet the same frequent ones."""

    def __init__(self, tokenizer, most: int = KNOWN_RUNS):
        self.tokenizer, self.most = tokenizer, most
        self.runs = pa.array([], pa.large_string())
        self.ids, self.place, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def tokenize(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each run's begin, how many it has) of distinct ``runs``; only new ones are tokenized."""
        at = np.asarray(pc.fill_null(pc.index_in(runs, value_set=self.runs), -1), dtype=np.int64)
        new = at < 0
        fresh = runs.filter(pa.array(new))
        new_ids, new_size = runs_in_line(self.tokenizer, fresh.to_pylist())
        ids = np.concatenate([self.ids, new_ids])
        new_place = len(self.ids) + np.cumsum(new_size) - new_size
        place, size = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
        place[~new], size[~new], place[new], size[new] = self.place[at[~new]], self.size[at[~new]], new_place, new_size
        keep = max(0, min(self.most - len(self.runs), len(fresh)))
        if keep:
            self.runs = pa.concat_arrays([self.runs, fresh[:keep].cast(pa.large_string())])
            self.ids = np.concatenate([self.ids, new_ids[:int(new_size[:keep].sum())]])
            self.place, self.size = np.concatenate([self.place, new_place[:keep]]), np.concatenate([self.size, new_size[:keep]])
        return ids, place, size


@functools.lru_cache(maxsize=1)
def _loaded(path: str, changed: int):
    tokenizer = load_tokenizer(path)
    return tokenizer, Known(tokenizer) if cuts_runs(tokenizer) else None


def vocabulary_ids(tokenizer, vocabulary: pa.Array, known: Known | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, where each word's begin, how many it has): each distinct run of the simple words, and each other word, is tokenized once."""
    if known is None:
        ids, size = each_alone(tokenizer, vocabulary.to_pylist())
        return ids, np.cumsum(size) - size, size
    simple = pc.match_substring_regex(vocabulary, SIMPLE)
    cut = pc.replace_substring_regex(translate(vocabulary.filter(simple), LOWER), PARTS, r"\1 ")
    bounds, parts = split_words(cut)
    index, different = distinct(parts) if len(parts) else (np.zeros(0, np.int64), pa.array([], pa.large_string()))
    run_ids, run_place, run_size = known.tokenize(different)
    total = np.concatenate([[0], np.cumsum(run_size[index])])
    other_ids, other_size = each_alone(tokenizer, vocabulary.filter(pc.invert(simple)).to_pylist())
    ids = np.concatenate([run_ids[ragged(run_place[index], run_size[index])], other_ids])
    is_simple = np.asarray(simple)
    size, place = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    size[is_simple], size[~is_simple] = np.diff(total[bounds]), other_size
    place[is_simple], place[~is_simple] = total[bounds[:-1]], int(total[-1]) + np.cumsum(other_size) - other_size
    return ids, place, size


def token_ids(tokenizer, texts: pa.Array, end_id: int = END_ID, known: Known | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, each followed by the end id; ids of each text).

    For tokenizers that drop white space and never merge across it: each
    distinct white-space-free piece of the batch is tokenized once, and with
    ``known`` (if ``cuts_runs``) each distinct run of such pieces.
    """
    bounds, words = split_words(translate(texts, SAME))
    if len(words):
        index, vocabulary = distinct(words)
        coded, place, sizes = vocabulary_ids(tokenizer, vocabulary, known)
        place, n = place[index], sizes[index]
    else:
        place = n = np.zeros(0, np.int64)
        coded = np.zeros(0, np.uint32)
    total = np.concatenate([[0], np.cumsum(n)])
    doc_sizes = total[bounds[1:]] - total[bounds[:-1]] + 1
    ids = np.full(int(total[-1]) + len(texts), end_id, dtype=np.uint32)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(doc_sizes) - 1] = False
    ids[inside] = coded[ragged(place, n)]
    return ids, doc_sizes


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID,
                 block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the token file of ``docs(doc_id, text)`` to ``path``, in ascending doc_id order.

    Null texts are empty (their only id is the end id). Null ids come first.
    Rows with equal ids are ordered by a hash of their text, then by their place
    in the input. An empty table writes a file without blocks.
    """
    ordered = (document_columns(docs)
               .withColumn("_tie", F.xxhash64("text")).withColumn("_place", F.monotonically_increasing_id())
               .repartitionByRange("doc_id", "_tie", "_place").sortWithinPartitions("doc_id", "_tie", "_place")
               .select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tokenizer, known = _loaded(tokenizer_path, os.stat(tokenizer_path).st_mtime_ns)
        size = tokenizer.get_vocab_size()
        block, held, waiting = 0, [], 0

        def flush() -> pa.RecordBatch:
            ids, sizes, names = (np.concatenate(x) for x in zip(*[(i, s, n) for i, s, n in held]))
            row = {"part": [part], "block": [block], "n_tokens": [len(ids)],
                   "doc_ids": [[None if n is None else int(n) for n in names]], "doc_tokens": [sizes.tolist()],
                   "payload": [rangecoder.encode(ids, size)]}
            return pa.RecordBatch.from_pydict(row, schema=file_schema)

        file_schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("n_tokens", pa.int64()),
                                 ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
                                 ("payload", pa.binary())])
        for batch in sub_batches(batches, "text", BATCH_BYTES):
            ids, sizes = token_ids(tokenizer, batch.column("text"), end_id, known)
            names = np.array(batch.column("doc_id").to_pylist(), dtype=object)
            ends, done, first = np.cumsum(sizes), 0, 0
            while done < len(sizes):  # cut where a block has reached its size; documents stay whole
                start = int(ends[done - 1]) if done else 0
                upto = int(np.searchsorted(ends, start + block_tokens - waiting)) + 1
                upto = min(upto, len(sizes))
                held.append((ids[start:int(ends[upto - 1])], sizes[done:upto], names[done:upto]))
                waiting += int(ends[upto - 1]) - start
                done = upto
                if waiting >= block_tokens:
                    yield flush()
                    block, held, waiting = block + 1, [], 0
        if held:
            yield flush()

    ordered.mapInArrow(lean(run), FILE_SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written file alone.

    start: ids of all documents before it; ids_crc32: unsigned CRC-32 of the
    document's decoded ids as little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    # places: prefix sums of the parts (one row per file), then inside each part
    parts = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = blocks.select("part", "block", (F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block"))
                                             - F.col("n_tokens")).alias("block_start"))
    starts = inside.join(before, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("at"))
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = rangecoder.decode(row["payload"])
                n = np.array(row["doc_tokens"], dtype=np.int64)
                ends = np.cumsum(n)
                if len(ids) != row["n_tokens"] or int(ends[-1]) != len(ids):
                    raise rangecoder.CorruptBlock("document sizes differ from the block's ids")
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * (e - k):4 * e]) for e, k in zip(ends.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * len(n), pa.int32()), pa.array([row["block"]] * len(n), pa.int32()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(ends - n), pa.array(n), pa.array(crcs, pa.int64())],
                    schema=schema)

    decoded = blocks.select("part", "block", "n_tokens", "doc_ids", "doc_tokens", "payload").mapInArrow(
        lean(run), "part int, block int, doc_id long, place long, n_tokens long, ids_crc32 long")
    return decoded.join(starts, ["part", "block"]).select(
        "doc_id", (F.col("at") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids array) of every document in the file: the texts' tokens themselves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = rangecoder.decode(row["payload"])
                ends = np.cumsum(row["doc_tokens"]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])

    return spark.read.schema(FILE_SCHEMA).parquet(path).select("doc_ids", "doc_tokens", "payload").mapInArrow(
        lean(run), "doc_id long, ids array<bigint>")
