"""Adaptive context-mixing range coder for token ids, vectorised over lanes (operator 9).

A block of ids is cut into lanes that are coded in lockstep: at each step every
lane codes one id, and all lanes share one adaptive model, which then learns
from the ids of the step. Three predictions are mixed for each id:

* order 2: the id last confirmed after the two preceding ids (hashed context),
* order 1: the id last confirmed after the preceding id,
* order 0: the frequencies of all ids so far.

The mixing weights are learned for each pair of confidences of the two
contexts (and whether they agree) from how often each prediction was right.
The mixed distribution splits the coder's range: a part for the order-2 id, a
part for the order-1 id, the rest shared by order-0 frequency. Arithmetic
coding is a carry-less range coder with 64-bit state that emits 16-bit words,
one stream per lane.

Every block starts from an empty model and carries two checksums (of the coded
bytes and of the ids), so blocks can be decoded alone and in any order.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR1"
HEAD = struct.Struct("<4sIQIIII")  # magic, vocabulary, ids, lanes, steps, crc of ids, crc of all the rest
LANES = 8192
LEAST_STEPS = 64
ORDER2_BITS = 18
SCALE_BITS, ORDER0_BITS = 24, 20
TOP, FLOOR = np.uint64(1 << 48), np.uint64(1 << 36)
U = np.uint64
CONFIDENT = 7


class CorruptBlock(ValueError):
    """A block whose checksum or layout is wrong."""


class _Model:
    """The shared adaptive model; encoder and decoder run it in the same order."""

    def __init__(self, vocabulary: int, lanes: int):
        self.vocabulary = vocabulary
        self.best2 = np.zeros(1 << ORDER2_BITS, np.uint32)
        self.sure2 = np.zeros(1 << ORDER2_BITS, np.uint8)
        self.best1 = np.zeros(vocabulary + 1, np.uint32)
        self.sure1 = np.zeros(vocabulary + 1, np.uint8)
        states = (CONFIDENT + 1) ** 2 * 2
        self.right = np.ones((states, 3), np.int64)  # order-2 right, order-1 right, neither
        self.counts = np.zeros(vocabulary, np.int64)
        self.unseen: list[np.ndarray] = []  # ids since the frequencies were last spread
        self.step = 0
        self.prev1 = np.full(lanes, vocabulary, np.int64)  # a lane starts after a mark outside the vocabulary
        self.prev2 = np.full(lanes, vocabulary, np.int64)
        self._spread()

    def _spread(self) -> None:
        """Order-0 frequencies of at least 1 that sum to 2**ORDER0_BITS, and their inverse."""
        if self.unseen:
            self.counts += np.bincount(np.concatenate(self.unseen), minlength=self.vocabulary)
            self.unseen = []
        room = (1 << ORDER0_BITS) - self.vocabulary
        share = 1 + self.counts * room // max(1, int(self.counts.sum()))
        share[int(self.counts.argmax())] += (1 << ORDER0_BITS) - int(share.sum())
        self.cum = np.concatenate([[0], np.cumsum(share)]).astype(np.uint64)
        small = np.uint16 if self.vocabulary <= 1 << 16 else np.uint32
        self.inverse = np.repeat(np.arange(self.vocabulary, dtype=small), share)

    def predict(self, n: int):
        """Candidates and parts of the range for the first ``n`` lanes."""
        p1, p2 = self.prev1[:n], self.prev2[:n]
        self.at2 = ((p1 * 0x9E3779B1 + p2 * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - ORDER2_BITS)
        self.at1 = p1
        c2, c1 = self.best2[self.at2], self.best1[p1]
        s2, s1 = self.sure2[self.at2], self.sure1[p1]
        self.state = (s2.astype(np.int64) * (CONFIDENT + 1) + s1) * 2 + (c2 == c1)
        f2, f1 = self._parts()
        return c2, c1, f2[self.state], f1[self.state]

    def _parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Width of the order-2 and order-1 part in each state, of 2**SCALE_BITS; order 0 keeps 1/16 at least."""
        scale = (1 << SCALE_BITS) * 15 // 16
        total = self.right.sum(axis=1)
        f2 = self.right[:, 0] * scale // total
        f1 = self.right[:, 1] * scale // total
        state = np.arange(len(total))
        agree, s1, s2 = state & 1, state >> 1 & 7, state >> 4
        f1[(s1 == 0) | ((agree == 1) & (s2 > 0))] = 0
        f2[s2 == 0] = 0
        return f2.astype(np.uint64), f1.astype(np.uint64)

    def learn(self, ids: np.ndarray, by2: np.ndarray, by1: np.ndarray) -> None:
        """Update with the ids of the step; by2, by1: the coded id was the order-2, order-1 candidate."""
        n = len(ids)
        outcome = np.where(by2, 0, np.where(by1, 1, 2))
        self.right += np.bincount(self.state * 3 + outcome, minlength=self.right.size).reshape(-1, 3)
        for at, best, sure in ((self.at2, self.best2, self.sure2), (self.at1, self.best1, self.sure1)):
            old, level = best[at], sure[at]
            same = (old == ids) & (level > 0)
            fresh = ~same & (level < 2)
            best[at] = np.where(fresh, ids, old)
            sure[at] = np.where(same, np.minimum(level + 1, CONFIDENT), np.where(fresh, 1, level >> 1))
        self.unseen.append(ids)
        self.prev2[:n], self.prev1[:n] = self.prev1[:n].copy(), ids
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 64 == 0:
            self._spread()


def _renormalise(lo: np.ndarray, wd: np.ndarray):
    """Shift settled top words out of ``lo`` in place, widening ``wd``; yields (lanes, words) until none is left.

    A lane whose width fell below ``FLOOR`` across a word boundary is narrowed
    to its side of the boundary first, so that the word settles (no carries).
    """
    lanes = np.flatnonzero(((lo ^ (lo + wd)) < TOP) | (wd < FLOOR))
    while len(lanes):
        a, b = lo[lanes], wd[lanes]
        b = np.where((a ^ (a + b)) < TOP, b, (U(0) - a) & (FLOOR - U(1)))
        word = (a >> U(48)).astype("<u2")
        a <<= U(16)
        b <<= U(16)
        lo[lanes], wd[lanes] = a, b
        yield lanes, word
        lanes = lanes[((a ^ (a + b)) < TOP) | (b < FLOOR)]


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) of a block: lanes hold ``steps`` consecutive ids, the last one maybe fewer."""
    steps = max(LEAST_STEPS, -(-n // LANES))
    return max(1, -(-n // steps)), steps


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One self-contained block."""
    ids = np.ascontiguousarray(ids, dtype="<u4")
    if not 0 < vocabulary <= 1 << 19 or (len(ids) and int(ids.max()) >= vocabulary):
        raise ValueError("ids must lie in a vocabulary of at most 2**19")
    lanes, steps = _shape(len(ids))
    model = _Model(vocabulary, lanes)
    low, width = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    lane_log, word_log = [], []
    numbers = np.arange(lanes, dtype=np.uint16)
    padded = np.zeros(lanes * steps, np.uint32)
    padded[:len(ids)] = ids
    by_step = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    last = len(ids) - (lanes - 1) * steps  # ids of the last lane
    for t in range(min(steps, len(ids))):
        n = lanes if t < last else lanes - 1
        x = by_step[t, :n]
        c2, c1, f2, f1 = model.predict(n)
        by2 = (x == c2) & (f2 > 0)
        by1 = (x == c1) & (f1 > 0) & ~by2
        rest = (1 << SCALE_BITS) - f2 - f1
        from0 = f2 + f1 + (model.cum[x] * rest >> U(ORDER0_BITS))
        upto0 = f2 + f1 + (model.cum[x + 1] * rest >> U(ORDER0_BITS))
        begin = np.where(by2, U(0), np.where(by1, f2, from0))
        part = np.where(by2, f2, np.where(by1, f1, upto0 - from0))
        unit = width[:n] >> U(SCALE_BITS)
        lo = low[:n] + unit * begin
        wd = unit * part
        for lanes_now, settled in _renormalise(lo, wd):  # most lanes emit no word or one
            lane_log.append(numbers[lanes_now])
            word_log.append(settled)
        low[:n], width[:n] = lo, wd
        model.learn(x, by2, by1)
    # two words end a lane: a width is at least FLOOR, so whatever the decoder reads after them stays inside it
    low += U((1 << 32) - 1)
    for shift in (48, 32):
        lane_log.append(numbers)
        word_log.append((low >> U(shift)).astype("<u2"))
    who, words = np.concatenate(lane_log), np.concatenate(word_log)
    sizes = np.bincount(who, minlength=lanes).astype("<u4")
    body = sizes.tobytes() + words[np.argsort(who, kind="stable")].tobytes()
    head = HEAD.pack(MAGIC, vocabulary, len(ids), lanes, steps, zlib.crc32(ids.tobytes()), 0)[:-4]
    return head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of one block (uint32); CorruptBlock if a checksum differs."""
    if len(block) < HEAD.size:
        raise CorruptBlock("short block")
    magic, vocabulary, count, lanes, steps, crc_ids, crc_body = HEAD.unpack_from(block)
    body = memoryview(block)[HEAD.size:]
    if magic != MAGIC or zlib.crc32(body, zlib.crc32(block[:HEAD.size - 4])) != crc_body or (lanes, steps) != _shape(count):
        raise CorruptBlock("wrong checksum or layout")
    sizes = np.frombuffer(body, "<u4", lanes).astype(np.int64)
    words = np.frombuffer(body, "<u2", int(sizes.sum()), 4 * lanes).astype(np.uint64)
    words = np.append(words, np.zeros(4, U))
    cursor = np.cumsum(sizes) - sizes
    code = np.zeros(lanes, U)
    for _ in range(4):
        code = (code << U(16)) | words[cursor]
        cursor += 1
    model = _Model(vocabulary, lanes)
    low, width = np.zeros(lanes, U), np.full(lanes, 0xFFFFFFFFFFFFFFFF, U)
    by_step = np.zeros((steps, lanes), np.uint32)
    last = count - (lanes - 1) * steps
    for t in range(min(steps, count)):
        n = lanes if t < last else lanes - 1
        c2, c1, f2, f1 = model.predict(n)
        rest = (1 << SCALE_BITS) - f2 - f1
        unit = width[:n] >> U(SCALE_BITS)
        value = np.minimum((code[:n] - low[:n]) // unit, U((1 << SCALE_BITS) - 1))
        by2 = value < f2
        by1 = ~by2 & (value < f2 + f1)
        inside = np.where(by2 | by1, U(0), value - f2 - f1)
        x = model.inverse[(((inside + U(1)) << U(ORDER0_BITS)) - U(1)) // rest]
        from0 = f2 + f1 + (model.cum[x] * rest >> U(ORDER0_BITS))
        upto0 = f2 + f1 + (model.cum[x + 1] * rest >> U(ORDER0_BITS))
        begin = np.where(by2, U(0), np.where(by1, f2, from0))
        part = np.where(by2, f2, np.where(by1, f1, upto0 - from0))
        x = np.where(by2, c2, np.where(by1, c1, x))
        lo = low[:n] + unit * begin
        wd = unit * part
        for lanes_now, _ in _renormalise(lo, wd):
            code[lanes_now] = (code[lanes_now] << U(16)) | words[cursor[lanes_now]]
            cursor[lanes_now] += 1
        low[:n], width[:n] = lo, wd
        by_step[t, :n] = x
        model.learn(x, by2, by1)
    ids = np.ascontiguousarray(by_step.T).reshape(-1)[:count].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc_ids:
        raise CorruptBlock("decoded ids differ from the coded ones")
    return ids
