"""One step of a gated recurrent unit in numpy, forwards and backwards.

Gates are softsigns scaled to (0, 1) and the candidate is a softsign; the reset
gate scales the candidate's recurrent part. Rows are independent sequences.

``steps`` and ``steps_back`` run a window of steps with sequences as columns, so
that every part of the state is one block of memory.
"""

from __future__ import annotations

import numpy as np


def _gate(x: np.ndarray) -> np.ndarray:
    """(1 + x / (1 + |x|)) / 2, in place."""
    d = np.abs(x)
    d += 1
    x /= d
    x += 1
    x *= 0.5
    return x


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place."""
    d = np.abs(x)
    d += 1
    x /= d
    return x


def forward(inputs: np.ndarray, state: np.ndarray, u: np.ndarray):
    """(next state, what ``backward`` needs); ``inputs`` holds update, reset and candidate parts side by side."""
    h = state.shape[1]
    r = state @ u
    gates = _gate(inputs[:, :2 * h] + r[:, :2 * h])
    cand = _squash(inputs[:, 2 * h:] + gates[:, h:] * r[:, 2 * h:])
    return cand + gates[:, :h] * (state - cand), (state, gates, cand, r[:, 2 * h:])


def backward(d_state: np.ndarray, kept, u: np.ndarray):
    """(gradient of the previous state, of the inputs, of ``u``)."""
    state, gates, cand, r = kept
    h = state.shape[1]
    z, reset = gates[:, :h], gates[:, h:]
    d_gate = np.empty_like(gates)
    d_cand = d_state * (1 - z) * (1 - np.abs(cand)) ** 2
    d_gate[:, :h] = d_state * (state - cand)
    d_gate[:, h:] = d_cand * r
    d_gate *= 0.5 * (1 - np.abs(2 * gates - 1)) ** 2
    d_rec = np.concatenate([d_gate, d_cand * reset], axis=1)
    return d_state * z + d_rec @ u.T, np.concatenate([d_gate, d_cand], axis=1), state.T @ d_rec


def steps(inputs: np.ndarray, state: np.ndarray, u: np.ndarray, goes_on: np.ndarray | None = None):
    """(states after each step, state after the last, what ``steps_back`` needs where ``goes_on`` is given).

    ``inputs`` (steps, 3 h, sequences) is overwritten; ``state`` (h, sequences);
    ``goes_on`` (steps, sequences) is 0 where the next step begins with an empty state, else 1.
    """
    n, h = len(inputs), len(state)
    u_t, start = np.ascontiguousarray(u.T), state
    after = np.empty((n, *state.shape), inputs.dtype)
    rec = np.empty((n if goes_on is not None else 1, *inputs.shape[1:]), inputs.dtype)
    gate_size, size = np.empty_like(inputs[0, :2 * h]), np.empty_like(inputs[0, 2 * h:])
    for t in range(n):
        r = np.matmul(u_t, state, out=rec[t % len(rec)])
        gates, cand, out = inputs[t, :2 * h], inputs[t, 2 * h:], after[t]
        gates += r[:2 * h]
        np.abs(gates, out=gate_size)
        gate_size += 1
        gates /= gate_size
        gates += 1
        gates *= 0.5
        np.multiply(gates[h:], r[2 * h:], out=size)
        cand += size
        np.abs(cand, out=size)
        size += 1
        cand /= size
        np.subtract(state, cand, out=out)
        out *= gates[:h]
        out += cand
        state = out if goes_on is None else out * goes_on[t]
    return after, state, (start, after, inputs, rec[:, 2 * h:])


def steps_back(d_after: np.ndarray, kept, u: np.ndarray, goes_on: np.ndarray):
    """(gradients of the inputs (steps, 3 h, sequences), of ``u``); nothing comes back from after the window."""
    start, after, gates_cand, r = kept
    n, h, width = after.shape
    before = np.empty_like(after)
    before[0] = start
    np.multiply(after[:-1], goes_on[:-1, None], out=before[1:])
    gates, cand = gates_cand[:, :2 * h], gates_cand[:, 2 * h:]
    z, reset = gates[:, :h], gates[:, h:]
    slope = 2 * gates
    slope -= 1
    np.abs(slope, out=slope)
    np.subtract(1, slope, out=slope)
    slope *= slope
    slope *= 0.5
    by_z = before - cand
    by_z *= slope[:, :h]
    by_reset = slope[:, h:]
    by_reset *= r
    by_cand = np.abs(cand)
    np.subtract(1, by_cand, out=by_cand)
    by_cand *= by_cand
    by_cand *= 1 - z
    d = np.empty((n, 4 * h, width), before.dtype)  # candidate's recurrent part, update, reset, candidate
    u_first = np.concatenate([u[:, 2 * h:], u[:, :2 * h]], axis=1)
    back, part = np.zeros((h, width), before.dtype), np.empty((h, width), before.dtype)
    for t in range(n - 1, -1, -1):
        back *= goes_on[t]
        back += d_after[t]
        d_cand = np.multiply(back, by_cand[t], out=d[t, 3 * h:])
        np.multiply(d_cand, reset[t], out=d[t, :h])
        np.multiply(back, by_z[t], out=d[t, h:2 * h])
        np.multiply(d_cand, by_reset[t], out=d[t, 2 * h:3 * h])
        back *= z[t]
        back += np.matmul(u_first, d[t, :3 * h], out=part)
    d_u = np.matmul(before, d[:, :3 * h].transpose(0, 2, 1)).sum(axis=0)
    return d[:, h:], np.concatenate([d_u[:, h:], d_u[:, :h]], axis=1)
