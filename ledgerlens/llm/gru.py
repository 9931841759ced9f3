"""A gated recurrent layer in numpy: forward, backpropagation through time, and Adam."""
from __future__ import annotations

import numpy as np

DTYPE = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def weights(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return (rng.standard_normal((rows, columns)) / np.sqrt(rows)).astype(DTYPE)


def step(gates: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One step. gates: the input's share of (update, reset, candidate); u: recurrent weights."""
    n = h.shape[1]
    own = h @ u
    zr = sigmoid(gates[:, :2 * n] + own[:, :2 * n])
    cand = np.tanh(gates[:, 2 * n:] + zr[:, n:] * own[:, 2 * n:])
    return cand + zr[:, :n] * (h - cand)


def forward(gates: np.ndarray, h: np.ndarray, u: np.ndarray):
    """All steps of gates [time, batch, 3n]."""
    n = h.shape[1]
    states = np.empty((len(gates), *h.shape), dtype=DTYPE)
    tape = []
    for t in range(len(gates)):
        own = h @ u
        zr = sigmoid(gates[t][:, :2 * n] + own[:, :2 * n])
        z, r = zr[:, :n], zr[:, n:]
        cand = np.tanh(gates[t][:, 2 * n:] + r * own[:, 2 * n:])
        tape.append((h, z, r, cand, own[:, 2 * n:]))
        h = cand + z * (h - cand)
        states[t] = h
    return states, tape


def backward(d_states: np.ndarray, tape: list, u: np.ndarray):
    """Gradients of gates and recurrent weights; the gradient stops at the window's start (truncation)."""
    n = d_states.shape[2]
    d_gates = np.empty((len(tape), d_states.shape[1], 3 * n), dtype=DTYPE)
    d_u = np.zeros_like(u)
    carry = np.zeros(d_states.shape[1:], dtype=DTYPE)
    for t in range(len(tape) - 1, -1, -1):
        h, z, r, cand, own = tape[t]
        dh = d_states[t] + carry
        d_cand = dh * (1 - z) * (1 - cand * cand)
        d_z = dh * (h - cand) * z * (1 - z)
        d_own = d_cand * r
        d_r = d_cand * own * r * (1 - r)
        d_gates[t] = np.concatenate([d_z, d_r, d_cand], axis=1)
        d_rec = np.concatenate([d_z, d_r, d_own], axis=1)
        d_u += h.T @ d_rec
        carry = dh * z + d_rec @ u.T
    return d_gates, d_u


ONE, TWO = np.ones((), DTYPE), np.full((), 2, DTYPE)


def signs(hidden: int) -> np.ndarray:
    """What ``forward_wide`` wants gates and recurrent weights multiplied with: its exponentials are of -x and, for tanh, of -2x."""
    return np.repeat(np.array([-1, -1, -2], DTYPE), hidden)


def forward_wide(gates: np.ndarray, h: np.ndarray, u: np.ndarray, keep: np.ndarray):
    """All steps with one lane a column: gates [time, 3n, lanes], h [n, lanes], keep [time, lanes] (0 clears the state first).

    Whole rows of lanes lie together, so each operation is one run over memory, and one exponential a gate is faster than numpy's tanh.
    ``gates`` are multiplied by ``signs`` before; they are overwritten by the values of update, reset and candidate.
    Gives the states and the signed recurrent shares.
    """
    steps, n, lanes = len(gates), len(h), h.shape[1]
    u = np.ascontiguousarray((u * signs(n)).T)
    own, states = np.empty((steps, 3 * n, lanes), DTYPE), np.empty((steps, n, lanes), DTYPE)
    kept = keep.all(axis=1).tolist()
    with np.errstate(over="ignore"):  # an infinite exponential stands for a gate of 0
        for t, (share, share_zr, share_c, zr, z, r, cand, new) in enumerate(zip(
                own, own[:, :2 * n], own[:, 2 * n:], gates[:, :2 * n], gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:], states)):
            if not kept[t]:
                h = h * keep[t]
            np.matmul(u, h, out=share)
            np.add(zr, share_zr, out=zr)
            np.exp(zr, out=zr)
            np.add(zr, ONE, out=zr)
            np.reciprocal(zr, out=zr)
            np.multiply(r, share_c, out=new)
            np.add(cand, new, out=cand)
            np.exp(cand, out=cand)
            np.add(cand, ONE, out=cand)
            np.divide(TWO, cand, out=cand)
            np.subtract(cand, ONE, out=cand)
            np.subtract(h, cand, out=new)
            np.multiply(new, z, out=new)
            np.add(new, cand, out=new)
            h = new
    return states, own


def backward_wide(d_states: np.ndarray, gates: np.ndarray, before: np.ndarray, own: np.ndarray, u: np.ndarray, keep: np.ndarray, cut: int):
    """Gradients of (unsigned) gates [time, 3n, lanes] and recurrent weights; they stop at every ``cut``-th step.

    ``before`` holds the states that each step starts from; the rest is what ``forward_wide`` gave. What the gradient of a state
    is multiplied with does not depend on later steps, so it is formed for all steps at once. ``d_states`` is overwritten.
    """
    steps, n, lanes = d_states.shape
    z, r, cand = gates[:, :n], gates[:, n:2 * n], gates[:, 2 * n:]
    factor = np.empty((steps, 3, n, lanes), DTYPE)
    to_z, to_r, to_own = factor[:, 0], factor[:, 1], factor[:, 2]
    left = 1 - z
    to_cand = cand * cand
    np.subtract(1, to_cand, out=to_cand)
    to_cand *= left
    np.subtract(before, cand, out=to_z)
    to_z *= z
    to_z *= left
    np.multiply(to_cand, r, out=to_own)
    np.subtract(1, r, out=to_r)
    to_r *= to_own
    to_r *= own[:, 2 * n:]
    to_r *= DTYPE(-0.5)  # the sign of the recurrent share
    kept = keep.all(axis=1).tolist()
    d_rec, carry, direct = np.empty_like(factor), np.zeros((n, lanes), DTYPE), np.empty((n, lanes), DTYPE)
    flat = d_rec.reshape(steps, 3 * n, lanes)
    for t in range(steps - 1, -1, -1):
        d = d_states[t]
        np.add(d, carry, out=d)
        np.multiply(factor[t], d, out=d_rec[t])
        if t % cut == 0:
            carry[:] = 0
            continue
        np.matmul(u, flat[t], out=carry)
        np.multiply(d, z[t], out=direct)
        np.add(carry, direct, out=carry)
        if not kept[t]:
            carry *= keep[t]
    d_u = np.matmul(before, flat.transpose(0, 2, 1)).sum(axis=0)
    np.multiply(d_states, to_cand, out=d_rec[:, 2])
    return flat, d_u


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray], rate: float | None = None, clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        rate = (rate or self.rate) * np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, g in grads.items():
            g = g * DTYPE(scale)
            m, v, held = self.m[k], self.v[k], np.empty_like(g)
            np.subtract(g, m, out=held)
            held *= DTYPE(0.1)
            m += held
            np.multiply(g, g, out=held)
            held -= v
            held *= DTYPE(0.001)
            v += held
            np.sqrt(v, out=held)
            held += DTYPE(1e-8)
            np.multiply(m, DTYPE(rate), out=g)
            g /= held
            self.params[k] -= g
