"""A bidirectional gated recurrent network with attention pooling, in numpy, at two levels.

Characters of a word run through a GRU in both directions and attention pools their states into a vector
of the word; that vector and an embedding of the whole word are the input of a second GRU over the words
of a window, whose states attention pools again into one logit. Every array is float32.

``unit`` arrays of a level: ``W`` (input to 3 gates), ``U`` (state to 3 gates) and ``b`` for each direction,
and the attention's ``A``, ``a`` and ``v``. Sequences are padded on the right and masked.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def init_level(rng: np.random.Generator, name: str, n_in: int, n_state: int) -> Params:
    def draw(*shape: int) -> np.ndarray:
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    out: Params = {}
    for side in "fb":
        out[f"{name}W{side}"] = draw(n_in, 3 * n_state)
        out[f"{name}U{side}"] = draw(n_state, 3 * n_state)
        out[f"{name}b{side}"] = np.zeros(3 * n_state, np.float32)
    out[f"{name}A"] = draw(2 * n_state, n_state)
    out[f"{name}a"] = np.zeros(n_state, np.float32)
    out[f"{name}v"] = draw(n_state)
    return out


def _scan(gates: np.ndarray, mask: np.ndarray, U: np.ndarray, reverse: bool, keep: bool) -> tuple[np.ndarray, list]:
    """States of one direction. ``gates`` is (time, row, 3 * state): the inputs' share of the gates."""
    steps, rows, three = gates.shape
    n = three // 3
    h = np.zeros((rows, n), np.float32)
    out = np.empty((steps, rows, n), np.float32)
    kept = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        share = h @ U
        zr = _sigmoid(gates[t, :, : 2 * n] + share[:, : 2 * n])
        z, r = zr[:, :n], zr[:, n:]
        c = np.tanh(gates[t, :, 2 * n :] + r * share[:, 2 * n :])
        m = mask[t][:, None]
        new = h + m * (1 - z) * (c - h)
        if keep:
            kept.append((t, h, z, r, c, share[:, 2 * n :]))
        h = new
        out[t] = h
    return out, kept


def _scan_back(d_out: np.ndarray, mask: np.ndarray, U: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of ``U``."""
    steps, rows, n = d_out.shape
    d_gates, d_U = np.empty((steps, rows, 3 * n), np.float32), np.zeros_like(U)
    carry = np.zeros((rows, n), np.float32)
    for t, h, z, r, c, share in reversed(kept):
        d_h = d_out[t] + carry
        m = mask[t][:, None]
        d_c = d_h * m * (1 - z) * (1 - c * c)
        d_z = -d_h * m * (c - h) * z * (1 - z)
        d_r = d_c * share * r * (1 - r)
        d_share = np.concatenate([d_z, d_r, d_c * r], 1)
        d_gates[t] = np.concatenate([d_z, d_r, d_c], 1)
        d_U += h.T @ d_share
        carry = d_h * (1 - m * (1 - z)) + d_share @ U.T
    return d_gates, d_U


def _attend(p: Params, name: str, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    hidden = np.tanh(states @ p[f"{name}A"] + p[f"{name}a"])
    score = np.where(mask > 0, hidden @ p[f"{name}v"], np.float32(-1e9))
    share = np.exp(score - score.max(0)) * (mask > 0)
    share /= np.maximum(share.sum(0), np.float32(1e-9))
    return np.einsum("trn,tr->rn", states, share), (states, hidden, share)


def project(p: Params, name: str, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The inputs' share of the gates in each direction; may be computed once per distinct input."""
    return tuple(inputs @ p[f"{name}W{s}"] + p[f"{name}b{s}"] for s in "fb")


def pool(p: Params, name: str, gates: tuple[np.ndarray, np.ndarray], mask: np.ndarray, train: bool = False):
    """The attention-pooled states of sequences, (row, 2 * state), and what the way back needs."""
    states, kept = zip(*(_scan(g, mask, p[f"{name}U{s}"], s == "b", train) for g, s in zip(gates, "fb")))
    pooled, seen = _attend(p, name, np.concatenate(states, 2), mask)
    return pooled, ((kept, seen, mask) if train else None)


def pool_back(p: Params, name: str, d_pooled: np.ndarray, inputs: np.ndarray, seen: tuple, grads: Params) -> np.ndarray:
    """Adds the level's gradients to ``grads``; returns that of ``inputs`` (time, row, input)."""
    kept, (states, hidden, share), mask = seen
    n = states.shape[2] // 2
    d_states = share[:, :, None] * d_pooled[None]
    d_share = np.einsum("trn,rn->tr", states, d_pooled)
    d_score = share * (d_share - (d_share * share).sum(0))
    grads[f"{name}v"] += np.einsum("trn,tr->n", hidden, d_score)
    d_hidden = d_score[:, :, None] * p[f"{name}v"] * (1 - hidden * hidden)
    flat = d_hidden.reshape(-1, d_hidden.shape[2])
    grads[f"{name}A"] += states.reshape(-1, 2 * n).T @ flat
    grads[f"{name}a"] += flat.sum(0)
    d_states += d_hidden @ p[f"{name}A"].T
    d_inputs = np.zeros_like(inputs)
    for k, side in enumerate("fb"):
        d_gates, d_U = _scan_back(d_states[:, :, k * n : (k + 1) * n], mask, p[f"{name}U{side}"], kept[k])
        flat = d_gates.reshape(-1, 3 * n)
        grads[f"{name}U{side}"] += d_U
        grads[f"{name}b{side}"] += flat.sum(0)
        grads[f"{name}W{side}"] += inputs.reshape(-1, inputs.shape[2]).T @ flat
        d_inputs += d_gates @ p[f"{name}W{side}"].T
    return d_inputs


class Adam:
    """Adam steps with a global bound on the gradient's norm."""

    def __init__(self, params: Params, rate: float, bound: float = 5.0):
        self.params, self.rate, self.bound, self.t = params, rate, bound, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.s = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, self.bound / max(norm, 1e-9)))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += np.float32(0.1) * (g - self.m[k])
            self.s[k] += np.float32(0.001) * (g * g - self.s[k])
            m, s = self.m[k] / (1 - 0.9**self.t), self.s[k] / (1 - 0.999**self.t)
            self.params[k] -= (self.rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
