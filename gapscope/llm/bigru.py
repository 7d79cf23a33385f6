"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward and Adam.

Inputs are windows of word vectors (batch x steps x features) with a mask; the output is one logit per window. A step
projects all inputs of a direction at once; only the small recurrent product is sequential.
"""
from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def new_parameters(features: int, hidden: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    p = {}
    for way in ("f", "b"):
        p["W" + way] = rng.normal(0, 0.4 / np.sqrt(features), (features, 3 * hidden))
        p["U" + way] = rng.normal(0, 0.4 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["c" + way] = np.zeros(3 * hidden)
    p["a"] = rng.normal(0, 0.3, 2 * hidden)
    p["w"] = rng.normal(0, 0.3, 2 * hidden)
    p["o"] = np.zeros(1)
    return {k: v.astype(np.float32) for k, v in p.items()}


def run_way(projected: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: bool = False):
    """Hidden states of one direction over time-major projected inputs (steps x batch x 3 hidden), in the given order."""
    steps, batch, three = projected.shape
    n = three // 3
    h = np.zeros((batch, n), np.float32)
    states = np.empty((steps, batch, n), np.float32)
    tape = []
    for t in range(steps):
        g = h @ u
        gates = sigmoid(projected[t, :, :2 * n] + g[:, :2 * n])
        z, r = gates[:, :n], gates[:, n:]
        new = np.tanh(projected[t, :, 2 * n:] + r * g[:, 2 * n:])
        m = mask[t][:, None]
        step = m * (1.0 - z)
        after = h + step * (new - h)
        if keep:
            tape.append((h, z, r, new, g[:, 2 * n:], m))
        h = after
        states[t] = h
    return states, tape


def pool(p: dict, forward: np.ndarray, backward: np.ndarray, mask: np.ndarray):
    """Attention over the joined states (steps x batch x 2 hidden): weights, pooled vector and logit of each window."""
    n = forward.shape[2]
    scores = forward @ p["a"][:n] + backward @ p["a"][n:]
    scores = np.where(mask > 0, scores, -1e9)
    weights = np.exp(scores - scores.max(axis=0))
    weights *= mask
    weights /= np.maximum(weights.sum(axis=0), 1e-9)
    pooled = np.concatenate([np.einsum("tb,tbn->bn", weights, forward), np.einsum("tb,tbn->bn", weights, backward)], axis=1)
    return weights, pooled, pooled @ p["w"] + p["o"][0]


def advance(table: np.ndarray, at: np.ndarray, mask: np.ndarray, u: np.ndarray) -> np.ndarray:
    """States of one direction as in ``run_way``, reading step t's projected inputs as rows ``at[t]`` of ``table``."""
    steps, batch = at.shape
    n = u.shape[0]
    states = np.empty((steps, batch, n), np.float32)
    h = np.zeros((batch, n), np.float32)
    x, g, new = np.empty((batch, 3 * n), np.float32), np.empty((batch, 3 * n), np.float32), np.empty((batch, n), np.float32)
    gates, last = x[:, :2 * n], x[:, 2 * n:]
    for t in range(steps):
        np.take(table, at[t], axis=0, out=x)
        np.matmul(h, u, out=g)
        gates += g[:, :2 * n]
        np.negative(gates, out=gates)
        np.exp(gates, out=gates)
        gates += 1.0
        np.reciprocal(gates, out=gates)
        np.multiply(gates[:, n:], g[:, 2 * n:], out=new)
        new += last
        np.tanh(new, out=new)
        new -= h
        step = gates[:, :n]
        np.subtract(1.0, step, out=step)
        new *= step
        if not mask[t].all():
            new *= mask[t][:, None]
        h = np.add(h, new, out=states[t])
    return states


def logits(p: dict, table: tuple[np.ndarray, np.ndarray], at: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Logits of windows whose words are rows ``at`` (steps x batch) of the two projected tables (one per direction)."""
    with np.errstate(over="ignore"):
        forward = advance(table[0], at, mask, p["Uf"])
        backward = advance(table[1], at[::-1], mask[::-1], p["Ub"])
    return pool(p, forward, backward[::-1], mask)[2]


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted logistic loss and its gradients; ``x`` is steps x batch x features."""
    n = p["Uf"].shape[0]
    ways = {}
    for way, order in (("f", slice(None)), ("b", slice(None, None, -1))):
        states, tape = run_way(x[order] @ p["W" + way] + p["c" + way], mask[order], p["U" + way], keep=True)
        ways[way] = (states[order], tape, order)
    forward, backward = ways["f"][0], ways["b"][0]
    att, pooled, out = pool(p, forward, backward, mask)
    prob = sigmoid(out)
    loss = float(-(weight * (target * np.log(prob + 1e-9) + (1 - target) * np.log(1 - prob + 1e-9))).sum())
    d_out = weight * (prob - target)
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    grads["w"], grads["o"] = pooled.T @ d_out, np.array([d_out.sum()], np.float32)
    d_pooled = d_out[:, None] * p["w"]
    both = np.concatenate([forward, backward], axis=2)
    d_att = np.einsum("bn,tbn->tb", d_pooled, both)
    d_scores = att * (d_att - (att * d_att).sum(axis=0))
    grads["a"] = np.einsum("tb,tbn->n", d_scores, both)
    d_both = att[:, :, None] * d_pooled + d_scores[:, :, None] * p["a"]
    for way, part in (("f", d_both[:, :, :n]), ("b", d_both[:, :, n:])):
        _, tape, order = ways[way]
        inputs, d_states, u = x[order], part[order], p["U" + way]
        d_h = np.zeros_like(d_states[0])
        d_projected = np.empty((len(tape), d_h.shape[0], 3 * n), np.float32)
        for t in range(len(tape) - 1, -1, -1):
            h, z, r, new, g_new, m = tape[t]
            d_after = d_h + d_states[t]
            step = m * (1.0 - z)
            d_new = d_after * step * (1.0 - new * new)
            d_z = -d_after * m * (new - h) * z * (1.0 - z)
            d_r = d_new * g_new * r * (1.0 - r)
            d_g = np.concatenate([d_z, d_r, d_new * r], axis=1)
            d_projected[t] = np.concatenate([d_z, d_r, d_new], axis=1)
            grads["U" + way] += h.T @ d_g
            d_h = d_after * (1.0 - step) + d_g @ u.T
        grads["W" + way] = np.einsum("tbf,tbn->fn", inputs, d_projected)
        grads["c" + way] = d_projected.sum(axis=(0, 1))
    return loss, grads


class Adam:
    def __init__(self, p: dict, rate: float = 0.01):
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.99 * self.v[k] + 0.01 * g * g
            p[k] -= (self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-8)).astype(np.float32)
