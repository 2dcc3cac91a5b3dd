"""A small bidirectional gated recurrent network over bytes, in numpy.

Each direction embeds a byte, updates a state of ``H`` units with an update and a reset gate
(piecewise linear gates, tanh candidate), and every position gets class probabilities from the
two states there. Arrays are (units, lanes): a lane is one window of text, all lanes advance
together. Training is backpropagation through time with Adam.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

F32 = np.float32


@dataclass
class Params:
    """Weights; ``w`` stacks update, reset, candidate input and candidate state rows, and takes
    [embedding; state; 1]. Index 0 runs forward, 1 backward."""

    emb: np.ndarray  # (E, 256)
    w: list[np.ndarray]  # 2 x (4H, E + H + 1)
    out: np.ndarray  # (K, 2H + 1)

    @classmethod
    def init(cls, classes: int, hidden: int = 8, embed: int = 8, seed: int = 5) -> "Params":
        rng = np.random.default_rng(seed)
        emb = rng.normal(0, 0.5, (embed, 256)).astype(F32)
        w = []
        for _ in range(2):
            m = rng.normal(0, 1 / np.sqrt(embed + hidden), (4 * hidden, embed + hidden + 1)).astype(F32)
            m[2 * hidden:3 * hidden, embed:embed + hidden] = 0  # candidate input sees no state
            m[3 * hidden:, :embed] = 0  # candidate state sees no input
            m[:, -1] = 0
            w.append(m)
        return cls(emb, w, rng.normal(0, 0.3, (classes, 2 * hidden + 1)).astype(F32))

    @property
    def hidden(self) -> int:
        return self.w[0].shape[0] // 4

    def arrays(self) -> list[np.ndarray]:
        return [self.emb, *self.w, self.out]


def _run(p: Params, way: int, x: np.ndarray, mask: np.ndarray | None, keep: bool):
    """States of one direction, (T, H, B); with ``keep`` also what the backward pass needs."""
    steps, lanes = x.shape
    h_n, e_n, w = p.hidden, p.emb.shape[0], p.w[way]
    states = np.empty((steps, h_n, lanes), F32)
    inp = np.ones((e_n + h_n + 1, lanes), F32)
    h = np.zeros((h_n, lanes), F32)
    saved = {}
    order = range(steps) if way == 0 else range(steps - 1, -1, -1)
    for t in order:
        np.take(p.emb, x[t], axis=1, out=inp[:e_n], mode="clip")
        inp[e_n:e_n + h_n] = h
        g = w @ inp
        gate = g[:2 * h_n]
        gate += F32(0.5)
        if keep:
            inside = (gate > 0) & (gate < 1)
        np.clip(gate, 0, 1, out=gate)
        z, r = gate[:h_n], gate[h_n:]
        cand = r * g[3 * h_n:]
        cand += g[2 * h_n:3 * h_n]
        np.tanh(cand, out=cand)
        new = h - cand
        new *= z
        new += cand
        if mask is not None:
            new *= mask[t]
        if keep:
            saved[t] = (inp.copy(), z.copy(), r.copy(), cand, g[3 * h_n:].copy(), inside, h)
        h = new
        states[t] = h
    return (states, saved) if keep else states


def _logits(p: Params, f: np.ndarray, b: np.ndarray) -> np.ndarray:
    h_n = p.hidden
    return p.out[:, :h_n] @ f + p.out[:, h_n:2 * h_n] @ b + p.out[:, -1:]


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def pooled(p: Params, x: np.ndarray, mask: np.ndarray | None = None, known: np.ndarray | None = None) -> np.ndarray:
    """(K, B): class probabilities summed over the positions of each window. ``x``: (T, B)
    bytes; ``mask``: (T, B) ones where a window has text (short windows end early); ``known``:
    of each byte value whether its probabilities count, else they are even."""
    fwd = _run(p, 0, x, mask, False)
    bwd = _run(p, 1, x, mask, False)
    total = np.zeros((p.out.shape[0], x.shape[1]), F32)
    for t in range(x.shape[0]):
        probs = _softmax(_logits(p, fwd[t], bwd[t]))
        if known is not None:
            probs[:, ~known[x[t]]] = F32(1 / len(probs))
        total += probs if mask is None else probs * mask[t]
    return total


def loss_and_grads(p: Params, x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray):
    """Mean weighted cross-entropy over all positions, and its gradients."""
    steps, lanes = x.shape
    h_n, e_n = p.hidden, p.emb.shape[0]
    (fwd, s0), (bwd, s1) = _run(p, 0, x, mask, True), _run(p, 1, x, mask, True)
    grads = [np.zeros_like(a) for a in p.arrays()]
    d_state = [np.empty_like(fwd), np.empty_like(bwd)]
    loss, scale = 0.0, weight / F32(max(1.0, float((mask * weight).sum())))
    for t in range(steps):
        probs = _softmax(_logits(p, fwd[t], bwd[t]))
        own = mask[t] * scale
        loss -= float((np.log(probs[y, np.arange(lanes)] + 1e-9) * own).sum())
        probs[y, np.arange(lanes)] -= 1
        probs *= own
        grads[3][:, :h_n] += probs @ fwd[t].T
        grads[3][:, h_n:2 * h_n] += probs @ bwd[t].T
        grads[3][:, -1] += probs.sum(axis=1)
        d_state[0][t] = p.out[:, :h_n].T @ probs
        d_state[1][t] = p.out[:, h_n:2 * h_n].T @ probs
    onehot = np.arange(256)[:, None]
    for way, saved in ((0, s0), (1, s1)):
        w, dh = p.w[way], np.zeros((h_n, lanes), F32)
        for t in (range(steps - 1, -1, -1) if way == 0 else range(steps)):
            inp, z, r, cand, u_h, inside, h_prev = saved[t]
            dh = (dh + d_state[way][t]) * mask[t]
            d_g = np.empty((4 * h_n, lanes), F32)
            d_c = dh * (1 - z) * (1 - cand * cand)
            d_g[:h_n] = dh * (h_prev - cand) * inside[:h_n]
            d_g[h_n:2 * h_n] = d_c * u_h * inside[h_n:]
            d_g[2 * h_n:3 * h_n] = d_c
            d_g[3 * h_n:] = d_c * r
            grads[1 + way] += d_g @ inp.T
            d_inp = w.T @ d_g
            dh = d_inp[e_n:e_n + h_n] + dh * z
            grads[0] += d_inp[:e_n] @ (x[t] == onehot).T.astype(F32)
        # rows that are zero by construction stay zero
        grads[1 + way][2 * h_n:3 * h_n, e_n:e_n + h_n] = 0
        grads[1 + way][3 * h_n:, :e_n] = 0
        grads[1 + way][3 * h_n:, -1] = 0
    return loss, grads


def train(x: np.ndarray, mask: np.ndarray, y: np.ndarray, classes: int, steps: int = 300, batch: int = 192,
          rate: float = 0.02, seed: int = 5) -> Params:
    """Fit on windows (N, T) with one label each; classes are drawn evenly."""
    rng = np.random.default_rng(seed)
    p = Params.init(classes, seed=seed)
    first = [np.zeros_like(a) for a in p.arrays()]
    second = [np.zeros_like(a) for a in p.arrays()]
    by_class = [np.flatnonzero(y == k) for k in range(classes)]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, max(1, batch // classes)) for c in by_class if len(c)])
        _, grads = loss_and_grads(p, np.ascontiguousarray(x[pick].T), y[pick], np.ones(len(pick), F32), np.ascontiguousarray(mask[pick].T))
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(p.arrays(), grads, first, second):
            g *= F32(min(1.0, 1.0 / (norm + 1e-9)))
            m += F32(0.1) * (g - m)
            v += F32(0.005) * (g * g - v)
            a -= F32(lr) * (m / F32(1 - 0.9**step)) / (np.sqrt(v / F32(1 - 0.995**step)) + F32(1e-6))
    return p
