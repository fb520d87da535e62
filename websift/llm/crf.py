"""A linear-chain conditional random field of two labels over categorical features, trained and decoded page-parallel in numpy."""

from __future__ import annotations

import numpy as np


class Chains:
    """Sequences side by side: step t of all sequences that are that long, longest first."""

    def __init__(self, lengths: np.ndarray) -> None:
        start = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        self.start, self.length = start[order].astype(np.int64), lengths[order]
        self.n = int(lengths.sum())
        longest = int(self.length[0]) if len(order) else 0
        #: How many sequences are longer than t.
        self.active = np.searchsorted(-self.length, -np.arange(longest), "left")

    def at(self, t: int) -> np.ndarray:
        return self.start[: self.active[t]] + t


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


def viterbi(emit: np.ndarray, trans: np.ndarray, chains: Chains) -> np.ndarray:
    """The best labels; emit (n, 2), trans (2, 2) from row to column."""
    out = np.zeros(chains.n, np.int8)
    if not len(chains.active):
        return out
    back = np.zeros((chains.n, 2), np.int8)
    score = emit[chains.at(0)]
    final = np.zeros((len(chains.start), 2))
    final[: len(score)] = score
    for t in range(1, len(chains.active)):
        idx = chains.at(t)
        step = score[: len(idx), :, None] + trans
        back[idx] = step.argmax(axis=1)
        score = step.max(axis=1) + emit[idx]
        final[: len(idx)] = score
    label = final.argmax(axis=1).astype(np.int8)
    last = chains.start + chains.length - 1
    out[last] = label
    for t in range(len(chains.active) - 1, 0, -1):
        idx = chains.at(t)
        out[idx - 1] = back[idx, out[idx]]
    return out


def train(codes: np.ndarray, labels: np.ndarray, lengths: np.ndarray, size: int, steps: int = 120, rate: float = 0.2, decay: float = 3e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights of label 1 against 0 by feature code, transitions): maximum conditional likelihood by Adam with an L2 term.

    codes: (n, k) feature codes below size. The gradient is expected against seen counts from forward and backward passes.
    """
    chains = Chains(lengths)
    w, trans = np.zeros(size), np.zeros((2, 2))
    state = [np.zeros(size), np.zeros(size), np.zeros((2, 2)), np.zeros((2, 2))]
    n = max(chains.n, 1)
    inner = np.ones(chains.n, bool)
    inner[chains.start] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[at - 1], labels[at]), 1)
    flat = codes.ravel()
    for k in range(1, steps + 1):
        emit = np.zeros((chains.n, 2))
        emit[:, 1] = w[codes].sum(axis=1)
        alpha, beta = np.zeros((chains.n, 2)), np.zeros((chains.n, 2))
        if len(chains.active):
            alpha[chains.at(0)] = emit[chains.at(0)]
            for t in range(1, len(chains.active)):
                idx = chains.at(t)
                alpha[idx] = _lse(alpha[idx - 1][:, :, None] + trans, 1) + emit[idx]
            for t in range(len(chains.active) - 1, 0, -1):
                idx = chains.at(t)
                beta[idx - 1] = _lse(trans + (emit[idx] + beta[idx])[:, None, :], 2)
        total = _lse(alpha + beta, 1)
        p1 = np.exp(alpha[:, 1] + beta[:, 1] - total)
        pair = np.exp(alpha[at - 1][:, :, None] + trans + (emit[at] + beta[at])[:, None, :] - total[at][:, None, None])
        err = labels - p1
        g = np.bincount(flat, np.repeat(err, codes.shape[1]), size) / n - decay * w
        gt = (seen - pair.sum(axis=0)) / n - decay * trans
        for x, grad, i in ((w, g, 0), (trans, gt, 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.999 * state[i + 1] + 0.001 * grad**2
            x += rate * (state[i] / (1 - 0.9**k)) / (np.sqrt(state[i + 1] / (1 - 0.999**k)) + 1e-9)
    return w, trans
