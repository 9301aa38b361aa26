"""Linear-chain conditional random fields over many ragged sequences at once.

Sequences lie end to end in flat arrays.  Every pass sorts them by length, longest
first, and takes one position of all live sequences per numpy step, so no padding is
computed and a step's cost follows the number of sequences still running.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Lanes:
    """Sequences ordered by length: step t touches ``first[: live[t]] + t``."""

    first: np.ndarray
    length: np.ndarray
    live: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Lanes:
        lengths = np.asarray(lengths, dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        n = lengths[order]
        steps = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(steps), side="left")
        return cls(starts[order], n, live)


def viterbi(emit: np.ndarray, trans: np.ndarray, lanes: Lanes) -> np.ndarray:
    """The best label of each position; on a tie the lower label wins."""
    k = emit.shape[1]
    back = np.zeros(emit.shape, dtype=np.int8)
    labels = np.zeros(len(emit), dtype=np.int8)
    if not len(lanes.live):
        return labels
    best = emit[lanes.first].copy()
    last = np.empty((len(lanes.first), k))
    for t in range(len(lanes.live)):
        m = lanes.live[t]
        at = lanes.first[:m] + t
        if t:
            paths = best[:m, :, None] + trans[None]
            back[at] = paths.argmax(1)
            best = paths.max(1) + emit[at]
        last[:m] = best[:m]
    state = last.argmax(1)
    for t in range(len(lanes.live) - 1, -1, -1):
        m = lanes.live[t]
        at = lanes.first[:m] + t
        running = lanes.length[:m] - 1 > t
        if running.any():
            state[:m] = np.where(running, back[np.where(running, at + 1, at), state[:m]], state[:m])
        labels[at] = state[:m]
    return labels


def marginals(emit: np.ndarray, trans: np.ndarray, lanes: Lanes, pairs: bool = False):
    """Forward-backward: label probabilities of each position, log Z of all sequences
    and, if asked for, the expected number of each transition."""
    k = emit.shape[1]
    grow = np.exp(trans - trans.max())
    lift = np.exp(emit - emit.max(1, keepdims=True))
    alpha = np.zeros_like(lift)
    scale = np.ones(len(emit))
    for t in range(len(lanes.live)):
        m = lanes.live[t]
        at = lanes.first[:m] + t
        a = lift[at] if not t else (alpha[at - 1] @ grow) * lift[at]
        scale[at] = s = a.sum(1)
        alpha[at] = a / s[:, None]
    beta = np.ones_like(lift)
    seen = np.zeros((k, k))
    for t in range(len(lanes.live) - 2, -1, -1):
        m = lanes.live[t + 1]
        at = lanes.first[:m] + t
        ahead = lift[at + 1] * beta[at + 1] / scale[at + 1][:, None]
        beta[at] = ahead @ grow.T
        if pairs:
            seen += grow * (alpha[at].T @ ahead)
    p = alpha * beta
    p /= np.maximum(p.sum(1, keepdims=True), 1e-300)
    steps = int((lanes.length - 1).sum())
    log_z = float(np.log(scale).sum() + emit.max(1).sum() + steps * trans.max()) if len(emit) else 0.0
    return (p, log_z, seen) if pairs else p


@dataclass
class Rests:
    """Ways over 0, 1, 2, ... positions of one and the same emission, each scaled; from
    the last on they are all alike: between two other positions, from the beginning to
    one, and from one to the end."""

    between: np.ndarray
    before: np.ndarray
    after: np.ndarray

    @classmethod
    def of(cls, rest: np.ndarray, trans: np.ndarray, most: int = 64) -> Rests:
        grow, lift = np.exp(trans - trans.max()), np.exp(rest - rest.max())
        between, before, after = [grow], [np.ones(len(lift))], [np.ones(len(lift))]
        for _ in range(most):
            between.append(between[-1] @ (lift[:, None] * grow))
            before.append(before[-1] @ (lift[:, None] * grow))
            after.append(grow @ (lift * after[-1]))
            for x in (between, before, after):
                x[-1] = x[-1] / x[-1].max()
        return cls(*map(np.array, (between, before, after)))


def marginals_between(emit: np.ndarray, gap: np.ndarray, tail: np.ndarray, rests: Rests, lanes: Lanes) -> np.ndarray:
    """Label probabilities of chosen positions of whole sequences.

    ``gap``: the positions left out before each chosen one; ``tail``: those after it, for
    the last ones of their sequences.
    """
    most = len(rests.between) - 1
    grow, gap = rests.between[np.minimum(gap, most)], np.minimum(gap, most)
    lift = np.exp(emit - emit.max(1, keepdims=True))
    alpha, beta = np.zeros_like(lift), rests.after[np.minimum(tail, most)]
    for t in range(len(lanes.live)):
        at = lanes.first[: lanes.live[t]] + t
        a = (np.einsum("ij,ijk->ik", alpha[at - 1], grow[at]) if t else rests.before[gap[at]]) * lift[at]
        alpha[at] = a / a.sum(1, keepdims=True)
    for t in range(len(lanes.live) - 2, -1, -1):
        at = lanes.first[: lanes.live[t + 1]] + t
        b = np.einsum("ijk,ik->ij", grow[at + 1], lift[at + 1] * beta[at + 1])
        beta[at] = b / b.sum(1, keepdims=True)
    p = alpha * beta
    return p / np.maximum(p.sum(1, keepdims=True), 1e-300)


@dataclass
class Crf:
    """``weight[f, y]`` of each active feature f at label y, and ``trans[y, y']``."""

    weight: np.ndarray
    trans: np.ndarray

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """features: one row of feature numbers for each position; -1 stands for none."""
        padded = np.vstack([self.weight, np.zeros((1, self.weight.shape[1]))])
        out = np.zeros((len(features), self.weight.shape[1]))
        for column in features.T:
            out += padded[column]
        return out


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_features: int, n_labels: int = 2, rounds: int = 80, l2: float = 1e-3, rate: float = 0.2) -> Crf:
    """Maximum likelihood by Adam over the whole (bounded) training sample."""
    lanes = Lanes.of(lengths)
    model = Crf(np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels)))
    if not len(features):
        return model
    n = len(features)
    truth = np.eye(n_labels)[labels]
    inside = np.ones(n, dtype=bool)
    inside[np.cumsum(lengths[lengths > 0]) - 1] = False
    counted = np.zeros((n_labels, n_labels))
    np.add.at(counted, (labels[:-1][inside[:-1]], labels[1:][inside[:-1]]), 1.0)
    columns = [(column[column >= 0], column >= 0) for column in features.T]
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (model.weight, model.trans)]
    for step in range(1, rounds + 1):
        p, _, seen = marginals(model.emissions(features), model.trans, lanes, pairs=True)
        miss = truth - p
        up = np.zeros_like(model.weight)
        for ids, used in columns:
            for y in range(n_labels):
                up[:, y] += np.bincount(ids, miss[used, y], n_features)
        for value, grad, (m, v) in ((model.weight, up / n - l2 * model.weight, moments[0]), (model.trans, (counted - seen) / n - l2 * model.trans, moments[1])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            value += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model
