"""Linear-chain conditional random fields in numpy, over many sequences at once.

Sequences lie one after the other; ``lengths`` has their sizes (0 allowed). All steps run over the positions of the
longest sequence, each on all sequences that are still running, so a batch costs a few array operations a position.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _steps(lengths: np.ndarray) -> list[np.ndarray]:
    """For each position the flat indices of the sequences that have it."""
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, sizes = starts[order], lengths[order]
    running = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), "right")
    return [starts[:k] + t for t, k in enumerate(running)]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def marginals(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward: label marginals of all positions, expected transition counts, log partition."""
    steps = _steps(np.asarray(lengths, np.int64))
    ahead, back = emit.astype(float).copy(), np.zeros(emit.shape)
    for at in steps[1:]:
        ahead[at] = emit[at] + _lse(ahead[at - 1][:, :, None] + trans, 1)
    for at in reversed(steps[1:]):
        back[at - 1] = _lse(trans + (emit[at] + back[at])[:, None, :], 2)
    both = ahead + back
    logz = _lse(both, 1) if len(both) else np.empty(0)
    pairs = np.zeros(trans.shape)
    if len(steps) > 1:
        at = np.concatenate(steps[1:])
        pairs = np.exp(ahead[at - 1][:, :, None] + trans + (emit[at] + back[at])[:, None, :] - logz[at][:, None, None]).sum(axis=0)
    return np.exp(both - logz[:, None]) if len(both) else both, pairs, float(logz[steps[0]].sum()) if steps else 0.0


def viterbi(emit: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best labels of all positions."""
    steps = _steps(np.asarray(lengths, np.int64))
    best, came = emit.astype(float).copy(), np.zeros(emit.shape, np.int64)
    for at in steps[1:]:
        scores = best[at - 1][:, :, None] + trans
        came[at] = scores.argmax(axis=1)
        best[at] = emit[at] + scores.max(axis=1)
    labels = best.argmax(axis=1) if len(best) else np.empty(0, np.int64)
    for at in reversed(steps[1:]):
        labels[at - 1] = came[at, labels[at]]
    return labels


def train(gradient, shape: tuple[int, ...], rounds: int = 200, rate: float = 0.1) -> np.ndarray:
    """Adam on a flat parameter vector; ``gradient`` gives the gradient of the loss."""
    theta, m, v = np.zeros(shape), np.zeros(shape), np.zeros(shape)
    for k in range(1, rounds + 1):
        g = gradient(theta)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta


def runs(labels: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Maximal runs of one label within a sequence: label, first, last + 1 as flat indices."""
    if not len(labels):
        return
    first = np.zeros(len(labels), bool)
    starts = np.cumsum(lengths) - lengths
    first[starts[np.asarray(lengths) > 0]] = True
    cuts = np.flatnonzero(first | np.concatenate([[True], labels[1:] != labels[:-1]]))
    for a, b in zip(cuts, [*cuts[1:], len(labels)], strict=True):
        yield int(labels[a]), int(a), int(b)
