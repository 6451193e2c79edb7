"""Operator 1: document quality by a linear-chain CRF over lines.

Every line of a text gets counts of its characters and words (and those of the lines beside it) as features, and a
label, bad or good. The chain is trained on labelled documents: first every line takes its document's label, then the
lines of bad documents that the first model holds for good are relabelled and the chain is trained again. A document's
quality is the mean of its lines' forward-backward marginals of "good", weighted by line length, put through a logistic
calibration on the same sample.

The model is fitted on a bounded sample of labelled documents: about ``PER_LABEL`` of each label, by a hash of the
identifier, never from the held-out fold. Scoring is one map over Arrow batches of whole texts, without a shuffle;
labels, languages, sources and identifiers are no inputs.

Defined cases: null and empty texts are one empty line and get a score; very long texts are read whole, each as a piece
of its own; columns are carried in a struct and cannot clash; repeated rows are scored each; with only one
label, or none, to learn from, every score is that label's (1 without any); an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import crf
from .arrow_texts import SpanHashes, bytes_of, map_texts, pieces, words_of
from .common import held_out, labelled_texts, table

PER_LABEL = 1500
ROUNDS = 150
DECAY = 1e-3

_CLASSES = {
    "upper": [b for b in range(65, 91)],
    "lower": [b for b in range(97, 123)],
    "digit": [b for b in range(48, 58)],
    "high": [b for b in range(128, 256)],
    "stop": [44, 46, 59, 58, 39, 45],
    "shout": [33, 63],
    "bar": [124],
    "sign": [35, 36, 37, 38, 42, 47, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126, 43, 91, 93, 40, 41, 34],
}
_OF = np.stack([np.isin(np.arange(256), c) for c in _CLASSES.values()], axis=1)
N_FEATURES = 3 * (len(_CLASSES) + 14) + 2


def lines_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines, their lengths in bytes, and the number of lines of each text."""
    data, offsets = bytes_of(texts)
    hashes = SpanHashes(data)
    # A line ends at a newline or at the space that follows each text.
    is_end = data == 10
    is_end[offsets[1:] - 1] = True
    ends = np.flatnonzero(is_end)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    owner = np.searchsorted(offsets, starts, "right") - 1
    n_lines = np.bincount(owner, minlength=len(texts))
    sizes = ends - starts
    of = np.zeros((len(data) + 1, _OF.shape[1]), np.int32)
    np.cumsum(_OF[data], axis=0, out=of[1:])
    counts = (of[ends] - of[starts]).astype(float)
    per = counts / np.maximum(sizes, 1)[:, None]

    w_start, w_end, _ = words_of(data, offsets)
    w_hash = hashes(w_start, w_end)
    w_line = np.searchsorted(ends, w_start)
    n_words = np.bincount(w_line, minlength=len(ends)).astype(float)
    same = np.concatenate([[False], (w_hash[1:] == w_hash[:-1]) & (w_line[1:] == w_line[:-1])])[: len(w_hash)]
    near = np.bincount(w_line, weights=same, minlength=len(ends))
    distinct = np.bincount((np.unique((w_line.astype(np.uint64) << np.uint64(40)) | (w_hash >> np.uint64(24))) >> np.uint64(40)).astype(np.int64), minlength=len(ends))
    capitals = np.bincount(w_line, weights=(data[w_start] >= 65) & (data[w_start] <= 90), minlength=len(ends))
    odd_end = np.bincount(w_line, weights=_OF[data[np.maximum(w_end - 1, 0)]][:, 5:].any(axis=1), minlength=len(ends)) if len(w_end) else np.zeros(len(ends))
    # Lines that the text has had before.
    line_key = hashes(starts, ends) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(line_key, return_index=True)[1]
    again = np.ones(len(ends))
    again[first] = 0
    words = np.maximum(n_words, 1)
    own = np.column_stack(
        [
            per,
            per[:, 0] > 0.4,
            per[:, 4:].sum(axis=1) > 0.15,
            near / words,
            near / words > 0.3,
            1 - distinct / words,
            (1 - distinct / words) * np.minimum(n_words / 100, 2),
            capitals / words,
            odd_end / words,
            odd_end / words > 0.3,
            again * (sizes > 0),
            np.minimum(np.log1p(sizes) / 8, 2),
            sizes == 0,
            n_words <= 3,
            np.minimum(sizes / words / 10, 3),
        ]
    ).astype(float)
    begins = np.cumsum(n_lines) - n_lines
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[begins] = 0
    after[begins + n_lines - 1] = 0
    edge = np.zeros(len(own))
    edge[begins] = 1
    return np.column_stack([own, before, after, edge, np.ones(len(own))]), sizes + 1.0, n_lines


class Model:
    """Emission weights (features x 2), transitions, and the calibration of the document's mean."""

    def __init__(self, weights: np.ndarray, trans: np.ndarray, slope: float, offset: float, fixed: float | None = None):
        self.weights, self.trans, self.slope, self.offset, self.fixed = weights, trans, slope, offset, fixed

    def line_marginals(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of every line, line weights, lines of each text."""
        x, sizes, n_lines = lines_of(texts)
        return crf.marginals(x @ self.weights, self.trans, n_lines)[0][:, 1], sizes, n_lines

    def means(self, texts: pa.Array) -> np.ndarray:
        good, sizes, n_lines = self.line_marginals(texts)
        begins = np.cumsum(n_lines) - n_lines
        return np.add.reduceat(good * sizes, begins) / np.add.reduceat(sizes, begins)

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        if self.fixed is not None:
            return [pa.array(np.full(len(texts), self.fixed))]
        return [pa.array(1 / (1 + np.exp(-(self.slope * _logit(self.means(texts)) + self.offset))))]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _features_by_piece(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [lines_of(p.column(0)) for p in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0)]
    return np.concatenate([x for x, *_ in parts]), np.concatenate([n for *_, n in parts])


def _means_by_piece(model: Model, texts: pa.Array) -> np.ndarray:
    return np.concatenate([model.means(p.column(0)) for p in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0)])


def train(rows: list[tuple[str, int]], rounds: int = ROUNDS) -> Model:
    """Two trainings of the chain, the second with relabelled lines, then the calibration."""
    labels = {y for _, y in rows}
    if len(labels) < 2:
        return Model(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), 1.0, 0.0, float(min(labels, default=1)))
    texts, y = pa.array([t for t, _ in rows], pa.string()), np.array([v for _, v in rows])
    x, n_lines = _features_by_piece(texts)
    owner = np.repeat(np.arange(len(rows)), n_lines)
    gold = y[owner]
    inner = np.setdiff1d(np.arange(len(gold)), np.cumsum(n_lines) - n_lines)
    share = (1 / np.maximum(n_lines, 1))[owner]  # the pull of a line: long documents do not outweigh the others

    def fitted() -> np.ndarray:
        pairs_gold = np.zeros((2, 2))
        np.add.at(pairs_gold, (gold[inner - 1], gold[inner]), 1)

        def gradient(theta: np.ndarray) -> np.ndarray:
            w, trans = theta[:-2], theta[-2:]
            p, pairs, _ = crf.marginals(x @ w, trans, n_lines)
            p[np.arange(len(gold)), gold] -= 1
            g = np.concatenate([x.T @ (p * share[:, None]), (pairs - pairs_gold) / max(1, len(inner)) * len(rows) * 0.2]) / len(rows)
            return g + DECAY * theta

        return crf.train(gradient, (x.shape[1] + 2, 2), rounds)

    theta = fitted()
    good = crf.marginals(x @ theta[:-2], theta[-2:], n_lines)[0][:, 1]
    worst = np.minimum.reduceat(good, np.cumsum(n_lines) - n_lines)[owner]
    gold = np.where((y[owner] == 0) & (good > 0.5) & (good > worst), 1, gold)
    theta = fitted()
    model = Model(theta[:-2], theta[-2:], 1.0, 0.0)
    m = _logit(_means_by_piece(model, texts))
    a = np.zeros(2)
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(50):  # Newton steps of the calibration
        p = 1 / (1 + np.exp(-(a[0] * m + a[1])))
        d = np.column_stack([m, np.ones(len(m))])
        g = d.T @ ((p - y) * balance) / len(y) + 1e-3 * a
        h = (d * (p * (1 - p) * balance)[:, None]).T @ d / len(y) + 1e-3 * np.eye(2)
        a -= np.linalg.solve(h, g)
    model.slope, model.offset = float(a[0]), float(a[1])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    return train(labelled_texts(docs, labels, label_col, per_label, id_col, text_col))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per document: doc (struct of the carried columns), score."""
    return map_texts(docs, text_col, carry or docs.columns, "score double", model)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
