"""Operator 3: toxicity by a classifier chain.

Three categories are predicted one after the other: ``crude`` (the text holds a word of a lexicon that the labels
single out), ``dense`` (it holds such words more often than half of the toxic texts do) and ``toxic`` (the label). Each
model is a linear one over the presence of words and word beginnings; the probabilities of earlier categories are
inputs of the later models, which are trained on out-of-fold predictions of the earlier ones, so they learn how far
these can be trusted. Nothing of a fold goes into its own predictions: features, lexicon and weights are chosen without it.

The chain is fitted on a bounded sample: about ``PER_LABEL`` labelled documents of each label, by a hash of the
identifier, never from the held-out fold. Scoring is one map over Arrow batches of whole texts, without a shuffle.

Defined cases: null and empty texts hold no word and get the chain's score for that; very long texts are read whole, each
as a piece of its own; repeated rows are scored each; with
only one label, or none, to learn from, every probability is that label's (0 without any); an empty table gives an
empty result. Columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_texts import SpanHashes, bytes_of, map_texts, pieces, words_of
from .common import held_out, labelled_texts, table

CATEGORIES = ("crude", "dense", "toxic")
PER_LABEL = 2500
FEATURES = 1024
PREFIX_BYTES = 5
FOLDS = 4
LEAST_TEXTS = 3
DECAY = 1e-4
_PREFIX_MARK = np.uint64(0x5851F42D4C957F2D)

#: Everything but letters, digits and bytes beyond ASCII ends a word.
_END = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and of word beginnings, the text of each, and the number of words of each text."""
    data, offsets = bytes_of(texts)
    hashes = SpanHashes(data)
    starts, ends, owner = words_of(data, offsets, _END)
    keys = np.concatenate([hashes(starts, ends), hashes(starts, np.minimum(ends, starts + PREFIX_BYTES)) ^ _PREFIX_MARK])
    return keys, np.concatenate([owner, owner]), np.bincount(owner, minlength=len(texts))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _linear(x: np.ndarray, y: np.ndarray, rounds: int = 100, rate: float = 0.3) -> np.ndarray:
    """Weights of a balanced logistic regression, the last one the offset (Adam on all rows)."""
    x = np.column_stack([x, np.ones(len(x), np.float32)])
    y = y.astype(np.float32)
    share = (np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) / len(y)).astype(np.float32)
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for k in range(1, rounds + 1):
        g = x.T @ ((_sigmoid(x @ w) - y) * share) + DECAY * np.append(w[:-1], np.float32(0))
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (1 - k / (rounds + 1)) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def _apply(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


class Chain:
    """Feature hashes in order, the weights of each category (features, earlier categories, offset)."""

    def __init__(self, keys: np.ndarray, weights: list[np.ndarray], fixed: float | None = None):
        self.keys, self.weights, self.fixed = keys, weights, fixed

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The texts and the places of their known features, each pair once."""
        keys, owner, _ = features_of(texts)
        if not len(self.keys):
            return owner[:0], owner[:0]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[at] == keys
        return np.divmod(np.unique(owner[hit].astype(np.int64) * len(self.keys) + at[hit]), len(self.keys))

    def probabilities(self, texts: pa.Array) -> np.ndarray:
        if self.fixed is not None:
            return np.full((len(texts), len(CATEGORIES)), self.fixed)
        owner, at = self.present(texts)
        p = np.zeros((len(texts), 0))
        for w in self.weights:
            own, earlier, offset = w[: len(self.keys)], w[len(self.keys) : -1], w[-1]
            score = np.bincount(owner, weights=own[at], minlength=len(texts)) + p @ earlier + offset
            p = np.column_stack([p, _sigmoid(score)])
        return p

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        p = self.probabilities(texts).astype(float)
        return [pa.array(p[:, k]) for k in range(len(CATEGORIES))]


def _distinct_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each feature of a text once: keys and texts, and the number of words of each text; worked out piece by piece."""
    keys, owners, n_words, done = [], [], [], 0
    for piece in pieces(pa.RecordBatch.from_arrays([texts], ["text"]), 0):
        k, o, n = features_of(piece.column(0))
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        once = np.append(True, (k[1:] != k[:-1]) | (o[1:] != o[:-1]))[: len(k)]
        keys.append(k[once])
        owners.append((o[once] + done).astype(np.int32))
        n_words.append(n)
        done += piece.num_rows
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(n_words)


class _Sample:
    """Distinct features of labelled texts, from which any part of the texts can choose its own."""

    def __init__(self, rows: list[tuple[str, int]]):
        texts, self.toxic = pa.array([t for t, _ in rows], pa.string()), np.array([y for _, y in rows]) == 1
        keys, self.owner, self.n_words = _distinct_features(texts)
        self.names, self.at = np.unique(keys, return_inverse=True)

    def chosen(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the features that single out the toxic texts of a part, in order, and their log odds there."""
        toxic = self.toxic[part]
        mine = part[self.owner]
        bad = np.bincount(self.at[mine], weights=self.toxic[self.owner[mine]], minlength=len(self.names))
        all_ = np.bincount(self.at[mine], minlength=len(self.names))
        odds = np.log((bad + 0.5) / (all_ - bad + 0.5) * max(int((~toxic).sum()), 1) / max(int(toxic.sum()), 1))
        value = np.where(all_ >= LEAST_TEXTS, odds * np.sqrt(bad), 0)
        best = np.sort(np.argsort(-value, kind="stable")[:FEATURES])
        best = best[value[best] > 0]
        return best, odds[best]

    def present(self, chosen: np.ndarray) -> np.ndarray:
        place = np.full(len(self.names), -1)
        place[chosen] = np.arange(len(chosen))
        x = np.zeros((len(self.toxic), len(chosen)), np.float32)
        known = place[self.at] >= 0
        x[self.owner[known], place[self.at[known]]] = 1
        return x

    def categories(self, x: np.ndarray, odds: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        """The lexicon of a part: features that its toxic texts hold many times as often. Categories of all texts by it."""
        lexicon = x[:, odds > 2.5].sum(axis=1)
        rate = lexicon / np.maximum(self.n_words, 1)
        crude = lexicon > 0
        typical = rate[part & self.toxic & crude]
        return [crude, crude & (rate > (np.median(typical) if len(typical) else 0)), self.toxic]


def out_of_fold(sample: _Sample, folds: int = FOLDS) -> np.ndarray:
    """Probabilities of each category (texts x categories) by chains that know nothing of the text's own fold: features,
    lexicon and weights all come from the other folds."""
    fold = np.arange(len(sample.toxic)) % folds
    parts = []
    for k in range(folds):
        part = fold != k
        chosen, odds = sample.chosen(part)
        x = sample.present(chosen)
        parts.append((part, x, sample.categories(x, odds, part)))
    out = np.zeros((len(fold), 0), np.float32)
    for c in range(len(CATEGORIES)):
        p = np.zeros(len(fold), np.float32)
        for part, x, y in parts:
            inputs = np.column_stack([x, out])
            p[~part] = _apply(_linear(inputs[part], y[c][part]), inputs[~part])
        out = np.column_stack([out, p])
    return out


def train(rows: list[tuple[str, int]]) -> Chain:
    labels = {y for _, y in rows}
    if len(labels) < 2:
        return Chain(np.empty(0, np.uint64), [], float(max(labels, default=0)))
    sample = _Sample(rows)
    everything = np.ones(len(rows), bool)
    chosen, odds = sample.chosen(everything)
    x = sample.present(chosen)
    earlier = out_of_fold(sample)
    return Chain(sample.names[chosen], [_linear(np.column_stack([x, earlier[:, :c]]), y) for c, y in enumerate(sample.categories(x, odds, everything))])


def fit(docs: DataFrame, labels: DataFrame, *, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    return train(labelled_texts(docs, labels, label_col, per_label, id_col, text_col))


def score(docs: DataFrame, chain: Chain, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per document: doc (struct of the carried columns) and a probability for each category."""
    return map_texts(docs, text_col, carry or docs.columns, ", ".join(f"{c} double" for c in CATEGORIES), chain)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "crude", "dense", F.col("toxic").alias("score"), (F.col("toxic") >= 0.5).cast("int").alias("predicted"))
