"""Operator 5: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed 1- to 3-grams of lower-case code points (what is no letter is a space), as frequency in the text
times inverse document frequency. The weights are learned by the follow-the-regularised-leader proximal update with L1
and L2 penalties, so most are zero; a temperature is then fitted on a part of the sample that the weights have not seen.

The model is fitted on a bounded sample: about ``PER_LANGUAGE`` labelled documents of each language, by a hash of the
identifier, outside the held-out fold (document frequencies belong to the fitted model). It is a table of 65,536 rows.
Scoring is one map over Arrow batches of whole texts without a shuffle: per text the mean of its n-grams' weights.

Defined cases: null texts and texts without a letter are ``und`` with score 0; repeated rows are scored each; with no
labelled document everything is ``und``; ties go to the first language by name; an empty table gives an empty result.
Very long texts are read whole, each as a piece of its own. Columns are carried in a struct and cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_texts import map_texts, mixed
from .common import bounded_sample, held_out, one_text_each, table

PER_LANGUAGE = 1000
BITS = 16
SCALE = 20.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
UNKNOWN = "und"

_letter = np.zeros(1 << 16, bool)
_letter[[c for c in range(1 << 16) if chr(c).isalpha()]] = True


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts one after the other (three for each position), offsets of the texts, who has letters."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer(("  ".join(lower) + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) + 2 for t in lower])
    letters = _letter[np.minimum(codes, (1 << 16) - 1)]  # U+FFFF is no letter
    high = codes >= 1 << 16
    if high.any():
        distinct, at = np.unique(codes[high], return_inverse=True)
        letters[high] = np.array([chr(c).isalpha() for c in distinct])[at]
    c = np.where(letters, codes, 32).astype(np.uint64)
    two = c[:-1] << np.uint64(21) | c[1:]
    c, two = c[:-2], two[:-1]
    three = two << np.uint64(21) | np.concatenate([c[2:], [32, 32]]).astype(np.uint64)
    blank = (c == 32) & ((two & np.uint64((1 << 21) - 1)) == 32)  # runs of spaces tell nothing
    keys = np.stack([c, two + np.uint64(1 << 62), three + np.uint64(1 << 63)], axis=1)
    hashed = (mixed(keys) >> np.uint64(64 - BITS)).astype(np.int32)
    hashed[blank] = -1
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    counts = np.add.reduceat(letters, offsets[:-1]) if len(texts) else np.empty(0)
    return hashed, offsets, counts > 0


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of rows by text; the last text lacks its two final spaces."""
    return np.add.reduceat(values, np.minimum(offsets[:-1], len(values) - 1), axis=0)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.temperature = languages, temperature
        self.table = np.concatenate([weights * idf[:, None] * SCALE, np.zeros((1, weights.shape[1]))]).astype(np.float32)  # the last row is that of -1

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        hashed, offsets, known = grams(texts)
        total = np.maximum(_sums((hashed[:, 0] >= 0).astype(np.float64), offsets) * 3, 1)
        summed = sum(_sums(self.table[hashed[:, k]].astype(np.float64), offsets) for k in range(3))
        return summed / total[:, None], known

    def __call__(self, texts: pa.Array) -> list[pa.Array]:
        values = texts.to_pylist()
        if not self.languages:
            return [pa.array([UNKNOWN] * len(values), pa.string()), pa.array([0.0] * len(values))]
        logits, known = self.logits(values)
        p = _softmax(logits / self.temperature)
        best = p.argmax(axis=1)
        names = [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return [pa.array(names, pa.string()), pa.array(np.where(known, p.max(axis=1), 0.0))]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS) -> Model:
    """Follow the regularised leader, one labelled text at a time; every fifth text is kept for the temperature."""
    rows = [r for r in rows if any(c.isalpha() for c in r[0])]
    languages = sorted({y for _, y in rows})
    size, k = 1 << BITS, len(languages)
    if not rows:
        return Model([], np.zeros((size, 0)), np.zeros(size), 1.0)
    vectors = []
    for text, y in rows:
        hashed = grams([text])[0]
        at, n = np.unique(hashed[hashed >= 0], return_counts=True)
        vectors.append((at, n / n.sum(), languages.index(y)))
    fit, rest = ([v for i, v in enumerate(vectors) if i % 5], vectors[::5]) if len(vectors) >= 5 * k else (vectors, vectors)
    seen = np.zeros(size)
    for at, *_ in fit:
        seen[at] += 1
    idf = np.log((1 + len(fit)) / (1 + seen)) + 1
    z, n = np.zeros((size, k)), np.zeros((size, k))

    def weights(at=slice(None)) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(fit)):
            at, tf, y = fit[i]
            x = tf * idf[at] * SCALE
            w = weights(at)
            p = _softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
    model = Model(languages, weights(), idf, 1.0)
    logits = np.array([(tf * idf[at] * SCALE) @ model_w for at, tf, _ in rest for model_w in [weights(at)]])
    gold = np.array([y for *_, y in rest])
    temperatures = np.exp(np.linspace(-4, 3, 57))
    losses = [-np.log(_softmax(logits / t)[np.arange(len(gold)), gold] + 1e-12).mean() for t in temperatures]
    model.temperature = float(temperatures[int(np.argmin(losses))])
    return model


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), docs[lang_col].alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")))
    sample = bounded_sample(rows, "lang", F.col("id"), per_language)
    return train(one_text_each(sample, "lang"))


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """A row per document: doc, lang_pred, score."""
    return map_texts(docs, text_col, carry or docs.columns, "lang_pred string, score double", model)


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs, fit(docs), carry=["doc_id"])
    return out.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "lang_pred", "score")
