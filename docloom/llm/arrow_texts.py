"""Arrow batches of texts for the operators that run in Python: bounded pieces, words and their hashes in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_struct

#: Texts are worked on in pieces of about this many bytes, so their arrays stay in the processor's caches; one longer
#: text is a piece of its own. Short ones are at most PIECE_TEXTS a piece.
PIECE_BYTES = 1 << 16
PIECE_TEXTS = 1 << 12

_rng = np.random.default_rng(20240501)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Byte classes: ASCII white space ends a word; A-Z become lower case.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def pieces(batch: pa.RecordBatch, at: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts in column ``at`` hold about ``limit`` bytes."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(ends):
        done = ends[start - 1] if start else 0
        stop = min(max(start + 1, int(np.searchsorted(ends, done + limit, "right"))), start + PIECE_TEXTS)
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(docs: DataFrame, text_col: str, carry: list[str], out: str, work: Callable[[pa.Array], list[pa.Array]]) -> DataFrame:
    """A row per document: doc (struct of the carried columns) and the columns of ``out``, made by ``work`` from pieces of texts."""
    source = docs.select(row_struct(docs, carry).alias("doc"), docs[text_col].cast("string").alias("text"))
    fields = T._parse_datatype_string(out).fields
    schema = T.StructType([T.StructField("doc", source.schema["doc"].dataType), *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for piece in pieces(batch, 1):
                done.append(work(piece.column(1)))
            if done:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.concat_arrays(x) for x in zip(*done, strict=True))], names=names)

    return source.mapInArrow(run, schema)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a space, as bytes, and the offsets at which they start and the last one ends."""
    joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string()), null_handling="replace", null_replacement="")
    offsets = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1, joined.offset * 8)
    data = joined.buffers()[2]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8), offsets - offsets[0]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers(BASE, 2 * PIECE_BYTES), _powers(BASE_INVERSE, 2 * PIECE_BYTES)


class SpanHashes:
    """64-bit hashes of any byte spans of ``data`` from one prefix sum; A-Z count as lower case unless ``exact``."""

    def __init__(self, data: np.ndarray, exact: bool = False):
        n = len(data) + 1
        powers, self.inverse = (_POWERS[:n], _INVERSE[:n]) if n <= len(_POWERS) else (_powers(BASE, n), _powers(BASE_INVERSE, n))
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((BYTE_VALUES if exact else LOWER_VALUES)[data] * powers[:-1], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.inverse[starts])

    def every(self, size: int) -> np.ndarray:
        """The hashes of all spans of one size."""
        n = len(self.sums) - size
        return mixed((self.sums[size:] - self.sums[:n]) * self.inverse[:n])


def words_of(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts from ``bytes_of``: starts, ends, and the text of each."""
    edges = np.diff(space[data].astype(np.int8), prepend=np.int8(1))
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)  # data ends in a space, so every word has an end
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1
