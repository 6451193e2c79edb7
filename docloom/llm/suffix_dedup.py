"""Operator 4: removal of repeated byte strings by external induced sorting of suffixes.

Removed is every byte covered by a ``LENGTH``-byte string that also starts in a document with a smaller identifier.

1. Every such string (a window) belongs to its anchor: the position of the smallest hash among the ``K``-byte strings in
   it. Equal windows have equal anchors at equal places, so anchors split the suffixes into shards that never share a
   window. Anchors with equal text around them (112 bits of hashes) are a class; of a class only the smallest document
   goes on, for the others' windows are repeats already. Copies of a whole text are set aside in the same way before.
2. Where several classes have an anchor, the text around it goes to the anchor's shard, once a class. As the table grows,
   more and more of it shares the anchor alone: where a shard fits in memory, pieces are cut down to what lies between
   windows whose hash occurs again. The suffixes of the rest are sorted by external induced sorting (``induced_sort``):
   recursive, with disk-backed queues of tuples that carry common prefixes, in memory bounded by ``limit`` whatever the
   size of the shard. Neighbours with a common prefix of ``LENGTH`` are equal windows; each run takes its smallest document.
3. Decided windows return to their documents, which drop what they cover.

Distribution: anchors travel packed. Each task first combines what it holds: of a class only its smallest document is
sent to the class's bucket, and what the others lose is known at once, so a passage in a third of all documents is an
entry a task. Anchors that a sample of documents finds in more than ``HOT_SHARE`` of them are compared class by class
instead of in one bucket, and their windows go to shards one by one, by their own hash, combined first in the same way:
no anchor fills a shard. Files of a shard lie in Spark's own local folders, as its spills do, and last as long as the task.

Defined cases: null and empty texts have no bytes; texts shorter than a window lose nothing; equal identifiers count as
one document, so repeated rows take nothing from each other; a null identifier counts as the largest (identifiers are
numbers); an empty table gives an empty result; very long texts are read whole, each as a piece of its own; columns are
carried in a struct and cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_texts import BASE, SpanHashes, bytes_of, mixed, pieces
from .common import row_struct, stored, table, text_of
from .induced_sort import END, PADDING, groups, ranges, sorted_suffixes

LENGTH = 50
K = 20
SPAN = LENGTH - K + 1  # K-byte strings in a window
BUCKET_BYTES = 3 << 20
SHARD_BYTES = 1 << 20
CHUNK_BYTES = 2 << 20
BROADCAST_ROWS = 1 << 20
FLUSH_ANCHORS = 1 << 19
#: Items that a sort holds in memory, per queue and tape; longer texts are files.
SORT_LIMIT = 1 << 22
SAMPLE_DOCS, HOT_SHARE, LEAST_HOT = 8192, 1 / 400, 20
NO_ID = (1 << 63) - 1
LOSE, ASK = 0, 1
#: An answer: 64 bits for document, key and content, 32 more of the content, and what becomes of the windows.
ANSWER = np.dtype([("name", "<u8"), ("check", "<u4"), ("state", "u1")])
#: A piece of text in a shard.
PIECE = np.dtype([("doc", "<i8"), ("row", "<i8"), ("low", "<u4"), ("size", "u1")])


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of x[i : i + width], for all i where that fits."""
    done, out = 1, x
    while done * 2 <= width:
        out = pick(out[: len(out) - done], out[done:])
        done *= 2
    return pick(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1]) if width > done else out


class Anchors:
    """Anchors of all texts of ``bytes_of``: position, hash, first and last window, hash of the covered text, the text's number."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        empty = np.empty(0, np.int64)
        self.at = self.low = self.high = self.owner = empty
        self.key = self.content = np.empty(0, np.uint64)
        n = len(data) - LENGTH + 1
        if n <= 0:
            return
        hashes = SpanHashes(data, exact=True)
        h = hashes.every(K)
        least = _sliding(h, SPAN, np.minimum)[:n]
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:n]
        inside = np.arange(n) + LENGTH <= offsets[owner + 1] - 1  # the space after each text is no part of it
        start = np.flatnonzero(inside)
        if not len(start):
            return
        padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(SPAN, np.uint64)])
        best = _sliding(padded, SPAN, np.maximum)[: len(h)]
        is_chosen = h[: len(best)] == best
        chosen = np.flatnonzero(is_chosen)
        k = (np.cumsum(is_chosen) - is_chosen)[start]  # the first of them that is not before the window
        found, sought = h[chosen], least[start]
        open_ = np.flatnonzero(found[k] != sought)
        while len(open_):
            k[open_] += 1
            open_ = open_[found[k[open_]] != sought[open_]]
        first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (owner[start[1:]] != owner[start[:-1]])))
        last = np.append(first[1:], len(k)) - 1
        self.at, self.low, self.high, self.owner = chosen[k[first]], start[first], start[last], owner[start[first]]
        # Anchors have small hashes, so these are spread again. Both numbers have 56 bits.
        self.key = mixed(h[self.at] ^ BASE) >> np.uint64(8)
        self.content = mixed(hashes(self.low, self.high + LENGTH) + (self.at - self.low).astype(np.uint64) * BASE) >> np.uint64(8)


def _answer_names(doc: np.ndarray, key: np.ndarray, content: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    name = mixed(mixed(mixed(doc.view(np.uint64)) ^ key) ^ content)
    return name, (content >> np.uint64(24)).astype(np.uint32)


def _answers(doc: np.ndarray, key: np.ndarray, content: np.ndarray, state: np.ndarray, chunks: int) -> list[tuple[int, bytes]]:
    """Answers packed by the chunk of their document."""
    out = np.empty(len(doc), ANSWER)
    out["name"], out["check"] = _answer_names(doc, key, content)
    out["state"] = state
    chunk = np.mod(doc, chunks)
    order = np.argsort(chunk, kind="stable")
    out, chunk = out[order], chunk[order]
    return [(int(chunk[x]), out[x:y].tobytes()) for x, y in ranges(groups(chunk), len(chunk))]


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    return sorted_set[np.minimum(np.searchsorted(sorted_set, values), len(sorted_set) - 1)] == values


def _share(hashed: np.ndarray, parts: int) -> np.ndarray:
    return ((hashed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _entries(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> bytes:
    """Seven bytes of key and content and, where that is enough, four of the document beyond the smallest one."""
    least = int(doc.min())
    narrow = int(doc.max()) - least < 1 << 32
    docs = (doc - least).astype(np.uint32) if narrow else doc
    short = [np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for x in (key, content)]
    return np.array([len(key), least, narrow], np.int64).tobytes() + b"".join(short) + docs.tobytes()


def _from_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, least, narrow = np.frombuffer(data, np.int64, 3).tolist()
    long = np.zeros((2, n, 8), np.uint8)
    long[:, :, :7] = np.frombuffer(data, np.uint8, 14 * n, 24).reshape(2, n, 7)
    key, content = long.view(np.uint64)[:, :, 0]
    doc = np.frombuffer(data, np.uint32 if narrow else np.int64, n, 24 + 14 * n).astype(np.int64)
    return key, content, doc + least if narrow else doc


def _by_row(doc: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[list[int], list[int], list[bytes]]:
    """Ranges of windows, in the order of their rows: documents, rows, and the ranges of each as pairs."""
    cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))[: len(doc)])
    data = np.stack([first, stop], axis=1).astype(np.int64).tobytes()
    return doc[cuts].tolist(), row[cuts].tolist(), [data[16 * x : 16 * y] for x, y in ranges(cuts, len(doc))]


def _classes(key: np.ndarray, content: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (key, content, doc) in this order, and for each whether it is the smallest document of its class."""
    order = np.lexsort((doc, content, key))
    key, content, doc = key[order], content[order], doc[order]
    change = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    once = np.append(True, change | (doc[1:] != doc[:-1]))[: len(key)]
    first = np.append(True, change)[: len(key)]
    return key[once], content[once], doc[once], first[once]


def _anchor_messages(buckets: int, chunks: int, hot: np.ndarray):
    """(id, text) -> (target, kind, data). Kind 0, to a bucket: key, content and document of the smallest document of each
    class here. Kind 1, to a bucket that passes them on: answers for a chunk of documents, whose number comes first."""

    def packed(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        key, content, doc, first = _classes(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        lost = ~first
        found = [(int(k), 1, np.int64(k).tobytes() + data) for k, data in _answers(doc[lost], key[lost], content[lost], np.full(int(lost.sum()), LOSE, np.uint8), chunks)]
        key, content, doc = key[first], content[first], doc[first]
        bucket = _share(np.where(_among(key, hot), mixed(key ^ mixed(content)), key << np.uint64(8)), buckets)
        order = np.argsort(bucket, kind="stable")
        key, content, doc, bucket = key[order], content[order], doc[order], bucket[order]
        found += [(int(bucket[x]), 0, _entries(key[x:y], content[x:y], doc[x:y])) for x, y in ranges(groups(bucket), len(key))]
        target, kind, data = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(target, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["target", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for piece in pieces(batch, 1):
                a = Anchors(*bytes_of(piece.column(1)))
                parts.append((a.key, a.content, piece.column(0).to_numpy()[a.owner]))
                held += len(a.key)
                if held > FLUSH_ANCHORS:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return run


def _compare_anchors(chunks: int, hot: np.ndarray):
    """A bucket's messages -> (chunk, data): answers. A class's other documents lose their windows; its smallest one asks,
    if other classes have the anchor. Classes of hot anchors are elsewhere, so those always ask."""

    def run(group: pa.Table) -> pa.Table:
        kinds = group.column("kind").to_pylist()
        out, parts = [], []
        for kind, x in zip(kinds, group.column("data"), strict=True):
            data = x.as_py()
            if kind:
                out.append((int(np.frombuffer(data, np.int64, 1)[0]), data[8:]))
            else:
                parts.append(_from_entries(data))
        if parts:
            key, content, doc, first = _classes(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            cuts = groups(key)
            sizes = np.diff(np.append(cuts, len(key)))
            shared = np.repeat(np.minimum.reduceat(doc, cuts) != np.maximum.reduceat(doc, cuts), sizes)
            several = np.repeat(np.add.reduceat(first, cuts, dtype=np.int64) > 1, sizes)
            ask = first & ((shared & several) | _among(key, hot))
            said = ask | ~first
            out += _answers(doc[said], key[said], content[said], np.where(ask[said], ASK, LOSE).astype(np.uint8), chunks)
        chunk, data = zip(*out, strict=True) if out else ((), ())
        return pa.table({"chunk": pa.array(chunk, pa.int64()), "data": pa.array(data, pa.binary())})

    return run


def _stretch(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of the spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _of_smallest(windows: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the windows (rows of bytes) belong to the smallest document that has their content here, and which to others."""
    _, at = np.unique(windows.view(f"V{LENGTH}")[:, 0], return_inverse=True)
    order = np.lexsort((doc, at))
    cuts = groups(at[order])
    least = np.repeat(doc[order][cuts], np.diff(np.append(cuts, len(order))))
    smallest, gone = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    smallest[order] = doc[order] == least
    gone[order] = doc[order] > least
    return smallest, gone


def _resolve(shards: int, hot: np.ndarray):
    """Texts of a chunk and the answers for it -> decided windows by row (kind 0) and texts of those that ask by shard (kind 1)."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x.as_buffer(), ANSWER) for x in answers.column("data")]
        known = np.concatenate(parts) if parts else np.empty(0, ANSWER)
        known = known[np.argsort(known["name"], kind="stable")]
        name, check, state = (np.ascontiguousarray(known[c]) for c in ("name", "check", "state"))
        ids, rows, kinds, out, asked, singles = [], [], [], [], [], []

        def decided(doc: np.ndarray, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> None:
            """Windows that start in [first, stop), given in the order of their rows."""
            for kept, new in zip((ids, rows, out), _by_row(doc, row, first, stop), strict=True):
                kept.extend(new)
            kinds.extend([0] * (len(out) - len(kinds)))

        for batch in texts.combine_chunks().to_batches() if len(name) else []:
            for piece in pieces(batch, batch.schema.get_field_index("text")):
                data, offsets = bytes_of(piece.column("text"))
                a = Anchors(data, offsets)
                if not len(a.at):
                    continue
                doc, row = piece.column("id").to_numpy()[a.owner], piece.column("row").to_numpy()[a.owner]
                mine, mine_check = _answer_names(doc, a.key, a.content)
                at = np.minimum(np.searchsorted(name, mine), len(name) - 1)
                hit = (name[at] == mine) & (check[at] == mine_check)
                base = offsets[a.owner]
                done = np.flatnonzero(hit & (state[at] == LOSE))
                decided(doc[done], row[done], (a.low - base)[done], (a.high - base)[done] + 1)
                ask = hit & (state[at] == ASK)
                wide, narrow = np.flatnonzero(ask & ~_among(a.key, hot)), np.flatnonzero(ask & _among(a.key, hot))
                if len(narrow):  # window by window
                    n = (a.high - a.low + 1)[narrow]
                    start, which = _stretch(a.low[narrow], n), np.repeat(narrow, n)
                    singles.append((doc[which], row[which], start - base[which], data[start[:, None] + np.arange(LENGTH)]))
                if len(wide):
                    sizes = a.high[wide] + LENGTH - a.low[wide]
                    asked.append((mixed(a.key[wide]), doc[wide], row[wide], (a.low - base)[wide], sizes, data[_stretch(a.low[wide], sizes)]))
        if singles:
            doc, row, place, windows = (np.concatenate(x) for x in zip(*singles, strict=True))
            smallest, gone = _of_smallest(windows, doc)
            decided(doc[gone], row[gone], place[gone], place[gone] + 1)
            words = np.ascontiguousarray(windows[smallest, :48]).view(np.uint64)
            shard = mixed((words * BASE ** np.arange(1, 7, dtype=np.uint64)).sum(axis=1, dtype=np.uint64))
            asked.append((shard, doc[smallest], row[smallest], place[smallest], np.full(len(shard), LENGTH), windows[smallest].reshape(-1)))
        if asked:
            shard, doc, row, low, sizes, content = (np.concatenate(x) for x in zip(*asked, strict=True))
            begin = np.cumsum(sizes) - sizes
            shard = _share(shard, shards)
            order = np.argsort(shard, kind="stable")
            for x, y in ranges(groups(shard[order]), len(order)):
                i = order[x:y]
                numbers = np.empty(len(i), PIECE)
                numbers["doc"], numbers["row"], numbers["low"], numbers["size"] = doc[i], row[i], low[i], sizes[i]
                ids.append(int(shard[i[0]]))
                rows.append(0)
                kinds.append(1)
                out.append(np.int64(len(i)).tobytes() + numbers.tobytes() + content[_stretch(begin[i], sizes[i])].tobytes())
        return pa.table({"target": pa.array(ids, pa.int64()), "row": pa.array(rows, pa.int64()), "kind": pa.array(kinds, pa.int32()), "data": pa.array(out, pa.binary())})

    return run


class _Spool:
    """Arrays one after the other: in memory, or in a file where there are more than ``limit`` items."""

    def __init__(self, folder: str, limit: int, dtype: np.dtype):
        self.path, self.limit, self.dtype = tempfile.mktemp(dir=folder), limit, np.dtype(dtype)
        self.parts, self.held, self.written = [], 0, False

    def append(self, x: np.ndarray) -> None:
        self.parts.append(x)
        self.held += len(x)
        if self.held > self.limit:
            self.flush()

    def flush(self) -> None:
        with open(self.path, "ab") as f:
            for x in self.parts:
                f.write(x.tobytes())
        self.parts, self.held, self.written = [], 0, True

    def whole(self) -> np.ndarray:
        if self.written:
            self.flush()
            return np.memmap(self.path, self.dtype, "r")
        return np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)


def _narrowed(numbers: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces cut down to what lies between their first and last window whose hash occurs again; equal windows have equal hashes."""
    size = numbers["size"].astype(np.int64)
    begin, n = np.cumsum(size) - size, size - (LENGTH - 1)
    start, place = _stretch(begin, n), _stretch(np.zeros_like(n), n)
    h = SpanHashes(text, exact=True).every(LENGTH)[start] if len(start) else np.empty(0, np.uint64)
    order = np.argsort(h)
    equal = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(h), bool)
    again[order[1:][equal]] = again[order[:-1][equal]] = True
    cuts = np.cumsum(n) - n
    first = np.minimum.reduceat(np.where(again, place, LENGTH), cuts) if len(n) else n
    last = np.maximum.reduceat(np.where(again, place, -1), cuts) if len(n) else n
    kept = np.flatnonzero(last >= 0)
    out, first = numbers[kept], first[kept]
    size = last[kept] - first + LENGTH
    out["low"], out["size"] = out["low"] + first, size
    return out, text[_stretch(begin[kept] + first, size)]


def _spooled(pieces_: Iterator[tuple[np.ndarray, np.ndarray]], folder: str, limit: int) -> tuple[_Spool, _Spool, _Spool]:
    """Numbers, text and ends of the pieces."""
    numbers, texts = _Spool(folder, limit, PIECE), _Spool(folder, limit, np.uint8)
    ends, n_bytes = _Spool(folder, limit, np.int64), 0
    for n, content in pieces_:
        numbers.append(n)
        texts.append(content)
        ends.append(np.cumsum(n["size"], dtype=np.int64) + n_bytes)
        n_bytes += len(content)
    return numbers, texts, ends


def repeated_windows(pieces_: Iterator[tuple[np.ndarray, np.ndarray]], folder: str, limit: int = SORT_LIMIT) -> Iterator[tuple[np.ndarray, ...]]:
    """Pieces (numbers, text) -> blocks of document, row and place of the windows that a smaller document also has."""
    numbers, texts, ends = _spooled(pieces_, folder, limit)
    if not (numbers.written or texts.written):  # in memory, so all their windows can be counted
        numbers, texts, ends = _spooled(iter([_narrowed(numbers.whole(), texts.whole())]), folder, limit)
    texts.append(np.array([END] + [0] * PADDING, np.uint8))
    numbers, ends = numbers.whole(), ends.whole()

    def gone(at: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
        piece = np.searchsorted(ends, at, "right")
        here = np.asarray(numbers[piece])
        doc = here["doc"]
        cuts = groups(group)
        least = np.repeat(np.minimum.reduceat(doc, cuts), np.diff(np.append(cuts, len(doc))))
        lost = np.flatnonzero(doc > least)
        begin = ends[piece[lost]] - here["size"][lost]
        return doc[lost], here["row"][lost], here["low"][lost].astype(np.int64) + at[lost] - begin

    held, least = np.empty(0, np.int64), LENGTH  # windows of the run that is still open, smallest prefix since
    for position, prefix in sorted_suffixes(texts.whole(), folder, depth=LENGTH, limit=limit):
        piece = np.searchsorted(ends, position, "right")
        w = np.flatnonzero(piece < len(ends))
        w = w[position[w] + LENGTH <= ends[piece[w]]]
        if not len(w):
            least = min(least, int(prefix.min()))
            continue
        between = np.minimum.reduceat(prefix[: w[-1] + 1], np.append(0, w[:-1] + 1))
        between[0] = min(between[0], least)
        least = int(prefix[w[-1] + 1 :].min(initial=LENGTH))
        at = np.append(held, position[w])
        fresh = np.append(np.zeros(len(held), bool), between < LENGTH)
        last = int(np.flatnonzero(fresh)[-1]) if fresh.any() else 0
        if last:
            yield gone(at[:last], np.cumsum(fresh[:last]))
        held = at[last:]
    if len(held):
        yield gone(held, np.zeros(len(held), np.int64))


def _sort_shard(limit: int):
    """Texts around anchors that ask -> decided windows, by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for x in batch.column(batch.schema.get_field_index("data")):
                    data = x.as_buffer()
                    n = int(np.frombuffer(data, np.int64, 1)[0])
                    yield np.frombuffer(data, PIECE, n, 8), np.frombuffer(data, np.uint8, offset=8 + n * PIECE.itemsize)

        folder = tempfile.mkdtemp(prefix="docloom-", dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        try:
            for doc, row, at in repeated_windows(each(), folder, limit):
                if not len(at):
                    continue
                order = np.lexsort((at, row, doc))
                doc, row, at = doc[order], row[order], at[order]
                fresh = np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + 1))[: len(at)]
                first = np.flatnonzero(fresh)
                last = np.append(first[1:], len(at)) - 1
                ids, rows, data = _by_row(doc[first], row[first], at[first], at[last] + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(data, pa.binary())], names=["target", "row", "data"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of each text."""
    for batch in batches:
        for piece in pieces(batch, 0):
            a = Anchors(*bytes_of(piece.column(0)))
            order = np.lexsort((a.key, a.owner))
            key, owner = a.key[order], a.owner[order]
            once = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1]))[: len(key)]
            yield pa.RecordBatch.from_arrays([pa.array(key[once].view(np.int64))], names=["key"])


def hot_anchors(rows: DataFrame, n_rows: int, sample_docs: int = SAMPLE_DOCS, share: float = HOT_SHARE, least: int = LEAST_HOT) -> np.ndarray:
    """Anchors in at least this share of a sample of the texts; a sample has few of those. They only steer the distribution."""
    sample = rows.filter(F.pmod(F.xxhash64("id", "row"), F.lit(1 << 30)) < int(min(1.0, sample_docs / max(n_rows, 1)) * (1 << 30)))
    most = max(least, int(min(n_rows, sample_docs) * share))
    found = sample.select("text").mapInArrow(_anchor_keys, "key bigint").groupBy("key").count().filter(F.col("count") >= most)
    return np.sort(found.select("key").toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def _remove(texts: pa.Table, windows: pa.Table) -> pa.Table:
    """Rows of a chunk and their decided windows -> what is left of each."""
    by_row: dict[tuple[int, int], list[np.ndarray]] = {}
    for doc, row, data in zip(*(windows.column(c).to_pylist() for c in ("target", "row", "data")), strict=True):
        by_row.setdefault((doc, row), []).append(np.frombuffer(data, np.int64).reshape(-1, 2))
    kept, spans = [], []
    for doc, h, text in zip(*(texts.column(c).to_pylist() for c in ("id", "row", "text")), strict=True):
        row = (doc, h)
        data = (text or "").encode("utf-8", "surrogatepass")
        if row not in by_row:
            kept.append(data)
            spans.append([])
            continue
        first, stop = np.concatenate(by_row[row]).T
        stop = stop + (LENGTH - 1)  # bytes covered by windows that start in [first, stop)
        order = np.argsort(first, kind="stable")
        first, reach = first[order], np.maximum.accumulate(stop[order])
        cuts = np.flatnonzero(np.append(True, first[1:] > reach[:-1]))
        begins, ends = first[cuts], np.append(reach[cuts[1:] - 1], reach[-1])
        spans.append([{"start": int(x), "stop": int(y)} for x, y in zip(begins, ends, strict=True)])
        kept.append(b"".join(data[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(data)], strict=True)))
    return pa.table(
        {
            "doc": texts.column("doc"),
            "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            "kept": pa.array(kept, pa.binary()),
            "n_bytes": pa.array([len(k) + sum(s["stop"] - s["start"] for s in g) for k, g in zip(kept, spans, strict=True)], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        }
    )


def remove_repeats(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: list[str] | None = None,
    bucket_bytes: int = BUCKET_BYTES,
    shard_bytes: int = SHARD_BYTES,
    chunk_bytes: int = CHUNK_BYTES,
    broadcast_rows: int = BROADCAST_ROWS,
    sort_limit: int = SORT_LIMIT,
    least_hot: int = LEAST_HOT,
) -> DataFrame:
    """A row per document: doc (struct of the carried columns), removed (spans of bytes), kept (bytes), n_bytes, kept_sha256."""
    spark = docs.sparkSession
    text = text_of(docs[text_col])
    least = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    total, n_rows = docs.select(F.octet_length(text).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    buckets = max(least, total * 3 // 2 // bucket_bytes + 1)
    shards = max(least, total // 4 // shard_bytes + 1)
    chunks = max(least, total // chunk_bytes + 1) | 1
    # Rows with the same identifier and text have the same result: the pair (id, row) names them.
    rows = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"), row_struct(docs, carry).alias("doc"))

    def few(names: DataFrame) -> DataFrame:
        return F.broadcast(names) if names.count() <= broadcast_rows else names

    # A copy of a text with a smaller identifier loses everything; only the first of equal texts goes on.
    same = F.sha2(F.col("text"), 256)
    first = stored(rows.groupBy(same.alias("same")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "copied")
    copies = rows.select("row", "id", same.alias("same")).join(few(first), "same").filter("id > first_id").select("id", "row").distinct()
    copies = few(stored(copies, "copies"))
    all_rows, rows = rows, rows.join(copies, ["id", "row"], "left_anti")
    hot = hot_anchors(rows, n_rows, least=least_hot)
    found = rows.select("id", "text").mapInArrow(_anchor_messages(buckets, chunks, hot), "target bigint, kind int, data binary")
    answers = found.withColumn("bucket", F.when(F.col("kind") == 0, F.col("target")).otherwise(F.pmod("target", F.lit(buckets))))
    answers = answers.groupBy("bucket").applyInArrow(_compare_anchors(chunks, hot), "chunk bigint, data binary")
    by_id = rows.select("id", "row", "text", F.pmod("id", F.lit(chunks)).alias("chunk"))
    resolved = by_id.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_resolve(shards, hot), "target bigint, row bigint, kind int, data binary")
    resolved = stored(resolved, "windows")
    sorted_ = resolved.filter("kind = 1").select("target", "data").groupBy("target").applyInArrow(_sort_shard(sort_limit), "target bigint, row bigint, data binary")
    decided = stored(resolved.filter("kind = 0").select("target", "row", "data").unionByName(sorted_), "decided")

    # Only texts that lose something meet their windows; the others keep all their bytes.
    touched = few(decided.select(F.col("target").alias("id"), "row").distinct())
    losing = rows.join(touched, ["id", "row"], "left_semi").select("id", "row", "text", "doc", F.pmod("id", F.lit(chunks)).alias("chunk"))
    windows = decided.withColumn("chunk", F.pmod("target", F.lit(chunks)))
    doc_type = rows.schema["doc"].dataType
    out_type = T.StructType([T.StructField("doc", doc_type), *T._parse_datatype_string("removed array<struct<start: bigint, stop: bigint>>, kept binary, n_bytes bigint, kept_sha256 string").fields])
    lost = losing.groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(_remove, out_type)
    data = F.col("text").cast("binary")
    whole = rows.join(touched, ["id", "row"], "left_anti").select(
        "doc", F.array().cast("array<struct<start: bigint, stop: bigint>>").alias("removed"), data.alias("kept"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(data, 256).alias("kept_sha256")
    )
    n = F.octet_length("text").cast("long")
    copied = all_rows.join(copies, ["id", "row"], "left_semi").select(
        "doc",
        F.when(n >= LENGTH, F.array(F.struct(F.lit(0).cast("long").alias("start"), n.alias("stop")))).otherwise(F.array().cast("array<struct<start: bigint, stop: bigint>>")).alias("removed"),
        F.when(n >= LENGTH, F.lit(b"")).otherwise(data).alias("kept"),
        n.alias("n_bytes"),
        F.sha2(F.when(n >= LENGTH, F.lit(b"")).otherwise(data), 256).alias("kept_sha256"),
    )
    return whole.unionByName(lost).unionByName(copied)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), carry=["doc_id"])
    n_removed = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return out.select("doc.doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
