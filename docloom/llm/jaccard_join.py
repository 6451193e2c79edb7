"""Operator 2: n-gram Jaccard join by signature trees; exact, up to 64-bit hashes of words, shingles and sets.

1. Each text becomes its set of distinct word shingles. Texts with equal sets form a class; one row of a class stands
   for it from here on, so copies never meet as pairs.
2. Candidates. Two sets that link differ in at most H elements, with H from the sizes they may have. The range of
   shingle hashes is cut into H + 1 parts (and some more, so that empty parts do not count); linked sets agree in a
   whole part, so the hash of a part's content is a key that both have. A set has keys for the size class in which it
   is the smaller partner and for the one in which it is the larger. Keys travel as packed arrays, in buckets of bounded
   size. Components over shared keys hold every possible link within them.
   Components of more than ``REFINE_SETS`` sets are refined: the sets of a key are joined by trees over signatures of
   about two bits a token, and only sets that may overlap enough stay together.
3. Signature trees. The sets of a component are the leaves of a tree whose nodes hold the OR of the leaves' token bitmaps,
   their range of sizes, and by how much a leaf can have more tokens than bits. Two trees (or one with itself) are
   traversed together: a pair of nodes is dropped when the largest overlap that its bitmaps and sizes allow is too
   small, or when all its leaves are linked already. Pairs of leaves that remain are compared exactly.
4. Components of the links found; the smallest identifier names them.

Distribution: a component with more than ``BLOCK_SHINGLES`` shingles is cut into blocks by hash. First every block is
joined with itself and with block 0, which is linear and settles groups of near copies, however large; only blocks that
still hold sets in different components are then joined with each other. Lists of rows are broadcast only when their
counted size is small, else they are joined by key.

Defined cases: null and empty texts, or texts without words, have the empty set, link with nothing and are their own
component; with fewer words than a shingle the whole sequence is one; repeated rows are one class; a null identifier
names a component only when no other does; an empty table gives an empty result; input columns travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow_texts import SpanHashes, bytes_of, map_texts, mixed, pieces, words_of
from .common import row_struct, stored, table, text_of
from .components import UnionFind, components, forest

NGRAM, PERCENT = 4, 85
BUCKET_BYTES = 16 << 20
BLOCK_SHINGLES = 1 << 21
BROADCAST_ROWS = 1 << 20
FLUSH_KEYS = 1 << 18
REFINE_SETS = 64
LEAST_BUCKETS = 16
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_EMPTY = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(texts: pa.Array, ngram: int = NGRAM) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = bytes_of(texts)
    starts, ends, owner = words_of(data, offsets)
    words = SpanHashes(data)(starts, ends)
    n_words = np.bincount(owner, minlength=len(texts))
    sums = np.zeros(max(len(words) - ngram + 1, 0), np.uint64)
    for k in range(ngram):
        sums += words[k : k + len(sums)] * _ODD[k]
    hashed = mixed(sums + np.uint64(ngram))
    out, at = [], 0
    for n in n_words.tolist():
        if n >= ngram:
            found = np.sort(hashed[at : at + n - ngram + 1])
            out.append(found[np.append(True, found[1:] != found[:-1])])
        elif n:
            out.append(mixed((words[at : at + n] * _ODD[:n]).sum(keepdims=True, dtype=np.uint64) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def set_name(s: np.ndarray) -> int:
    """One 64-bit number for a set."""
    if not len(s):
        return 0
    both = np.array([mixed(s).sum(dtype=np.uint64), mixed(s ^ _EMPTY).sum(dtype=np.uint64) + np.uint64(len(s))])
    return int(mixed(both[:1] * _ODD[0] + both[1:])[0].astype(np.int64))


def size_classes(percent: int) -> list[int]:
    """Lower ends of the classes: the larger partner of a set of class i is in class i or i + 1."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * 100 // percent + 1)
    return ends


def parts_of(group: int, ends: list[int], percent: int) -> tuple[int, int]:
    """Parts, and how many of them may be empty, for pairs whose smaller set is of this class; (0, 0) if only equal sets link."""
    a = ends[group + 1] - 1
    differing = (100 - percent) * (a + a * 100 // percent) // (100 + percent)
    spare = 4 + (differing + 1) // 10
    return (differing + 1 + spare, spare) if differing else (0, 0)


def keys_by_class(s: np.ndarray, ends: list[int], percent: int) -> list[tuple[int, np.ndarray]]:
    """The keys of a set for each of its size classes; two sets that link share one."""
    own = int(np.searchsorted(ends, len(s), "right")) - 1
    content = mixed(s ^ _ODD[5])
    found = []
    for group in (own, own - 1):
        parts, spare = parts_of(group, ends, percent) if group >= 0 else (0, 0)
        if not parts:
            continue
        part = ((s >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        place = mixed(part[first] * _ODD[2] + np.uint64(group + 1))
        keys = mixed(np.add.reduceat(content, first) ^ place)
        if parts - len(first) > spare:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), part[first])
            keys = np.concatenate([keys, mixed(mixed(empty * _ODD[2] + np.uint64(group + 1)) ^ _EMPTY)])
        found.append((group, keys))
    return found


def keys_of(s: np.ndarray, ends: list[int], percent: int) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(k for _, k in keys_by_class(s, ends, percent))])


def signature_bits(group: int, ends: list[int]) -> int:
    """Bits of the signatures of a size class: about two for each token."""
    width = 512
    while width < 1 << 14 and width < 2 * ends[group + 1]:
        width *= 2
    return width


def bitmaps(sets: list[np.ndarray], width: int) -> np.ndarray:
    """A bit for each token, by the high bits of its hash: sets x words of 64 bits."""
    out = np.zeros((len(sets), width // 64), np.uint64)
    shift = np.uint64(64 - width.bit_length() + 1)
    for row, s in zip(out, sets, strict=True):
        at = s >> shift
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


class SignatureTree:
    """Leaves are sets in a given order; blocks of them, and nodes above, hold the OR of their bitmaps, the least and the
    largest size, and by how much a leaf has more tokens than bits."""

    BLOCK, FANOUT = 64, 8

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        self.bits, self.sizes = bits, sizes.astype(np.int64)
        self.excess = self.sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = []
        level, step = (bits, self.sizes, self.sizes, self.excess), self.BLOCK
        while not self.levels or len(level[0]) > 1:
            cuts = np.arange(0, len(level[0]), step)
            level = tuple(f.reduceat(x, cuts, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), level, strict=True))
            self.levels.append(level)
            step = self.FANOUT
        self.settled = [np.zeros(len(x[0]), bool) for x in self.levels]

    def leaves(self, level: int, node: int) -> tuple[int, int]:
        size = self.BLOCK * self.FANOUT**level
        return node * size, min((node + 1) * size, len(self.sizes))

    def children(self, level: int, node: int) -> range:
        return range(node * self.FANOUT, min((node + 1) * self.FANOUT, len(self.levels[level - 1][0])))

    def one_component(self, level: int, node: int, ids: list[int], found: UnionFind) -> bool:
        """Whether all leaves below are linked already; once they are, they stay so."""
        if not self.settled[level][node]:
            a, b = self.leaves(level, node)
            root = found.find(ids[a])
            if level:
                self.settled[level][node] = all(self.one_component(level - 1, c, ids, found) and found.find(ids[self.leaves(level - 1, c)[0]]) == root for c in self.children(level, node))
            else:
                self.settled[level][node] = all(found.find(x) == root for x in ids[a:b])
        return bool(self.settled[level][node])

    def may_link(self, level: int, a: int, b: int, percent: int) -> bool:
        """Whether the largest overlap that bitmaps and sizes allow is enough for some pair of leaves."""
        bits, low, high, excess = self.levels[level]
        if high[a] * 100 < percent * low[b] or high[b] * 100 < percent * low[a]:
            return False
        overlap = min(high[a], high[b], np.bitwise_count(bits[a] & bits[b]).sum(dtype=np.int64) + min(excess[a], excess[b]))
        return bool(overlap * (100 + percent) >= percent * (low[a] + low[b]))

    def pairs(self, a: int, b: int, percent: int) -> np.ndarray:
        """Pairs of leaves of two blocks (or one) that the bound leaves."""
        (a0, a1), (b0, b1) = self.leaves(0, a), self.leaves(0, b)
        both = np.bitwise_count(self.bits[a0:a1, None, :] & self.bits[None, b0:b1, :]).sum(axis=2, dtype=np.int64)
        x, y = self.sizes[a0:a1, None], self.sizes[None, b0:b1]
        overlap = np.minimum(np.minimum(x, y), both + np.minimum(self.excess[a0:a1, None], self.excess[None, b0:b1]))
        ok = overlap * (100 + percent) >= percent * (x + y)
        return np.argwhere(np.triu(ok, 1) if a == b else ok) + (a0, b0)

    def join(self, percent: int, found: UnionFind, ids: list[int], test=None) -> None:
        """Links leaves (``ids``: their places in ``found``) for which ``test`` holds (without it: that the bound leaves)."""
        top = len(self.levels) - 1
        todo = [(top, 0, 0)]
        while todo:
            level, a, b = todo.pop()
            if self.one_component(level, a, ids, found) and self.one_component(level, b, ids, found) and found.find(ids[self.leaves(level, a)[0]]) == found.find(ids[self.leaves(level, b)[0]]):
                continue
            if not self.may_link(level, a, b, percent):
                continue
            if level:
                if a == b:
                    below = self.children(level, a)
                    todo += [(level - 1, x, y) for x in below for y in below if x < y]
                    todo += [(level - 1, x, x) for x in below]  # taken first: near copies stand side by side
                else:
                    todo += [(level - 1, x, y) for x in self.children(level, a) for y in self.children(level, b)]
            else:
                for x, y in self.pairs(a, b, percent).tolist():
                    if found.find(ids[x]) != found.find(ids[y]) and (test is None or test(x, y)):
                        found.union(ids[x], ids[y])


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def tree_join(sets: list[np.ndarray], percent: int, known: list[int] | None = None) -> UnionFind:
    """Components of the sets by links; ``known``: labels of components that are known already."""
    found = UnionFind(len(sets))
    if known is not None:
        seen: dict[int, int] = {}
        for i, label in enumerate(known):
            found.union(seen.setdefault(label, i), i)
    if len(sets) > 1:
        order = sorted(range(len(sets)), key=lambda i: (sets[i][:4].tolist(), len(sets[i])))  # near copies have the same smallest hashes
        width = 1024
        while width < 1 << 14 and width < 2 * max(len(s) for s in sets):
            width *= 2
        tree = SignatureTree(bitmaps([sets[i] for i in order], width), np.array([len(sets[i]) for i in order]))
        tree.join(percent, found, order, lambda x, y: linked(sets[order[x]], sets[order[y]], percent))
    return found


def _packed_keys(ngram: int, percent: int, buckets: int):
    """Texts -> (bucket, kind, data): the keys of their sets with the sets' names, packed by bucket (kind 0), combined first:
    sets that share a key here are linked here (kind 1), and only one of them goes on under that key."""
    ends = size_classes(percent)

    def flush(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        # Sets of few shingles have no keys: they link with equal sets only.
        if any(map(len, keys)):
            key, node = np.concatenate(keys), np.concatenate(nodes)
            order = np.lexsort((node, key))  # buckets are ranges of keys
            key, node = key[order], node[order]
            fresh = np.append(True, key[1:] != key[:-1])
            a, b = _linked_to_first(key, node, fresh)
            key, node = key[fresh], node[fresh]
            bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            data = [key[x:y].tobytes() + node[x:y].tobytes() for x, y in zip(cuts, [*cuts[1:], len(key)], strict=True)]
            at, kind = bucket[cuts].astype(np.int64).tolist(), [0] * len(cuts)
            if len(a):
                at, kind, data = [*at, at[0]], [*kind, 1], [*data, a.tobytes() + b.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "kind", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for batch in batches:
            for piece in pieces(batch, 0):
                for s in shingle_sets(piece.column(0), ngram):
                    if len(s):
                        keys.append(keys_of(s, ends, percent))
                        nodes.append(np.full(len(keys[-1]), set_name(s), np.int64))
                        held += len(keys[-1])
                if held > FLUSH_KEYS:
                    yield from flush(keys, nodes)
                    keys, nodes, held = [], [], 0
        yield from flush(keys, nodes)

    return run


def _linked_to_first(key: np.ndarray, node: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest that links every set with the first one of the same key, for sorted keys."""
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
    pairs = np.unique(np.stack([node[first], node], axis=1)[node[first] != node], axis=0)
    return forest(pairs[:, 0], pairs[:, 1]) if len(pairs) else (np.empty(0, np.int64),) * 2


def _same_keys(group: pa.Table) -> pa.Table:
    """Links between the sets that share a key, as a forest."""
    kinds = group.column("kind").to_pylist()
    parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(2, -1) for x in group.column("data")]
    links = [p for p, kind in zip(parts, kinds, strict=True) if kind]
    keyed = [p for p, kind in zip(parts, kinds, strict=True) if not kind]
    if keyed:
        key, node = np.concatenate(keyed, axis=1)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        links.append(np.stack(_linked_to_first(key, node, np.append(True, key[1:] != key[:-1]))))
    a, b = forest(*np.concatenate(links, axis=1))
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _packed_signatures(ngram: int, percent: int, buckets: int):
    """Texts -> (bucket, data): keys with the signatures (name, size, smallest hash, bitmap) of the sets that have them. A
    bucket belongs to one size class; a signature is sent once for each bucket, not for each key."""
    ends = size_classes(percent)

    def flush(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, x in enumerate(sets):
            for group, keys in keys_by_class(x, ends, percent):
                by_class.setdefault(group, []).append((i, keys))
        at_bucket, out = [], []
        for group, found in by_class.items():
            mine = [sets[i] for i, _ in found]
            table_ = np.column_stack([np.array([set_name(x) for x in mine], np.int64).view(np.uint64), np.array([len(x) for x in mine], np.uint64), np.array([x[0] for x in mine], np.uint64), bitmaps(mine, signature_bits(group, ends))])
            key, owner = np.concatenate([k for _, k in found]), np.repeat(np.arange(len(mine)), [len(k) for _, k in found])
            bucket = (key >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            order = np.argsort(bucket, kind="stable")
            key, owner, bucket = key[order], owner[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
                names, at = np.unique(owner[a:b], return_inverse=True)
                at_bucket.append((group << 40) + int(bucket[a]))
                out.append(np.array([b - a, len(names)], np.int64).tobytes() + key[a:b].tobytes() + at.astype(np.int32).tobytes() + table_[names].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(at_bucket, pa.int64()), pa.array(out, pa.binary())], names=["bucket", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, held = [], 0
        for batch in batches:
            for piece in pieces(batch, 0):
                new = [s for s in shingle_sets(piece.column(0), ngram) if len(s)]
                sets += new
                held += sum(map(len, new))
                if held > FLUSH_KEYS:
                    yield from flush(sets)
                    sets, held = [], 0
        if sets:
            yield from flush(sets)

    return run


def _may_link(percent: int):
    """A bucket's keys and signatures -> links between sets that share a key and that their signatures let overlap enough."""

    def run(group: pa.Table) -> pa.Table:
        keys, owners, tables, n = [], [], [], 0
        for x in group.column("data"):
            data = x.as_py()
            k, m = np.frombuffer(data, np.int64, 2).tolist()
            keys.append(np.frombuffer(data, np.uint64, k, 16))
            owners.append(np.frombuffer(data, np.int32, k, 16 + 8 * k).astype(np.int64) + n)
            tables.append(np.frombuffer(data, np.uint64, offset=16 + 12 * k).reshape(m, -1))
            n += m
        key, owner, table_ = np.concatenate(keys), np.concatenate(owners), np.concatenate(tables)
        order = np.lexsort((table_[owner, 2], key))
        key, owner = key[order], owner[order]
        cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        found = UnionFind(n)
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(key)], strict=True):
            ids = owner[x:y].tolist()
            if len(ids) > 1 and len({found.find(i) for i in ids}) > 1:
                SignatureTree(np.ascontiguousarray(table_[ids, 3:]), table_[ids, 1]).join(percent, found, ids)
        names = table_[:, 0].copy().view(np.int64)
        roots = np.array([found.find(i) for i in range(n)], np.int64)
        moved = np.flatnonzero(roots != np.arange(n))
        return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(names[roots[moved]], pa.int64())})

    return run


def _set_work(ngram: int):
    def work(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([s.tobytes() for s in shingle_sets(texts, ngram)], pa.binary())]

    return work


def _name_work(ngram: int):
    def work(texts: pa.Array) -> list[pa.Array]:
        sets = shingle_sets(texts, ngram)
        return [pa.array([len(s) for s in sets], pa.int64()), pa.array([set_name(s) for s in sets], pa.int64())]

    return work


def _join_group(percent: int):
    """Rows of one task (task, part, node, known, shingles): links found in each part of it."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        part, node, known = (group.column(c).to_numpy() for c in ("part", "node", "known"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("shingles")]
        a, b = [], []
        cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)], strict=True):
            _, at = np.unique(node[x:y], return_index=True)
            rows = (at + x).tolist()
            found = tree_join([sets[i] for i in rows], percent, [int(known[i]) for i in rows])
            for k, i in enumerate(rows):
                if (root := found.find(k)) != k:
                    a.append(node[i])
                    b.append(node[rows[root]])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def jaccard_components(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    percent: int = PERCENT,
    carry: list[str] | None = None,
    block_shingles: int = BLOCK_SHINGLES,
    broadcast_rows: int = BROADCAST_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
    refine_sets: int = REFINE_SETS,
    one_task_links: int | None = None,
) -> DataFrame:
    """A row per document: doc (struct of the carried columns), n_shingles, component_id, kept (one row of each component)."""
    spark = docs.sparkSession
    limits = {} if one_task_links is None else {"one_task_links": one_task_links}
    key = F.struct(F.xxhash64(docs[id_col], text_of(docs[text_col])).alias("h"), F.crc32(text_of(docs[text_col]).cast("binary")).alias("c"))
    keyed = docs.select(key.alias("key"), docs[id_col].alias("id"), docs[text_col].alias("text"), row_struct(docs, carry).alias("row"))
    named = map_texts(keyed, "text", ["key", "id", "row"], "n bigint, node bigint", _name_work(ngram))
    rows = stored(named.select("doc.*", "n", "node").withColumn("at", F.monotonically_increasing_id()), "shingled")

    # Classes of equal sets; the rows that do not stand for their class are left out of the join.
    real = rows.filter("n > 0")
    classes = stored(real.groupBy("node").agg(F.min("key").alias("key"), F.min("id").alias("id"), F.max("n").alias("n")), "classes")
    copies = stored(real.select("key", "node").join(classes.select("node", F.col("key").alias("stands")), "node").filter("key != stands").select("key").distinct(), "copies")
    texts = keyed.select("key", "text")

    def few(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= broadcast_rows else df

    # Candidates: sets that share a key.
    total = classes.agg(F.sum(F.col("n") * 0.4 + 12)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, int(total * 16 // bucket_bytes) + 1)  # a set has a link in each bucket at most
    packed = texts.join(few(copies), "key", "left_anti").select("text").mapInArrow(_packed_keys(ngram, percent, buckets), "bucket bigint, kind int, data binary")
    near = components(packed.groupBy("bucket").applyInArrow(_same_keys, "a bigint, b bigint"), **limits)
    near = stored(near.unionByName(near.select(F.col("component").alias("node"), "component").distinct()), "candidates")

    # Large components are mostly chains of sets that share a key by chance: those are linked anew, only where signatures
    # of sets with the same key allow enough overlap.
    large = near.groupBy("component").agg(F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > refine_sets).select("component")
    large = stored(large, "large")
    doubted = stored(near.join(few(large), "component", "left_semi").join(classes, "node").select("node", "component", "key", "n"), "doubted")
    work = doubted.agg(F.sum((F.col("n") * 0.4 + 12) * 12 + 600)).first()[0]
    if work:
        buckets = int(work // (4 * bucket_bytes)) + 1  # of each of some tens of size classes
        signed = texts.join(few(doubted.select("key")), "key", "left_semi").select("text").mapInArrow(_packed_signatures(ngram, percent, buckets), "bucket bigint, data binary")
        anew = stored(components(signed.groupBy("bucket").applyInArrow(_may_link(percent), "a bigint, b bigint"), **limits), "refined")
        anew = anew.unionByName(anew.select(F.col("component").alias("node"), "component").distinct())
        near = near.join(few(large), "component", "left_anti").select("node", "component").unionByName(anew)
    members = near.join(classes, "node").select("node", "component", "key", "n")
    # Only components of several blocks are named, so a hot one is no key of a join.
    sizes = members.groupBy("component").agg(F.ceil(F.sum("n") / block_shingles).alias("blocks")).filter("blocks > 1")
    members = members.join(few(stored(sizes, "sizes")), "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    members = stored(members, "members")
    small = members.filter("blocks = 1").agg(F.sum("n")).first()[0] or 0
    groups = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(small // max(block_shingles // 4, 1)) + 1)

    def links(tasks: DataFrame) -> DataFrame:
        """tasks: key, node, known, task, part -> links among the sets of each part."""
        found = texts.join(few(tasks.groupBy("key").agg(F.collect_list(F.struct("node", "known", "task", "part")).alias("todo"))), "key")
        sets = map_texts(found, "text", ["todo"], "shingles binary", _set_work(ngram))
        each = sets.select("shingles", F.explode("doc.todo").alias("x")).select("x.*", "shingles")
        return stored(each.groupBy("task").applyInArrow(_join_group(percent), "a bigint, b bigint"), "tree-links")

    # Small components share a task by hash; of large ones every block meets block 0.
    partner = F.when(F.col("blocks") == 1, F.array(F.lit(0).cast("long"))).when(F.col("block") > 0, F.array("block")).otherwise(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("blocks") - 1, F.lit(1))))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("component"), F.lit(groups))).otherwise(F.xxhash64("component", "part"))
    first = members.select("key", "node", F.col("node").alias("known"), "component", "blocks", F.explode(partner).alias("part"))
    found = links(first.select("key", "node", "known", task.alias("task"), F.xxhash64("component", "part").alias("part")))
    if not members.filter("blocks > 2").isEmpty():
        settled = components(found, **limits).withColumnRenamed("component", "known")
        left = members.filter("blocks > 2").join(settled, "node", "left").withColumn("known", F.coalesce("known", "node"))
        left = stored(left, "unsettled")
        open_ = left.groupBy("component").agg(F.min("known").alias("x"), F.max("known").alias("y")).filter("x != y").select("component")
        left = left.filter("block > 0").join(open_, "component", "left_semi")
        others = F.filter(F.sequence(F.lit(1).cast("long"), F.col("blocks") - 1), lambda j: j != F.col("block"))
        pair = left.select("key", "node", "known", "component", "block", F.explode(others).alias("other"))
        part = F.xxhash64("component", F.least("block", "other"), F.greatest("block", "other"))
        found = found.unionByName(links(pair.select("key", "node", "known", part.alias("task"), part.alias("part"))))

    # Names: the smallest identifier, over classes; the row that stays is the first with it.
    joined = components(found, **limits)
    joined = stored(joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct()), "joined")
    together = stored(classes.select("node", "id").join(joined, "node"), "together")
    names = stored(together.groupBy("component").agg(F.min("id").alias("name")), "names")
    alone = classes.join(joined, "node", "left_anti").select("node", F.col("node").alias("component"), F.col("id").alias("name"))
    labelled = stored(together.join(few(names), "component").select("node", "component", "name").unionByName(alone), "labelled")
    out = rows.join(labelled, ["node"], "left")
    stays = real.join(labelled.filter(F.col("name").isNotNull()), "node").filter("id = name").groupBy("component").agg(F.min("at").alias("stays"))
    nameless = real.join(labelled.filter(F.col("name").isNull()), "node").groupBy("component").agg(F.min("at").alias("stays"))
    first = stays.unionByName(nameless).select(F.col("stays").alias("at"), F.lit(True).alias("first"))  # one row of a component, so no key is hot
    out = out.join(first, "at", "left")
    return out.select(
        F.col("row").alias("doc"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n") == 0) | F.coalesce("first", F.lit(False))).alias("kept"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    out = jaccard_components(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc.doc_id", "n_shingles", "component_id")
