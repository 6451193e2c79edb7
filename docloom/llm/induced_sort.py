"""External induced sorting: the suffixes of a byte text in order, each with the prefix it shares with the one before it.

Types: a suffix is S where it is smaller than the next one, else L; a left-most S (LMS) is an S after an L.

1. The strings from one LMS to the next are named in their order. The names are a shorter text, whose suffixes are sorted
   in the same way, by recursion, until a text of names fits in ``limit`` symbols; that one is sorted by doubling.
2. The L suffixes are induced in ascending order from the LMS suffixes, the S suffixes in descending order from the L
   suffixes. A suffix that is served puts the one before it into a priority queue under that one's first symbol. Symbols
   only grow (or only fall) in a pass, and equal ones are served first in, first out.
3. Queued tuples carry a position and the common prefix with the tuple queued before them under the same symbol. It is
   one symbol longer than the smallest common prefix between the suffixes that induced the two, which a monotone stack
   over the blocks served so far gives. Only where two symbols meet are prefixes compared directly.

Queues, sorted results and the sorter of names hold ``limit`` items each in memory; beyond that they write runs to
``folder`` and read them block by block. The text itself may be a memory-mapped file, read by position. Common prefixes
count up to ``depth`` bytes, and suffixes that agree in so many stand side by side, in any order.
"""

from __future__ import annotations

import bisect
import heapq
import os
import uuid
from collections.abc import Iterator

import numpy as np

DEPTH = 50
#: Ends a text; no byte of UTF-8 equals it. ``PADDING`` zeros follow it, so words can be read at every position.
END = 255
PADDING = 72
_BITS, _UNKNOWN = 6, 63
_BOUNDS = np.array([1 << (8 * k) for k in range(1, 8)], np.uint64)


def groups(sorted_values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else np.empty(0, np.int64)


def ranges(cuts: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(cuts.tolist(), [*cuts[1:].tolist(), n], strict=True)) if n else []


def _packed(position: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return position << _BITS | prefix


def _unpacked(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return items >> _BITS, items & _UNKNOWN


def _file(folder: str) -> str:
    return os.path.join(folder, uuid.uuid4().hex)


class _Run:
    """Items on disk, sorted by key, with the keys and where each starts; read from front to back."""

    def __init__(self, folder: str, keys: np.ndarray, starts: np.ndarray, items: np.ndarray):
        self.paths = [_file(folder) for _ in range(3)]
        for path, x in zip(self.paths, (keys, starts, items), strict=True):
            x.tofile(path)
        self.keys, self.starts, self.items = (np.memmap(p, np.int64, "r") for p in self.paths)
        self.at, self.taken = 0, 0

    def head(self) -> int | None:
        return int(self.keys[self.at]) if self.at < len(self.keys) else None

    def take(self, most: int) -> np.ndarray:
        first, stop = int(self.starts[self.at]) + self.taken, int(self.starts[self.at + 1])
        found = np.array(self.items[first : min(stop, first + most)])
        self.taken += len(found)
        if first + len(found) == stop:
            self.at, self.taken = self.at + 1, 0
            if self.at == len(self.keys):
                for path in self.paths:
                    os.remove(path)
        return found


class DiskQueue:
    """A priority queue of items by key, first in first out among equal keys, which beyond ``limit`` items goes to disk in runs."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.held: dict[int, list[np.ndarray]] = {}
        self.order: list[int] = []
        self.n_held, self.runs = 0, []

    def push(self, key: int, items: np.ndarray) -> None:
        waiting = self.held.get(key)
        if waiting is None:
            self.held[key] = [items]
            heapq.heappush(self.order, key)
        else:
            waiting.append(items)
        self.n_held += len(items)
        if self.n_held > self.limit:
            keys = sorted(self.held)
            parts = [np.concatenate(self.held[k]) for k in keys]
            starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            self.runs.append(_Run(self.folder, np.array(keys, np.int64), starts.astype(np.int64), np.concatenate(parts)))
            self.held, self.order, self.n_held = {}, [], 0

    def next_key(self) -> int | None:
        while self.order and self.order[0] not in self.held:
            heapq.heappop(self.order)
        self.runs = [r for r in self.runs if r.head() is not None]
        return min([*self.order[:1], *(r.head() for r in self.runs)], default=None)

    def take(self, key: int) -> np.ndarray | None:
        """The next items of a key, the oldest first; None when there are none."""
        for run in self.runs:
            if run.head() == key:
                return run.take(self.limit)
        waiting = self.held.get(key)
        if not waiting:
            return None
        del self.held[key]
        found = waiting[0] if len(waiting) == 1 else np.concatenate(waiting)
        self.n_held -= len(found)
        return found


class Tape:
    """Items in the order in which they are appended; beyond ``limit`` they go to a file."""

    def __init__(self, folder: str, limit: int):
        self.folder, self.limit = folder, limit
        self.parts, self.n_held, self.n, self.path, self.all = [], 0, 0, None, None
        self.buckets: list[tuple[int, int, int]] = []

    def append(self, symbol: int, items: np.ndarray) -> None:
        if self.buckets and self.buckets[-1][0] == symbol:
            self.buckets[-1] = (symbol, self.buckets[-1][1], self.n + len(items))
        else:
            self.buckets.append((symbol, self.n, self.n + len(items)))
        self.parts.append(items)
        self.n += len(items)
        self.n_held += len(items)
        if self.n_held > self.limit:
            self._write()

    def _write(self) -> None:
        self.path = self.path or _file(self.folder)
        with open(self.path, "ab") as f:
            for p in self.parts:
                p.tofile(f)
        self.parts, self.n_held = [], 0

    def close(self) -> None:
        if self.path:
            self._write()
            self.all = np.memmap(self.path, np.int64, "r")
        else:
            self.all = np.concatenate(self.parts) if self.parts else np.empty(0, np.int64)
            self.parts = []

    def blocks(self, start: int, stop: int, backwards: bool = False) -> Iterator[np.ndarray]:
        cuts = list(range(start, stop, self.limit))
        for x in reversed(cuts) if backwards else cuts:
            yield np.array(self.all[x : min(x + self.limit, stop)])

    def remove(self) -> None:
        self.all = None
        if self.path:
            os.remove(self.path)


class DiskSorter:
    """Sorts rows of ``dtype`` by the field ``key``, stably; beyond ``limit`` rows it writes sorted runs and merges them."""

    def __init__(self, folder: str, limit: int, dtype: np.dtype):
        self.folder, self.limit, self.dtype = folder, limit, dtype
        self.parts, self.n_held, self.runs = [], 0, []

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.parts) if self.parts else np.empty(0, self.dtype)
        self.parts, self.n_held = [], 0
        return rows[np.argsort(rows["key"], kind="stable")]

    def push(self, rows: np.ndarray) -> None:
        self.parts.append(rows)
        self.n_held += len(rows)
        if self.n_held > self.limit:
            path = _file(self.folder)
            self._sorted().tofile(path)
            self.runs.append(path)

    def merged(self) -> Iterator[np.ndarray]:
        last = self._sorted()
        runs = [np.memmap(p, self.dtype, "r") for p in self.runs] + ([last] if len(last) else [])
        at = [0] * len(runs)
        size = max(self.limit // max(len(runs), 1), 1)
        while any(a < len(r) for a, r in zip(at, runs, strict=True)):
            heads = [np.array(r[a : a + size]) for a, r in zip(at, runs, strict=True)]
            # What is not beyond the end of any block whose run goes on is complete.
            bound = min((h["key"][-1] for h, a, r in zip(heads, at, runs, strict=True) if a + size < len(r)), default=None)
            taken = []
            for k, h in enumerate(heads):
                n = len(h) if bound is None else int(np.searchsorted(h["key"], bound, "right"))
                taken.append(h[:n])
                at[k] += n
            rows = np.concatenate(taken)
            yield rows[np.argsort(rows["key"], kind="stable")]
        for path in self.runs:
            os.remove(path)


class _Level:
    """A text of symbols and the byte positions of its symbols in the lowest text (None there)."""

    def __init__(self, text: np.ndarray, n: int, at: np.ndarray | None, lowest: np.ndarray, depth: int, folder: str, limit: int):
        self.text, self.n, self.at, self.lowest = text, n, at, lowest
        self.depth, self.folder, self.limit = depth, folder, limit
        self.words = np.ndarray((len(lowest) - 8,), ">u8", lowest, strides=(1,))

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at p and q share, at most ``depth``."""
        p, q = (p, q) if self.at is None else (np.asarray(self.at[p]), np.asarray(self.at[q]))
        out = np.full(len(p), self.depth, np.int64)
        left = np.arange(len(p))
        for k in range(0, self.depth, 8):
            x = self.words[p[left] + k].astype(np.uint64) ^ self.words[q[left] + k].astype(np.uint64)
            differ = x != 0
            out[left[differ]] = np.minimum(self.depth, k + 7 - np.searchsorted(_BOUNDS, x[differ], "right"))
            left = left[~differ]
            if not len(left):
                break
        return out

    def weight(self, at: np.ndarray) -> np.ndarray | int:
        """Bytes of the symbols at ``at``; the last symbol is never asked for."""
        return 1 if self.at is None else np.asarray(self.at[at + 1]) - np.asarray(self.at[at])

    def types(self) -> np.ndarray:
        """Whether each suffix is S, worked out from the end block by block."""
        out = np.zeros(self.n, bool) if self.n <= self.limit else np.memmap(_file(self.folder), bool, "w+", shape=(self.n,))
        after_symbol, after_type = -1, False  # the end is smaller than any symbol
        for start in range((self.n - 1) // self.limit * self.limit, -1, -self.limit):
            x = np.asarray(self.text[start : min(start + self.limit, self.n)]).astype(np.int64)
            following = np.append(x[1:], after_symbol)
            differ = x != following
            differs, k = np.flatnonzero(differ), np.cumsum(differ) - differ  # k: the first of them that is not before
            known = k < len(differs)
            is_s = np.full(len(x), after_type)
            place = differs[k[known]]
            is_s[known] = x[place] < following[place]
            out[start : start + len(x)] = is_s
            after_symbol, after_type = int(x[0]), bool(is_s[0])
        return out

    def lms(self, is_s: np.ndarray) -> np.ndarray:
        """Positions of the LMS suffixes, in the order of the text; on disk if there are many."""
        tape = Tape(self.folder, self.limit)
        for start in range(1, self.n, self.limit):
            here = np.asarray(is_s[start : start + self.limit])
            before = np.asarray(is_s[start - 1 : start - 1 + len(here)])
            tape.append(0, np.flatnonzero(here & ~before) + start)
        tape.close()
        return tape.all

    def names(self, lms: np.ndarray) -> np.ndarray:
        """A symbol for each LMS string, equal and ordered as the strings are; a string that another one begins with is the larger."""
        if len(lms) <= self.limit and self.at is None:
            return self._names_in_memory(np.asarray(lms))
        size = np.dtype(self.text.dtype).itemsize
        width = -(-(self.depth + 2) // (1 if self.at is None else 2)) * size
        sorter = DiskSorter(self.folder, self.limit, np.dtype([("key", f"S{width}"), ("at", np.int64)]))
        step = max(self.limit * 8 // width, 1)
        for start in range(0, len(lms), step):
            first = np.asarray(lms[start : start + step])
            stop = np.append(first[1:], lms[start + step] if start + step < len(lms) else self.n)
            inner = np.arange(width // size)
            index = first[:, None] + inner
            symbols = np.asarray(self.text[np.minimum(index, self.n - 1)])
            symbols[index >= self.n] = 0
            symbols[index > stop[:, None]] = np.iinfo(symbols.dtype).max
            symbols = symbols.astype(symbols.dtype.newbyteorder(">"))
            rows = np.empty(len(first), sorter.dtype)
            rows["key"] = np.ascontiguousarray(symbols).view(f"S{width}")[:, 0]
            rows["at"] = np.arange(start, start + len(first))
            sorter.push(rows)
        by_place = DiskSorter(self.folder, self.limit, np.dtype([("key", np.int64), ("name", np.uint32)]))
        name, last = -1, None
        for rows in sorter.merged():
            fresh = np.append(last is None or rows["key"][0] != last, rows["key"][1:] != rows["key"][:-1])
            named = np.empty(len(rows), by_place.dtype)
            named["key"], named["name"] = rows["at"], name + np.cumsum(fresh)
            name, last = int(named["name"][-1]), rows["key"][-1]
            by_place.push(named)
        path = _file(self.folder)
        with open(path, "wb") as f:
            for rows in by_place.merged():
                np.ascontiguousarray(rows["name"]).tofile(f)
        return np.memmap(path, np.uint32, "r")

    def _names_in_memory(self, lms: np.ndarray) -> np.ndarray:
        """Sorted by words of eight bytes; a name is the place of its group, which later words split."""
        length = np.append(np.diff(lms) + 1, self.depth + 16)  # the last one goes on to the end
        name, left = np.zeros(len(lms), np.int64), np.arange(len(lms))
        for k in range(0, self.depth, 8):
            word = self.words[lms[left] + k].astype(np.uint64)
            rest = np.minimum(length[left] - k, 8)
            word |= np.where(rest < 8, np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.minimum(rest, 7) * 8).astype(np.uint64), np.uint64(0))
            order = np.lexsort((word, name[left])) if k else np.argsort(word, kind="stable")
            left, word = left[order], word[order]
            old = name[left]
            head = np.append(True, old[1:] != old[:-1])
            fresh = head | np.append(True, word[1:] != word[:-1])
            place = np.arange(len(left))
            group, part = np.maximum.accumulate(np.where(head, place, 0)), np.maximum.accumulate(np.where(fresh, place, 0))
            name[left] = old + part - group
            alone = fresh & np.append(fresh[1:], True)
            left = left[(length[left] >= k + 8) & ~alone]  # one that ends here is still to go behind those that go on
            if not len(left):
                break
        return name.astype(np.uint32)

    def by_doubling(self) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes of a text of names that fits in memory: positions in order and their common prefixes."""
        rank, step = np.asarray(self.text[: self.n]).astype(np.int64), 1
        while True:
            after = np.zeros(self.n, np.int64)
            after[: self.n - step] = rank[step:] + 1
            names, at = np.unique(rank * (int(rank.max()) + 2) + after, return_inverse=True)
            rank, step = at.astype(np.int64), 2 * step
            if len(names) == self.n or 2 * step >= self.depth or step >= self.n:
                break
        order = np.argsort(rank, kind="stable")
        return order, np.append(0, self.common(order[:-1], order[1:]))


class _Pass:
    """One pass of induction: serves suffixes and queues those before them with their common prefixes."""

    def __init__(self, level: _Level, wanted, sign: int):
        self.level, self.wanted, self.sign = level, wanted, sign
        self.queue = DiskQueue(level.folder, level.limit)
        self.blocks, self.times, self.least = 0, [], []
        self.last: dict[int, tuple[int, int]] = {}
        self.previous: int | None = None

    def start(self, position: int) -> None:
        """Queues the last suffix, which the end of the text induces."""
        symbol = int(self.level.text[position])
        self.last[symbol] = (-1, 0)
        self.queue.push(self.sign * symbol, _packed(np.array([position]), np.array([_UNKNOWN])))

    def met(self, position: int) -> int:
        """The common prefix with the suffix served last, by comparison."""
        return 0 if self.previous is None else int(self.level.common(np.array([self.previous]), np.array([position]))[0])

    def serve(self, position: np.ndarray, prefix: np.ndarray) -> None:
        level, depth = self.level, self.level.depth
        k = np.flatnonzero(position > 0)
        k = k[self.wanted(position[k] - 1)]
        if len(k):
            symbol = np.asarray(level.text[position[k] - 1])
            order = np.argsort(symbol, kind="stable")
            k, symbol = k[order], symbol[order]
            beyond = np.append(prefix, depth)
            between = np.empty(len(k), np.int64)
            between[1:] = np.minimum.reduceat(beyond, k + 1)[:-1]  # within a symbol: from one served suffix to the next
            head, tail = np.minimum.accumulate(prefix), np.minimum.accumulate(beyond[::-1])[::-1]
            cuts = groups(symbol)
            spans = ranges(cuts, len(symbol))
            names = symbol[cuts].tolist()
            for (x, y), s in zip(spans, names, strict=True):
                seen = self.last.get(s)
                if seen is None:
                    between[x] = _UNKNOWN
                else:
                    i = bisect.bisect_right(self.times, seen[0])
                    between[x] = min(seen[1], int(head[k[x]]), self.least[i] if i < len(self.least) else depth)
                self.last[s] = (self.blocks, int(tail[k[y - 1] + 1]))
            before = position[k] - 1
            items = _packed(before, np.where(between == _UNKNOWN, _UNKNOWN, np.minimum(depth, between + level.weight(before))))
            for (x, y), s in zip(spans, names, strict=True):
                self.queue.push(self.sign * s, items[x:y])
        lowest = int(prefix.min())
        while self.least and self.least[-1] >= lowest:
            self.least.pop()
            self.times.pop()
        self.least.append(lowest)
        self.times.append(self.blocks)
        self.blocks += 1
        self.previous = int(position[-1])

    def serve_queue(self, key: int, tape: Tape) -> None:
        """Serves all that is queued under a key, also what comes to it meanwhile, onto a tape."""
        while (items := self.queue.take(key)) is not None:
            tape.append(self.sign * key, items)
            position, prefix = _unpacked(items)
            if prefix[0] == _UNKNOWN:
                prefix[0] = self.met(int(position[0]))
            self.serve(position, prefix)


def _seeds(level: _Level, found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Blocks of sorted LMS suffixes, split by first symbol."""
    for position, prefix in found:
        symbol = np.asarray(level.text[position])
        for x, y in ranges(groups(symbol), len(symbol)):
            yield int(symbol[x]), position[x:y], prefix[x:y]


def _sorted_level(level: _Level) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of positions in the order of their suffixes, with common prefixes."""
    if level.at is not None and level.n <= level.limit:
        yield level.by_doubling()
        return
    is_s = level.types()
    lms = level.lms(is_s)
    found: Iterator = iter(())
    if len(lms):
        at = lms if level.at is None else np.asarray(level.at[lms])
        above = _Level(level.names(lms), len(lms), at, level.lowest, level.depth, level.folder, level.limit)
        found = ((np.asarray(lms[p]), c) for p, c in _sorted_level(above))

    up = _Pass(level, lambda p: ~np.asarray(is_s[p]), 1)
    up.start(level.n - 1)
    l_tape = Tape(level.folder, level.limit)
    seeds = _seeds(level, found)
    seed, bucket = next(seeds, None), None
    while True:
        key = up.queue.next_key()
        if key is not None and (seed is None or key <= seed[0]):
            up.serve_queue(key, l_tape)
        elif seed is not None:
            symbol, position, prefix = seed
            prefix = prefix.copy()
            if symbol != bucket:
                prefix[0], bucket = up.met(int(position[0])), symbol
            up.serve(position, prefix)
            seed = next(seeds, None)
        else:
            break
    l_tape.close()

    down = _Pass(level, lambda p: np.asarray(is_s[p]), -1)
    s_tape = Tape(level.folder, level.limit)
    waiting = list(l_tape.buckets)
    while True:
        key = down.queue.next_key()
        if key is not None and (not waiting or -key >= waiting[-1][0]):
            down.serve_queue(key, s_tape)
        elif waiting:
            _, start, stop = waiting.pop()
            carried = None
            for items in l_tape.blocks(start, stop, backwards=True):
                position, prefix = _unpacked(items[::-1])
                first = down.met(int(position[0])) if carried is None else carried
                carried = int(prefix[-1])
                down.serve(position, np.append(first, prefix[:-1]))
        else:
            break
    s_tape.close()

    yield from _merged(level, l_tape, s_tape)
    l_tape.remove()
    s_tape.remove()


def _merged(level: _Level, l_tape: Tape, s_tape: Tape) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Symbol by symbol the L suffixes, then the S suffixes, which were served backwards; in blocks of about ``limit``."""

    def each() -> Iterator[np.ndarray]:
        smaller, larger = list(l_tape.buckets)[::-1], list(s_tape.buckets)
        while smaller or larger:
            if smaller and (not larger or smaller[-1][0] <= larger[-1][0]):
                yield from l_tape.blocks(*smaller.pop()[1:])
            else:
                carried = None
                _, start, stop = larger.pop()
                for items in s_tape.blocks(start, stop, backwards=True):
                    position, prefix = _unpacked(items[::-1])
                    shifted = np.append(_UNKNOWN if carried is None else carried, prefix[:-1])
                    carried = int(prefix[-1])
                    yield _packed(position, shifted)

    held, n, previous = [], 0, None

    def flushed(previous):
        position, prefix = _unpacked(np.concatenate(held))
        ask = np.flatnonzero(prefix == _UNKNOWN)
        before = np.append(position[0] if previous is None else previous, position[:-1])
        prefix[ask] = level.common(before[ask], position[ask])
        if previous is None:
            prefix[0] = 0
        return position, prefix

    for items in each():
        held.append(items)
        n += len(items)
        if n > level.limit:
            block = flushed(previous)
            yield block
            held, n, previous = [], 0, block[0][-1]
    if held:
        yield flushed(previous)


def sorted_suffixes(text: np.ndarray, folder: str, *, depth: int = DEPTH, limit: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (positions, common prefixes with the suffix before) of a text of bytes that ends with ``END`` and ``PADDING`` zeros.

    ``folder`` holds what exceeds ``limit`` items; the caller removes it.
    """
    if depth >= _UNKNOWN:
        raise ValueError(f"depth must be below {_UNKNOWN}")
    n = len(text) - PADDING
    if n < 1 or text[n - 1] != END:
        raise ValueError("the text must end with END and PADDING zeros")
    yield from _sorted_level(_Level(text, n, None, text, depth, folder, max(limit, 1)))
