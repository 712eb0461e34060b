"""External induced sorting of suffixes with common-prefix values.

Suffixes that begin a rising stretch (S*, "leftmost S") are sorted first: one induction orders the stretches between them,
equal stretches get equal names, and the string of names is sorted in the same way, level by level, until it fits into
memory.  All other suffixes are then induced: reading sorted suffixes in order, each one puts its predecessor into the
priority queue of predecessors' first characters.  Tuples carry the suffix position and the length it shares with the entry
before it of its character: one more than the least common prefix between the suffixes that induced the two.

Entries of one character arrive in sorted order, so over a small alphabet the priority queue is a first-in first-out queue
for each character; over the names of a reduced string, characters are dealt into ranges of bounded weight, and only the
range that is being read is in memory.  Queues beyond the memory budget go to disk in runs; texts, names and marks beyond it
are files that are mapped.  Whatever the shard, a sorter holds its budget and a few batches.
"""

from __future__ import annotations

import heapq
import os
import shutil
import tempfile
from bisect import bisect_right
from collections import defaultdict, deque

import numpy as np

#: Entries that are read from a queue at once, and places that are classified at once.
BATCH = 1 << 18
#: Alphabets up to this size have a queue for each character.
NARROW = 1 << 10


class Store:
    """A scratch folder and the memory that arrays and queues share; what doesn't fit goes to the folder."""

    def __init__(self, budget: int, folder: str | None = None):
        self.budget, self.used, self.written, self.spilled = budget, 0, 0, 0
        self.folder = tempfile.mkdtemp(prefix="suffixes-", dir=folder)

    def path(self) -> str:
        self.written += 1
        return f"{self.folder}/{self.written}"

    def fits(self, size: int) -> bool:
        if self.used + size > self.budget:
            self.spilled += size
            return False
        self.used += size
        return True

    def array(self, n: int, kind) -> np.ndarray:
        """Zeros, in memory or in a mapped file."""
        size = n * np.dtype(kind).itemsize
        return np.zeros(n, kind) if not n or self.fits(size) else np.memmap(self.path(), kind, "w+", shape=(n,))

    def read(self, path: str, kind) -> np.ndarray:
        """A file's values, in memory or mapped."""
        size = os.path.getsize(path)
        return np.fromfile(path, kind) if not size or self.fits(size) else np.memmap(path, kind, "r")

    def free(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if isinstance(a, np.memmap):
                os.remove(a.filename)
            else:
                self.used -= a.nbytes

    def close(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Queue:
    """First-in first-out runs of equally long arrays, in memory up to the store's budget and on disk beyond it."""

    def __init__(self, store: Store):
        self.store = store
        self.runs: deque = deque()

    def push(self, *arrays: np.ndarray) -> None:
        if not len(arrays[0]):
            return
        if self.store.fits(sum(a.nbytes for a in arrays)):
            self.runs.append(arrays)
        else:
            path = self.store.path()
            with open(path, "wb") as f:
                for a in arrays:
                    f.write(a.tobytes())
            self.runs.append((path, [(a.dtype, len(a)) for a in arrays]))

    def _load(self, run):
        if isinstance(run[0], str):
            with open(run[0], "rb") as f:
                arrays = tuple(np.frombuffer(f.read(kind.itemsize * n), kind) for kind, n in run[1])
            os.remove(run[0])
            return arrays
        self.store.used -= sum(a.nbytes for a in run)
        return run

    def _some(self, newest: bool):
        """Runs from one end, joined up to BATCH entries; None when there is none."""
        taken, size = [], 0
        while self.runs and (not taken or size < BATCH):
            run = self._load(self.runs.pop() if newest else self.runs.popleft())
            taken.append(run)
            size += len(run[0])
        if len(taken) < 2:
            return taken[0] if taken else None
        if newest:
            taken.reverse()
        return tuple(np.concatenate(column) for column in zip(*taken, strict=True))

    def pop(self):
        """The oldest entries, or None."""
        return self._some(False)

    def pop_newest(self):
        """The newest entries in their order, or None."""
        return self._some(True)


class Ranges:
    """A priority queue of (character, position, common) over a large alphabet: one queue for each range of characters."""

    def __init__(self, store: Store, bounds: list[int]):
        self.bounds = bounds
        self.queues = [Queue(store) for _ in bounds]
        self.fresh: list[list[tuple]] = [[] for _ in bounds]

    def where(self, character: int) -> int:
        return bisect_right(self.bounds, character) - 1

    def push(self, character: int, position: int, common: int) -> None:
        fresh = self.fresh[r := self.where(character)]
        fresh.append((character, position, common))
        if len(fresh) >= 1 << 10:
            self._flush(r)

    def _flush(self, r: int) -> None:
        if self.fresh[r]:
            self.queues[r].push(*(np.array(column, np.int64) for column in zip(*self.fresh[r], strict=True)))
            self.fresh[r] = []

    def load(self, r: int) -> dict[int, list[tuple[int, int]]]:
        """The entries of a range by character, in the order in which they came."""
        self._flush(r)
        out = defaultdict(list)
        while (run := self.queues[r].pop()) is not None:
            for c, p, common in zip(*(x.tolist() for x in run), strict=True):
                out[c].append((p, common))
        return out


class Least:
    """Least common prefix since a moment, over a sequence of common prefixes; as many values as common prefixes can have."""

    def __init__(self):
        self.now = -1
        self.times: list[int] = []
        self.values: list[int] = []

    def add(self, common: int) -> None:
        self.now += 1
        while self.values and self.values[-1] >= common:
            self.values.pop()
            self.times.pop()
        self.values.append(common)
        self.times.append(self.now)

    def since(self, moment: int) -> int:
        return self.values[bisect_right(self.times, moment)]


def doubled(names: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of a string of names in memory, to ``depth`` characters at least, and the names each one shares
    with the one before it.  Ranks of prefixes of 1, 2, 4, ... names are kept, so shared prefixes are compared name by name."""
    m = len(names)
    ranks, width = [np.asarray(names, np.int32)], 1
    while int(ranks[-1].max()) + 1 < m and width < min(depth, m) and int((starts[width:] - starts[:-width]).min()) < depth:
        second = np.zeros(m, np.int64)
        second[:-width] = ranks[-1][width:].astype(np.int64) + 1
        key = ranks[-1] * np.int64(m + 1) + second
        place = np.argsort(key, kind="stable")
        differ = np.zeros(m, np.int32)
        differ[1:] = key[place[1:]] != key[place[:-1]]
        new = np.empty(m, np.int32)
        new[place] = np.cumsum(differ)
        ranks.append(new)
        width *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(m, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        rank = ranks[level]
        inside = (a < m) & (b < m)
        same = np.flatnonzero(inside)[rank[a[inside]] == rank[b[inside]]]
        shared[1:][same] += 1 << level
        a[same] += 1 << level
        b[same] += 1 << level
    return order, shared


class Sorter:
    """Suffixes of ``text`` to ``depth`` characters; its last character is 0 and stands nowhere else.

    Reduced strings of at most ``names`` names are sorted in memory (about 60 bytes each), longer ones as a text again.
    """

    def __init__(self, text: np.ndarray, depth: int, store: Store, names: int = 1 << 20):
        self.text, self.depth, self.n, self.store, self.names, self.level = text, depth, len(text), store, names, 0
        self.size = max(int(text[a : a + BATCH].max()) for a in range(0, self.n, BATCH)) + 1
        self._classify()

    def _classify(self) -> None:
        """Mark the suffixes that rise (are smaller than the next one) and list those that begin a rising stretch."""
        n, text = self.n, self.text
        self.rising = rising = self.store.array(n, np.uint8)
        rising[n - 1] = 1
        for b in range(n - 1, 0, -BATCH):
            a = max(0, b - BATCH)
            here, there = text[a:b], text[a + 1 : b + 1]
            change = np.where(here != there, np.arange(b - a), b - a)
            nearest = np.minimum.accumulate(change[::-1])[::-1]
            rising[a:b] = np.append(here < there, rising[b] == 1)[nearest]
        blocks = [(a, min(n - 1, a + BATCH)) for a in range(0, n - 1, BATCH)]
        total = sum(int(np.count_nonzero(rising[a + 1 : b + 1] > rising[a:b])) for a, b in blocks)
        self.stars, at = self.store.array(total, np.int64), 0
        for a, b in blocks:
            found = np.flatnonzero(rising[a + 1 : b + 1] > rising[a:b]) + a + 1
            self.stars[at : at + len(found)] = found
            at += len(found)

    def extend(self, a: np.ndarray, b: np.ndarray, start, limit) -> np.ndarray:
        """Common prefixes of suffixes a and b, known up to ``start``, read on to ``limit``."""
        out, limit = np.minimum(start, limit).astype(np.int64), np.broadcast_to(limit, len(a))
        for first in range(0, len(a), 1 << 14):
            live, step = np.arange(first, min(len(a), first + (1 << 14))), 8
            while len(live := live[out[live] < limit[live]]):
                at = out[live][:, None] + np.arange(step)
                x, y = (self.text[np.minimum(s[live][:, None] + at, self.n - 1)] for s in (a, b))
                differ = x != y
                met = differ.any(1)
                out[live] += np.where(met, differ.argmax(1), step)
                live = live[~met]
                step = min(64, 2 * step)
        return np.minimum(out, limit)

    def _pair(self, a: int, b: int) -> int:
        return int(self.extend(np.array([a]), np.array([b]), np.zeros(1, np.int64), self.depth)[0])

    def _induce(self, stars, carry: bool):
        """All suffixes from the largest to the smallest, as runs of (positions, common prefix with the one before).

        ``stars`` yields runs of S* suffixes, in order within their first characters, with the prefixes they share with the
        one before; without ``carry`` common prefixes aren't kept.
        """
        return self._narrow(stars, carry) if self.size <= NARROW else self._wide(stars, carry)

    def _narrow(self, stars, carry: bool):
        text, depth, size = self.text, self.depth, self.size
        zero = np.zeros(0, np.int16)
        least = np.full(size, -1, np.int64)  # least common prefix since the last push to each queue; -1: nothing pushed yet

        def deal(positions: np.ndarray, common: np.ndarray, target: list) -> None:
            chars = text[positions]
            order = np.argsort(chars, kind="stable")
            cuts = np.flatnonzero(np.diff(chars[order])) + 1
            for group in np.split(order, cuts) if len(order) else ():
                target[int(chars[group[0]])].push(positions[group], common[group] if carry else zero)

        def spread(positions: np.ndarray, common: np.ndarray, keep: np.ndarray, target: list) -> None:
            """Put the predecessors of positions[keep] into their queues."""
            kept = np.flatnonzero(keep)
            before = positions[kept] - 1
            chars = text[before]
            order = np.argsort(chars, kind="stable")
            cuts = np.flatnonzero(np.diff(chars[order])) + 1
            whole = int(common.min()) if carry and len(common) else 0
            touched = []
            for group in np.split(order, cuts) if len(order) else ():
                c = int(chars[group[0]])
                touched.append(c)
                shared = zero
                if carry:
                    at = kept[group]
                    edges = np.concatenate([[0], at + 1])
                    mins = np.minimum.reduceat(common, edges[edges < len(common)]).astype(np.int64)
                    values = mins[: len(at)].copy()
                    values[0] = -1 if least[c] < 0 else min(int(least[c]), int(values[0]))
                    shared = np.minimum(values + 1, depth).astype(np.int16)
                    least[c] = int(mins[len(at)]) if len(mins) > len(at) else depth
                target[c].push(before[group], shared)
            if carry and len(common):
                rest = np.ones(size, bool)
                rest[touched] = False
                least[rest] = np.where(least[rest] < 0, -1, np.minimum(least[rest], whole))

        def first_is(value: int, shared: np.ndarray) -> np.ndarray:
            shared = shared.copy()
            shared[0] = value
            return shared

        waiting, queues, falling = ([Queue(self.store) for _ in range(size)] for _ in range(3))
        for positions, common in stars:
            deal(positions, common, waiting)
        for c in range(size):
            last = None
            while (run := queues[c].pop()) is not None:
                positions, shared = run if not carry or last is not None else (run[0], first_is(0, run[1]))
                last = int(positions[-1])
                falling[c].push(positions, shared)
                keep = positions > 0
                keep[keep] = text[positions[keep] - 1] >= c
                spread(positions, shared, keep, queues)
            begun = False
            while (run := waiting[c].pop()) is not None:
                positions, shared = run
                if carry and not begun:
                    shared = first_is(0 if last is None else self._pair(last, int(positions[0])), shared)
                begun = True
                spread(positions, shared, positions > 0, queues)

        least[:] = -1
        for c in range(size - 1, 0, -1):
            last = None
            while (run := queues[c].pop()) is not None:
                positions, shared = run if not carry or last is not None else (run[0], first_is(0, run[1]))
                last = int(positions[-1])
                yield positions, shared
                keep = positions > 0
                keep[keep] = text[positions[keep] - 1] <= c
                spread(positions, shared, keep, queues)
            after = None  # common prefix of a run's last suffix with the next larger one
            while (run := falling[c].pop_newest()) is not None:
                positions, shared = run[0][::-1], zero
                if carry:
                    if after is None:
                        after = 0 if last is None else self._pair(last, int(positions[0]))
                    shared = np.concatenate([[after], run[1][:0:-1]]).astype(np.int16)
                    after = int(run[1][0])
                yield positions, shared
                keep = positions > 0
                keep[keep] = text[positions[keep] - 1] < c
                spread(positions, shared, keep, queues)
        # The end mark is the only suffix of the lowest character.
        yield np.array([self.n - 1]), np.zeros(1, np.int16)

    def _wide(self, stars, carry: bool):
        """The same over a large alphabet, entry by entry, with the characters' queues in ranges."""
        text, depth, store = self.text, self.depth, self.store
        weight = store.array(self.size, np.int64)
        for a in range(0, self.n, BATCH):
            found, times = np.unique(text[a : a + BATCH], return_counts=True)
            weight[found] += times
        bounds, load = [0], 0
        for a in range(0, self.size, BATCH):
            for c, w in enumerate(weight[a : a + BATCH].tolist(), a):
                if load and load + w > BATCH:
                    bounds.append(c)
                    load = 0
                load += w
        store.free(weight)
        pushed = store.array(self.size, np.int64)  # moment of the last push for each character, from 1
        waiting, queues, falling = Ranges(store, bounds), Ranges(store, bounds), Ranges(store, bounds)
        for positions, common in stars:
            for p, x in zip(positions.tolist(), common.tolist() if carry else [0] * len(positions), strict=True):
                waiting.push(int(text[p]), p, x)
        least = Least()

        def send(p: int, target: Ranges, r: int, near: dict, ready: dict, heap: list, sign: int) -> None:
            """Put the predecessor of p, the suffix read last, into its queue; within the range that is read, into memory."""
            d = int(text[p - 1])
            moment = int(pushed[d]) - 1
            common = min(depth, least.since(moment) + 1) if carry and moment >= 0 else 0
            pushed[d] = least.now + 1
            if target.where(d) == r:
                if d not in near:
                    near[d] = []
                    if d not in ready:  # else it waits in the heap already
                        heapq.heappush(heap, sign * d)
                near[d].append((p - 1, common))
            else:
                target.push(d, p - 1, common)

        for r in range(len(bounds)):
            near, ready = queues.load(r), waiting.load(r)
            heap = list(set(near) | set(ready))
            heapq.heapify(heap)
            while heap:
                c = heapq.heappop(heap)
                mine, last, k = near.setdefault(c, []), None, 0
                while k < len(mine):  # a suffix may put its predecessor behind itself
                    p, x = mine[k]
                    x = x if last is not None else 0
                    k, last = k + 1, p
                    least.add(x)
                    falling.push(c, p, x)
                    if p and text[p - 1] >= c:
                        send(p, queues, r, near, ready, heap, 1)
                for k, (p, x) in enumerate(ready.get(c, ())):
                    least.add(x if k or not carry else 0 if last is None else self._pair(last, p))
                    if p:
                        send(p, queues, r, near, ready, heap, 1)
                del near[c]
        pushed[:] = 0
        least = Least()
        out: list[tuple[int, int]] = []
        for r in range(len(bounds) - 1, -1, -1):
            near, ready = queues.load(r), falling.load(r)
            heap = [-c for c in set(near) | set(ready)]
            heapq.heapify(heap)
            while heap:
                c = -heapq.heappop(heap)
                if not c:
                    continue
                mine, last, k = near.setdefault(c, []), None, 0
                while k < len(mine):
                    p, x = mine[k]
                    x = x if last is not None else 0
                    k, last = k + 1, p
                    least.add(x)
                    out.append((p, x))
                    if p and text[p - 1] <= c:
                        send(p, queues, r, near, ready, heap, -1)
                larger = None
                for p, x in reversed(ready.get(c, ())):
                    head = larger if larger is not None else 0 if last is None or not carry else self._pair(last, p)
                    larger = x
                    least.add(head)
                    out.append((p, head))
                    if p and text[p - 1] < c:
                        send(p, queues, r, near, ready, heap, -1)
                del near[c]
                if len(out) >= BATCH:
                    yield tuple(np.array(column, kind) for column, kind in zip(zip(*out, strict=True), (np.int64, np.int16), strict=True))
                    out = []
        out.append((self.n - 1, 0))
        store.free(pushed)
        yield tuple(np.array(column, kind) for column, kind in zip(zip(*out, strict=True), (np.int64, np.int16), strict=True))

    def _named(self) -> tuple[np.ndarray, int]:
        """A name for each stretch from an S* suffix to the next, in the order of the text, and the number of names."""
        stars, rising, m = self.stars, self.rising, len(self.stars)
        names = self.store.array(m, np.int32)
        count, last = 0, None
        plain = ((np.array(stars[a : a + BATCH]), np.zeros(0, np.int16)) for a in range(0, m, BATCH))
        for positions, _ in self._induce(plain, False):
            inner = positions[positions > 0]
            found = inner[(rising[inner] == 1) & (rising[inner - 1] == 0)]
            if not len(found):
                continue
            index = np.searchsorted(stars, found)
            length = stars[np.minimum(index + 1, m - 1)] - found + 1
            before, sizes = (np.concatenate([[found[0] if last is None else last[0]], found[:-1]]), np.concatenate([[0 if last is None else last[1]], length[:-1]]))
            new = sizes != length
            same = np.flatnonzero(~new)
            new[same] = self.extend(before[same], found[same], np.zeros(len(same), np.int64), length[same]) < length[same]
            numbers = count + np.cumsum(new)
            names[index] = numbers
            count, last = int(numbers[-1]), (found[-1], length[-1])
        for a in range(0, m, BATCH):
            names[a : a + BATCH] = count - names[a : a + BATCH]
        return names, count

    def _sorted_stars(self):
        """Runs of S* suffixes in order, with the characters that each one shares with the one before it."""
        stars, m = self.stars, len(self.stars)
        names, count = self._named()
        if m <= self.names:
            starts = np.asarray(stars)
            order, shared = doubled(names, starts, self.depth)
        else:
            inner = Sorter(names, self.depth, self.store, self.names)
            inner.level = self.level + 1
            order, shared, at = self.store.array(m, np.int64), self.store.array(m, np.int16), m
            for positions, common in inner.runs():
                a, at = at - len(positions), at - len(positions)
                order[a : a + len(positions)] = positions[::-1]
                # What an entry shares with the one before it in this run is what that one, the larger, shares with it.
                shared[a + 1 : a + 1 + len(positions)] = common[::-1][: m - a - 1]
            inner.free()
        self.store.free(names)
        for a in range(0, m, BATCH):
            lower = np.array(order[max(0, a - 1) : a + BATCH])
            k = np.array(shared[a : a + BATCH], np.int64)
            if not a:
                lower, k = np.concatenate([lower[:1], lower]), np.concatenate([k[:1] * 0, k[1:]])
            left, right = lower[:-1], lower[1:]
            start = stars[np.minimum(left + k, m - 1)] - stars[left]
            common = self.extend(stars[left], stars[right], start, self.depth)
            if not a:
                common[0] = 0
            yield np.array(stars[right]), common.astype(np.int16)
        if m > self.names:
            self.store.free(order, shared)

    def runs(self):
        """Runs of (positions, common prefix with the next larger suffix), from the largest suffix to the smallest."""
        yield from self._induce(self._sorted_stars(), True)

    def free(self) -> None:
        self.store.free(self.rising, self.stars)


def repeated(text: np.ndarray, depth: int, store: Store, names: int = 1 << 20) -> np.ndarray:
    """Which positions of ``text`` share at least ``depth`` characters with another one."""
    out = store.array(len(text), np.uint8)
    sorter = Sorter(text, depth, store, names)
    last = None
    for positions, common in sorter.runs():
        near = common >= depth
        out[positions[near]] = 1
        before = np.concatenate([[last if last is not None else positions[0]], positions[:-1]])
        out[before[near]] = 1
        last = positions[-1]
    sorter.free()
    return out
