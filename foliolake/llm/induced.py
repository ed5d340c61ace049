"""Suffix order and common prefixes of a shard by external induced sorting.

The suffixes that begin a rise of the text (its left-most S suffixes) are sorted
first, through the names of the stretches between them; the reduced string of
names, at most half as long, is ordered by doubling, for which a few rounds
suffice because only ``depth`` bytes matter. Two scans induce the rest: one
upwards gives the L suffixes, one downwards the S suffixes. A scan takes tuples
(place, common prefix with the tuple before it) from a queue, and each tuple
sends the suffix one byte before it to the queue, with the common prefix that
follows from the least one since the last tuple sent to the same byte.

Keys only grow in a scan, so the priority queue is 256 buckets, each first in,
first out. Buckets beyond ``memory`` bytes are appended to files, and the text may
be a file that is mapped, so a shard may be far larger than memory. Tuples are
handled by array operations on blocks.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

RECORD = np.dtype([("place", "<i8"), ("common", "u1")])
BLOCK = 1 << 16


class BucketQueue:
    """Records by the byte that they begin with; each bucket is first in, first out, in memory and beyond it on disk."""

    def __init__(self, memory: int, folder: str):
        self.memory, self.folder, self.used = memory, folder, 0
        self.waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
        self.on_disk = np.zeros(256, np.int64)
        self.read = np.zeros(256, np.int64)
        self.name = f"{folder}/{id(self):x}-"

    def push(self, key: np.ndarray, place: np.ndarray, common: np.ndarray) -> None:
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        rows = np.empty(len(key), RECORD)
        rows["place"], rows["common"] = place[order], common[order]
        sizes = np.bincount(key, minlength=256)
        ends = np.cumsum(sizes)
        for k in np.flatnonzero(sizes).tolist():
            self.waiting[k].append(rows[ends[k] - sizes[k] : ends[k]])
        self.used += rows.nbytes
        if self.used > self.memory:
            self._flush()

    def _flush(self) -> None:
        for k, rows in enumerate(self.waiting):
            if rows:
                with open(f"{self.name}{k}", "ab") as f:
                    for r in rows:
                        f.write(r.tobytes())
                        self.on_disk[k] += len(r)
                self.waiting[k] = []
        self.used = 0

    def pop(self, key: int) -> Iterator[np.ndarray]:
        """Blocks of a bucket in order, until none is left, those that are pushed meanwhile included."""
        while True:
            if self.read[key] < self.on_disk[key]:
                first, self.read[key] = self.read[key], min(self.on_disk[key], self.read[key] + BLOCK)
                yield self._from(key, first, self.read[key])
            elif self.waiting[key]:
                rows, self.waiting[key] = np.concatenate(self.waiting[key]), []
                self.used -= rows.nbytes
                for at in range(0, len(rows), BLOCK):
                    yield rows[at : at + BLOCK]
            else:
                return

    def _from(self, key: int, first: int, stop: int) -> np.ndarray:
        return np.fromfile(f"{self.name}{key}", RECORD, int(stop - first), offset=int(first) * RECORD.itemsize)

    def backwards(self, key: int) -> Iterator[np.ndarray]:
        """Blocks of a bucket that nothing was popped from, last first, each in reverse."""
        for rows in reversed(self.waiting[key]):
            for stop in range(len(rows), 0, -BLOCK):
                yield rows[max(stop - BLOCK, 0) : stop][::-1]
        for stop in range(int(self.on_disk[key]), 0, -BLOCK):
            yield self._from(key, max(stop - BLOCK, 0), stop)[::-1]

    def forwards(self, key: int) -> Iterator[np.ndarray]:
        """The same blocks in order."""
        for first in range(0, int(self.on_disk[key]), BLOCK):
            yield self._from(key, first, min(self.on_disk[key], first + BLOCK))
        yield from self.waiting[key]


def types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type S: smaller than the one after it (the end of the text is the smallest)."""
    n = len(text)
    out = np.zeros(n, bool)
    following = False
    for stop in range(n, 0, -(1 << 20)):
        start = max(stop - (1 << 20), 0)
        here = text[start:stop].astype(np.int16)
        after = np.append(here[1:], text[stop] if stop < n else -1)
        # 1: S, 0: L, else as the suffix after it
        kind = np.where(here < after, 1, np.where(here > after, 0, -1))
        known = np.where(kind >= 0, np.arange(len(kind)), len(kind))
        known = np.minimum.accumulate(known[::-1])[::-1]
        out[start:stop] = np.where(known < len(kind), kind[np.minimum(known, len(kind) - 1)] == 1, following)
        following = bool(out[start])
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` share, ``most`` at the most."""
    n = len(text)
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    for k in range(most):
        x, y = a[live] + k, b[live] + k
        inside = (x < n) & (y < n)
        live, x, y = live[inside], x[inside], y[inside]
        live = live[text[x] == text[y]]
        if not len(live):
            break
        out[live] += 1
    return out


def _names(text: np.ndarray, rises: np.ndarray, depth: int) -> np.ndarray:
    """The ranks of the stretches from each rise to the next, at most ``depth`` bytes of each, equal for equal ones.

    Where one stretch ends with a byte and another goes on, the former is the larger (a rise against a fall);
    only the end of the text is below all bytes.
    """
    n = len(text)
    size = np.minimum(np.append(np.diff(rises) + 1, n - rises[-1]), depth)
    beyond = np.full(len(rises), 257, np.int64)
    beyond[-1] = 0
    rank = np.zeros(len(rises), np.int64)
    live = np.arange(len(rises))
    # by seven bytes at a time; stretches that are alone leave
    for at in range(0, depth, 7):
        word = np.zeros(len(live), np.int64)
        for k in range(at, at + 7):
            value = text[np.minimum(rises[live] + k, n - 1)].astype(np.int64) + 1
            word = word * 258 + (np.where(k < size[live], value, beyond[live]) if k < depth else 0)
        rank[live], live = _refined(rank[live], word, live)
        live = live[size[live] >= at + 7]  # a stretch that ends with this word shows its end in the next
        if not len(live):
            break
    return rank


def sorted_rises(text: np.ndarray, rises: np.ndarray, depth: int) -> np.ndarray:
    """The rises in the order of the first ``depth`` bytes of their suffixes."""
    m = len(rises)
    if not m:
        return rises
    rank, step = _names(text, rises, depth), 1
    live = _tied(rank, np.arange(m))
    # every stretch has a byte or more that the next one has not
    while step < depth and len(live):
        follow = np.zeros(len(live), np.int64)
        inside = np.flatnonzero(live + step < m)
        follow[inside] = rank[live[inside] + step] + 1
        rank[live], live = _refined(rank[live], follow, live)
        step *= 2
    return rises[np.argsort(rank)]


def _tied(rank: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Those of ``live`` that share their rank with another."""
    return live[np.bincount(rank, minlength=len(rank))[rank] > 1]


def _refined(rank: np.ndarray, word: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of ``live`` by rank and word, and those that are tied still. A rank is the place of the first of its group, so ranks of others stay."""
    top = int(word.max(initial=0)) + 1
    if top < (1 << 62) // max(int(rank.max(initial=0)) + 1, 1):
        key = rank * top + word
        order = np.argsort(key)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
    else:
        order = np.lexsort((word, rank))
        r, w = rank[order], word[order]
        new = np.append(True, (r[1:] != r[:-1]) | (w[1:] != w[:-1]))
    r = rank[order]
    places = np.arange(len(r))
    within = places - np.maximum.accumulate(np.where(np.append(True, r[1:] != r[:-1]), places, 0))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(r)))
    out = np.empty(len(r), np.int64)
    out[order] = r + np.repeat(within[first], size)
    return out, live[order][np.repeat(size > 1, size)]


class _Least:
    """Least values of ranges of a block."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << len(self.rows) - 1 <= len(values):
            last, w = self.rows[-1], 1 << len(self.rows) - 1
            self.rows.append(np.minimum(last[:-w], last[w:]))

    def between(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Of [first, stop), none of them empty."""
        k = np.frexp((stop - first).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.uint8)
        for level in np.unique(k).tolist():
            at = np.flatnonzero(k == level)
            row = self.rows[level]
            out[at] = np.minimum(row[first[at]], row[stop[at] - (1 << level)])
        return out


class _Sender:
    """Sends the suffix before each scanned one to the queue, with the common prefix to the last one sent to its byte."""

    def __init__(self, queue: BucketQueue, depth: int):
        self.queue, self.depth = queue, depth
        self.any = np.zeros(256, bool)  # whether the byte has a tuple
        self.begin()

    def begin(self) -> None:
        """A new bucket is scanned: tuples sent from others share one byte with what comes."""
        self.since = np.full(256, 255, np.int64)
        self.sent = np.zeros(256, bool)

    def scan(self, common: np.ndarray, at: np.ndarray, key: np.ndarray, place: np.ndarray) -> None:
        """``common`` of a block of scanned tuples; those at ``at`` send ``place`` to ``key``."""
        if not len(at):
            if len(common):
                self.since = np.minimum(self.since, int(common.min()))
            return
        least = _Least(common)
        order = np.argsort(key, kind="stable")
        k, a = key[order], at[order]
        head = np.append(True, k[1:] != k[:-1])
        first = np.where(head, 0, np.append(0, a[:-1] + 1))
        low = least.between(first, a + 1).astype(np.int64)
        low = np.where(head, np.minimum(low, self.since[k]), low)
        shared = np.where(head & ~self.sent[k], 0, low) + 1
        shared = np.where(head & ~self.any[k], 0, np.minimum(shared, self.depth))
        self.since = np.minimum(self.since, int(common.min()))
        last = np.append(head[1:], True)
        ends, names = a[last], k[last]
        tail = np.full(len(names), 255, np.int64)
        rest = np.flatnonzero(ends + 1 < len(common))
        tail[rest] = least.between(ends[rest] + 1, np.full(len(rest), len(common)))
        self.since[names] = tail
        self.sent[names] = self.any[names] = True
        out = np.empty(len(at), np.uint8)
        out[order] = shared
        self.queue.push(key, place, out)


def suffixes(text: np.ndarray, depth: int, memory: int = 256 << 20, folder: str | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, common prefix with the suffix before, at most ``depth``) of all suffixes in the order of their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return
    # a task's overflow goes where Spark's own does, and is gone when the task ends
    own = tempfile.mkdtemp(prefix="induced-", dir=folder or os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
    try:
        rising = types(text)
        rises = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
        rises = sorted_rises(text, rises, depth)
        heads = text[rises]
        shared = np.zeros(len(rises), np.uint8)
        if len(rises) > 1:
            shared[1:] = common_prefix(text, rises[:-1], rises[1:], depth)
        bounds = np.searchsorted(heads, np.arange(257))
        up, falling = BucketQueue(memory // 3, own), BucketQueue(memory // 3, own)
        sender = _Sender(up, depth)
        sender.scan(np.zeros(1, np.uint8), np.zeros(1, np.int64), text[n - 1 :], np.array([n - 1]))  # the end sends the last suffix
        for c in range(256):
            sender.begin()
            last = -1
            for rows in up.pop(c):
                place, common = rows["place"].astype(np.int64), np.ascontiguousarray(rows["common"])
                falling.push(np.full(len(place), c, np.uint8), place, common)
                before = text[np.maximum(place - 1, 0)]
                at = np.flatnonzero((place > 0) & (before >= c))
                sender.scan(common, at, before[at], place[at] - 1)
                last = int(place[-1])
            for first in range(bounds[c], bounds[c + 1], BLOCK):
                stop = min(first + BLOCK, bounds[c + 1])
                place, common = rises[first:stop], shared[first:stop].copy()
                if first == bounds[c]:
                    common[0] = common_prefix(text, place[:1], np.array([last]), depth)[0] if last >= 0 else 0
                before = text[place - 1]
                sender.scan(common, np.arange(len(place)), before, place - 1)
        down, lowest = BucketQueue(memory // 3, own), {}
        kept = BucketQueue(memory // 3, own)
        sender = _Sender(down, depth)
        for c in range(255, -1, -1):
            sender.begin()
            last = -1
            for rows in down.pop(c):
                place, common = rows["place"].astype(np.int64), np.ascontiguousarray(rows["common"])
                kept.push(np.full(len(place), c, np.uint8), place, common)
                before = text[np.maximum(place - 1, 0)]
                at = np.flatnonzero((place > 0) & (before <= c))
                sender.scan(common, at, before[at], place[at] - 1)
                last = int(place[-1])
            carry = None  # the common prefix of a block's last tuple with the one below it
            for rows in falling.backwards(c):
                place, stored = rows["place"].astype(np.int64), rows["common"]
                common = np.empty(len(place), np.uint8)
                common[1:] = stored[:-1]
                if carry is None:
                    lowest[c] = common[0] = common_prefix(text, place[:1], np.array([last]), depth)[0] if last >= 0 else 0
                else:
                    common[0] = carry
                carry = stored[-1]
                before = text[np.maximum(place - 1, 0)]
                at = np.flatnonzero((place > 0) & (before < c))
                sender.scan(common, at, before[at], place[at] - 1)
        for c in range(256):
            for rows in falling.forwards(c):
                yield rows["place"].astype(np.int64), np.ascontiguousarray(rows["common"])
            carry = lowest.get(c, 0)
            for rows in kept.backwards(c):
                common = np.empty(len(rows), np.uint8)
                common[0], common[1:] = carry, rows["common"][:-1]
                carry = rows["common"][-1]
                yield rows["place"].astype(np.int64), common
    finally:
        shutil.rmtree(own, ignore_errors=True)


def groups(blocks: Iterator[tuple[np.ndarray, np.ndarray]], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, where each group begins) of whole groups of suffixes that have ``depth`` bytes in common, those of one suffix included."""
    held: list[np.ndarray] = []
    for place, common in blocks:
        new = np.flatnonzero(common < depth)
        if not len(new):
            held.append(place)
            continue
        held.append(place[: new[-1]])
        whole = np.concatenate(held)
        before = len(whole) - int(new[-1])  # places of earlier blocks, which begin with a group
        starts = new[:-1] + before
        if before or new[0] > 0:
            starts = np.append(0, starts)
        if len(whole):
            yield whole, np.unique(starts)
        held = [place[new[-1] :]]
    if sum(map(len, held)):
        yield np.concatenate(held), np.zeros(1, np.int64)
