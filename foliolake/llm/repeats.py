"""Removal of byte strings that repeat from documents with smaller identifiers.

Suffixes are sorted by external induced sorting (:mod:`.induced`) in shards that
need no merging, since equal strings of ``LENGTH`` bytes always meet in one:

1. Every window of ``LENGTH`` bytes contains the smallest of its ``GRAM``-byte
   strings in a hashed order; equal windows choose the same one. Consecutive
   windows with one choice form a segment, and a segment is one tuple: a hash
   of the chosen string, a hash of the whole segment, and the identifiers.
2. Tuples are sorted by both hashes. A segment that occurs whole in a smaller
   document is repeated in all its windows. One whose chosen string occurs in
   smaller documents with other surroundings is undecided; of such groups each
   distinct segment sends its bytes once, to the shard of its chosen string.
3. In each shard, segments without a window whose hash another document's segment has
   too share nothing and leave. Of the others, induced sorting carries suffix tuples and their
   common prefixes through queues, beyond ``MEMORY`` bytes on disk. Suffixes with ``LENGTH`` bytes
   in common are neighbours there, and the smallest identifier of such a run keeps them.

Tuples are packed and travel through external sorts and shuffles on disk;
before they do, equal tuples of one document group become one, so a string that
a third of all documents share costs a tuple per group of documents and not
per document. A bucket and a document group stand for ``BUCKET_BYTES`` bytes of input, or for
a partition if that has less; a partition has a few of both, which a task works off one after the
other. Rows that travel are one for each pair of a group and a bucket, or a few, so they have
kilobytes each and not a few tuples. A chosen string with very many different segments is found in a
sample of the documents: its tuples are spread by the hash of the segment and
its windows by the hash of the window, so no bucket holds them all.

Equality of whole segments, and of windows of hot strings, is by 64-bit hashes. Defined cases: null and empty texts
have no bytes; texts below ``LENGTH`` bytes keep everything; very long texts are
worked on in stretches of ``BLOCK`` bytes that overlap by a window; rows with a null
identifier neither lose bytes nor count as a source; rows with one identifier
never lose bytes to each other. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .induced import groups, suffixes
from .scratch import Scratch, arrow_bytes, partitions_for, trimmed
from .words import mix

NAME = "op4_repeated_bytes"
LENGTH, GRAM = 50, 20
#: Bytes in a stretch of text, tuples and bytes of undecided segments held before they are packed.
BLOCK, HOLD, HELD = 1 << 20, 500_000, 4 << 20
#: Bytes of input in a partition and in a bucket or group at most; one document of SAMPLE is looked at for strings with more than HOT segments.
PART_BYTES, BUCKET_BYTES, SAMPLE, HOT = 48 << 20, 6 << 20, 64, 200_000
#: Bytes of queued suffix tuples of a shard in memory; the rest waits on disk.
MEMORY = 64 << 20
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUE = np.random.default_rng(23).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
_POSITION = np.int64((1 << 31) - 1)
_NONE = np.iinfo(np.int64).max


class _Powers:
    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            self.table = np.concatenate([self.table, self.table * np.uint64(pow(self.base, len(self.table), 1 << 64))])
        return self.table[:n]


_up, _down = _Powers(_BASE), _Powers(_INVERSE)


class Bytes:
    """Prefix hashes of joined texts: the hash of any stretch by one subtraction and one product."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.data)
        self.bounds = np.cumsum([0, *map(len, texts)])
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[self.data] * _up.upto(n), out=self.prefix[1:])

    def hash(self, start, stop) -> np.ndarray:
        return mix((self.prefix[stop] - self.prefix[start]) * _down.upto(len(self.prefix))[start])

    def windows(self, length: int) -> np.ndarray:
        """Starts of all windows that lie in one text."""
        sizes = np.diff(self.bounds)
        fit = np.maximum(sizes - length + 1, 0)
        return np.repeat(self.bounds[:-1], fit) + np.arange(fit.sum()) - np.repeat(np.cumsum(fit) - fit, fit)

    def segments(self, length: int = LENGTH, gram: int = GRAM):
        """(text, first window, last window, hash of the chosen string, hash of the segment) of all segments."""
        n = len(self.data)
        if n < length:
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        m = n - gram + 1
        h = (self.prefix[gram:] - self.prefix[:m]) * _down.upto(n + 1)[:m]
        key = (mix(h) >> np.uint64(32)).astype(np.int64) << 31 | np.arange(m)
        width, have = length - gram + 1, 1
        while have * 2 <= width:  # smallest of 1, 2, 4, ... neighbours
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
        start = self.windows(length)
        chosen = key[start] & _POSITION
        new = np.ones(len(start), bool)
        new[1:] = (chosen[1:] != chosen[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        if not len(first):
            return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
        lo, hi = start[first], start[np.append(first[1:], len(start)) - 1]
        at = chosen[first]
        # the place of the chosen string belongs to the segment's identity
        whole = mix(self.hash(lo, hi + length) + (at - lo).astype(np.uint64))
        return np.searchsorted(self.bounds, lo, "right") - 1, lo, hi, self.hash(at, at + gram), whole


def _stretches(texts: list[bytes], block: int = BLOCK):
    """(rows, offsets, bytes) of stretches of the texts whose windows are all windows of the texts, about ``block`` bytes at a time."""
    rows, base, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, len(t) - LENGTH + 1, block):
            if size + min(len(t) - a, block) > block and held:
                yield np.array(rows), np.array(base), held
                rows, base, held, size = [], [], [], 0
            rows.append(i)
            base.append(a)
            held.append(t[a : a + block + LENGTH - 1])
            size += len(held[-1])
    if held:
        yield np.array(rows), np.array(base), held


def _bucket(chosen: np.ndarray, whole: np.ndarray, buckets: int, hot: np.ndarray) -> np.ndarray:
    """The bucket of the chosen string; for a hot one, a bucket beyond these by the other hash."""
    out = (chosen % np.uint64(buckets)).astype(np.int64)
    if len(hot):
        where = np.minimum(np.searchsorted(hot, chosen), len(hot) - 1)
        split = hot[where] == chosen
        out[split] = buckets + (whole[split] % np.uint64(buckets)).astype(np.int64)
    return out


def _pack(*columns: np.ndarray) -> bytes:
    return b"".join(c.tobytes() for c in columns)


def _unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    size = sum(np.dtype(k).itemsize for k in kinds)
    n, at, out = len(blob) // size, 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * np.dtype(k).itemsize
    return out


_TUPLE = ("<u4", "<u8", "<i8", "<i8")  # chosen string, segment, smallest and largest identifier
_REPLY = ("<u8", "<i8", "<u1")  # segment, smallest identifier, whether its bytes are needed


def _emit(names: list[str], kinds, rows: list[tuple]):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(names), kinds)], names=names)


def _tuples(buckets: int, hot, block: int, hold: int = HOLD):
    """Documents to packed tuples (bucket, g, blob); equal tuples of a document group are merged while they are held."""

    def flush(held):
        g, chosen, whole, lo, hi = map(np.concatenate, zip(*held))
        order = np.lexsort((whole, g))
        g, chosen, whole, lo, hi = (c[order] for c in (g, chosen, whole, lo, hi))
        first = np.flatnonzero(np.append(True, (whole[1:] != whole[:-1]) | (g[1:] != g[:-1])))
        lo, hi = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
        g, chosen, whole = g[first], chosen[first], whole[first]
        bucket = _bucket(chosen, whole, buckets, hot.value)
        order = np.lexsort((lo, g, bucket))
        g, chosen, whole, lo, hi, bucket = (c[order] for c in (g, chosen, whole, lo, hi, bucket))
        cut = np.flatnonzero(np.append(True, (bucket[1:] != bucket[:-1]) | (g[1:] != g[:-1])))
        short = (chosen >> np.uint64(32)).astype("<u4")
        rows = [(int(bucket[a]), int(g[a]), _pack(short[a:b], whole[a:b], lo[a:b], hi[a:b])) for a, b in zip(cut, np.append(cut[1:], len(g)))]
        return _emit(["bucket", "g", "blob"], (pa.int32(), pa.int32(), pa.binary()), rows)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            ids, groups = batch.column("id").to_numpy(), batch.column("g").to_numpy()
            for rows, _, some in _stretches(batch.column("t").to_pylist(), block):
                text, _, _, chosen, whole = Bytes(some).segments()
                ident = ids[rows[text]]
                held.append((groups[rows[text]], chosen, whole, ident, ident))
                count += len(text)
                if count >= hold:
                    yield flush(held)
                    held, count = [], 0
        if count:
            yield flush(held)

    return run


def _chosen(batches):
    """(chosen string, segment) of the distinct segments of each stretch."""
    for batch in batches:
        for _, _, some in _stretches(batch.column("t").to_pylist()):
            _, _, _, chosen, whole = Bytes(some).segments()
            _, first = np.unique(whole, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(chosen[first].view(np.int64)), pa.array(whole[first].view(np.int64))], names=["chosen", "whole"])


def hot_strings(docs: DataFrame, sample: int, hot: int, most: int = 1 << 20) -> np.ndarray:
    """Sorted hashes of the chosen strings that, by a sample of documents, have more than ``hot`` segments.

    The ``most`` with the most segments are taken, so 8 MB are broadcast at the most; the others stay in one bucket each.
    """
    some = docs.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(sample)) == 0).select("t")
    count = some.mapInArrow(trimmed(_chosen), "chosen long, whole long").distinct().groupBy("chosen").count()
    found = count.where(F.col("count") * sample > hot).orderBy(F.desc("count"), "chosen").limit(most)
    return np.sort(np.array([r.chosen for r in found.collect()], np.int64).view(np.uint64))


def _runs(batches, column: str):
    """Streams the rows of sorted batches by runs of ``column``, one list of row dictionaries each."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[column] != now and rows:
                yield now, rows
                rows = []
            now = row[column]
            rows.append(row)
    if rows:
        yield now, rows


def _settle(buckets: int):
    """Packed tuples of a bucket to replies for each document group; hot strings are always undecided."""

    def run(batches):
        for bucket, rows in _runs(batches, "bucket"):
            yield from _replies(rows, bucket >= buckets)

    return run


def _replies(rows: list[dict], hot: bool):
    blobs = [_unpack(r["blob"], *_TUPLE) for r in rows]
    g = np.repeat([r["g"] for r in rows], [len(b[0]) for b in blobs])
    chosen, whole, lo, hi = map(np.concatenate, zip(*blobs))
    order = np.lexsort((whole, chosen))
    g, chosen, whole, lo, hi = (c[order] for c in (g, chosen, whole, lo, hi))
    top = np.append(True, chosen[1:] != chosen[:-1])
    seg = top | np.append(True, whole[1:] != whole[:-1])
    group, segment = np.cumsum(top) - 1, np.cumsum(seg) - 1
    first = np.flatnonzero(top)
    least, most = np.minimum.reduceat(lo, first), np.maximum.reduceat(hi, first)
    distinct = np.add.reduceat(seg.astype(np.int64), first)
    mine = np.minimum.reduceat(lo, np.flatnonzero(seg))[segment]
    wanted = ((distinct > 1) & (least < most) | hot)[group]
    tell = np.flatnonzero((hi > mine) | wanted & (lo == mine))
    tell = tell[np.argsort(g[tell], kind="stable")]
    if len(tell):
        cut = np.flatnonzero(np.append(True, g[tell][1:] != g[tell][:-1]))
        out = []
        for a, b in zip(cut, np.append(cut[1:], len(tell))):
            at = tell[a:b]
            out.append((int(g[at[0]]), _pack(whole[at], mine[at], wanted[at].astype("u1"))))
        yield _emit(["g", "blob"], (pa.int32(), pa.binary()), out)


def _spans(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Union of half-open spans as disjoint, sorted, not touching ones."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.append(True, start[1:] > reach[:-1]))
    return np.stack([start[new], reach[np.append(new[1:], len(start)) - 1]], 1).astype("<i8")


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of ``data``, one after the other."""
    stop = np.cumsum(size, dtype=np.int64)
    return data[np.repeat(start - stop + size, size) + np.arange(stop[-1])] if len(size) else data[:0]


class _Undecided:
    """Segments, and windows of hot strings, of a document group until they are packed, one row for each bucket."""

    def __init__(self):
        self.segments, self.windows, self.size = [], [], 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> None:
        """Columns of windows (hash, document, row, start), or of segments (document, row, start, size, and all bytes)."""
        (self.segments if len(columns) == 5 else self.windows).append((bucket, *columns))
        self.size += sum(c.nbytes for c in columns)

    def rows(self, g: int) -> list[tuple]:
        out = []
        for held in filter(None, (self.segments, self.windows)):
            bucket, *columns = map(np.concatenate, zip(*held))
            raw = columns.pop() if held is self.segments else None
            order = np.argsort(bucket, kind="stable")
            bucket, sorted_columns = bucket[order], [c[order] for c in columns]
            cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            stop = np.append(cut[1:], len(bucket))
            packed = [_pack(*(c[a:e] for c in sorted_columns)) for a, e in zip(cut, stop)]
            if raw is not None:
                size = columns[-1].astype(np.int64)
                raw = _gather(raw, (np.cumsum(size) - size)[order], size[order]).tobytes()
                at = np.append(0, np.cumsum(size[order]))
                packed = [_pack(np.array([e - a], "<i8")) + p + raw[at[a] : at[e]] for p, a, e in zip(packed, cut, stop)]
            out += [(2, int(b), g, None, None, p) for b, p in zip(bucket[cut], packed)]
        self.segments, self.windows, self.size = [], [], 0
        return out


def _decide(buckets: int, hot, block: int, most: int = HELD):
    """Replies, then documents, of each group: spans that are settled and bytes of undecided segments."""

    def emit(out):
        return _emit(["kind", "bucket", "g", "id", "r", "blob"], (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), out)

    def run(batches):
        replies, now, ready, held = [], None, None, _Undecided()
        for batch in batches:
            kind, groups, ids, marks = (batch.column(c).to_pylist() for c in ("kind", "g", "id", "r"))
            texts = batch.column("t").to_pylist()
            at = 0
            while at < len(kind):
                if groups[at] != now:
                    if held.size:
                        yield emit(held.rows(now))
                    now, replies, ready = groups[at], [], None
                if kind[at] == 0:
                    replies.append(_unpack(texts[at], *_REPLY))
                    at += 1
                    continue
                if ready is None:
                    ready = [np.concatenate(c) for c in zip(*replies)] if replies else [np.zeros(0, k) for k in _REPLY]
                    order = np.argsort(ready[0], kind="stable")
                    ready = [c[order] for c in ready]
                stop = at
                while stop < len(kind) and kind[stop] == 1 and groups[stop] == now:
                    stop += 1
                out = []
                for rows, base, some in _stretches(texts[at:stop], block):
                    b = Bytes(some)
                    text, lo, hi, chosen, whole = b.segments()
                    own, mark = (np.array(c[at:stop], np.int64)[rows] for c in (ids, marks))
                    place = np.searchsorted(ready[0], whole)
                    known = np.flatnonzero(place < len(ready[0]))
                    known = known[ready[0][place[known]] == whole[known]]
                    least, ask = ready[1][place[known]], ready[2][place[known]]
                    ident = own[text[known]]
                    full = known[least < ident]
                    shift = base - b.bounds[:-1]  # from a place in the stretches to one in its text
                    cut = np.searchsorted(text[full], np.arange(len(some) + 1))
                    for i in np.flatnonzero(cut[:-1] < cut[1:]).tolist():
                        f = full[cut[i] : cut[i + 1]]
                        out.append((1, None, now, int(own[i]), int(mark[i]), _spans(lo[f] + shift[i], hi[f] + LENGTH + shift[i]).tobytes()))
                    send = known[(ask > 0) & (least == ident)]
                    if not len(send):
                        continue
                    bucket = _bucket(chosen[send], whole[send], buckets, hot.value)
                    split = send[bucket >= buckets]
                    if len(split):  # the windows of hot strings travel one by one
                        size = hi[split] - lo[split] + 1
                        each = np.repeat(split, size)
                        start = np.repeat(lo[split], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                        h = b.hash(start, start + LENGTH)
                        held.add(buckets + (h % np.uint64(buckets)).astype(np.int64), h, own[text[each]], mark[text[each]], start + shift[text[each]])
                    send, bucket = send[bucket < buckets], bucket[bucket < buckets]
                    if len(send):
                        size = hi[send] - lo[send] + LENGTH
                        held.add(bucket, own[text[send]], mark[text[send]], lo[send] + shift[text[send]], size.astype("<u2"), _gather(b.data, lo[send], size))
                    if held.size > most:
                        out += held.rows(now)
                if out:
                    yield emit(out)
                at = stop
        if held.size:
            yield emit(held.rows(now))

    return run


def _compare(buckets: int, memory: int):
    """Undecided segments, or windows of hot strings, of a bucket to spans of windows that occur in a smaller document."""

    def run(batches):
        for bucket, rows in _runs(batches, "bucket"):
            doc, row, g, begin = _loose(rows) if bucket >= buckets else _sorted_segments(rows, memory)
            if not len(doc):
                continue
            order = np.lexsort((row, doc))
            doc, row, g, begin = doc[order], row[order], g[order], begin[order]
            cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])))
            out = [(int(g[a]), int(doc[a]), int(row[a]), _spans(begin[a:e], begin[a:e] + LENGTH).tobytes()) for a, e in zip(cut, np.append(cut[1:], len(doc)))]
            yield _emit(["g", "id", "r", "blob"], (pa.int32(), pa.int64(), pa.int64(), pa.binary()), out)

    return run


def _meeting(data: np.ndarray, bounds: np.ndarray, ident: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """The segments with a window whose hash a segment of another document has too. Equal windows have equal hashes, so the others have no window in common with any."""
    hashes, owners = [], []
    at = 0
    while at < len(ident):
        stop = max(int(np.searchsorted(bounds, bounds[at] + block, "right")) - 1, at + 1)
        b = Bytes([data[bounds[at] : bounds[stop]]])
        count = np.diff(bounds[at : stop + 1]) - LENGTH + 1
        owner = np.repeat(np.arange(len(count)), count)
        start = (bounds[at:stop] - bounds[at] - np.cumsum(count) + count)[owner] + np.arange(len(owner))
        hashes.append(b.hash(start, start + LENGTH))
        owners.append(at + owner)
        at = stop
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(h)
    h, owner = h[order], owner[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    doc = ident[owner]
    met = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    out = np.zeros(len(ident), bool)
    out[owner[np.repeat(met, np.diff(np.append(first, len(h))))]] = True
    return np.flatnonzero(out)


def _sorted_segments(rows: list[dict], memory: int) -> tuple[np.ndarray, ...]:
    """(document, row, group, start) of the windows of packed segments that a smaller document has too, by the suffix order of their bytes."""
    ident, mark, lo, group, size, raw = [], [], [], [], [], []
    for r in rows:
        blob = r["blob"]
        n = int(np.frombuffer(blob, "<i8", 1)[0])
        ident.append(np.frombuffer(blob, "<i8", n, 8))
        mark.append(np.frombuffer(blob, "<i8", n, 8 + 8 * n))
        lo.append(np.frombuffer(blob, "<i8", n, 8 + 16 * n))
        size.append(np.frombuffer(blob, "<u2", n, 8 + 24 * n))
        raw.append(blob[8 + 26 * n :])
        group.append(np.full(n, r["g"]))
    ident, mark, lo, size, group = map(np.concatenate, (ident, mark, lo, size, group))
    size, data = size.astype(np.int64), np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])
    left = _meeting(data, bounds, ident)
    data = _gather(data, bounds[left], size[left])
    ident, mark, lo, size, group = (c[left] for c in (ident, mark, lo, size, group))
    bounds = np.concatenate([[0], np.cumsum(size)])
    owner = np.repeat(np.arange(len(size)), size)
    hits = []
    for place, starts in groups(suffixes(data, LENGTH, memory), LENGTH):
        # a group is a string of LENGTH bytes; only windows inside a segment count
        whose = owner[place]
        doc = np.where(place + LENGTH <= bounds[whose + 1], ident[whose], _NONE)
        least = np.repeat(np.minimum.reduceat(doc, starts), np.diff(np.append(starts, len(doc))))
        hits.append(place[(doc > least) & (doc != _NONE)])
    place = np.concatenate(hits) if hits else np.zeros(0, np.int64)
    whose = owner[place]
    return ident[whose], mark[whose], group[whose], place - bounds[whose] + lo[whose]


def _loose(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """The same of windows that were packed one by one, by their hashes."""
    each = [_unpack(r["blob"], "<u8", "<i8", "<i8", "<i8") for r in rows]
    h, doc, mark, start = map(np.concatenate, zip(*each))
    g = np.repeat([r["g"] for r in rows], [len(e[0]) for e in each])
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(h))))
    hit = order[least < doc[order]]
    return doc[hit], mark[hit], g[hit], start[hit]


def _cut(batches):
    """Spans, then texts, of each identifier and text: what is removed and what is kept."""
    now, spans = object(), []
    for batch in batches:
        out = []
        for row in batch.select(["kind", "id", "r", "t"]).to_pylist():
            if (row["id"], row["r"]) != now:
                now, spans = (row["id"], row["r"]), []
            if row["kind"] == 0:
                spans.append(np.frombuffer(row["t"], "<i8").reshape(-1, 2))
                continue
            text, gone = row["t"], np.zeros((0, 2), np.int64)
            if spans:
                every = np.concatenate(spans)
                gone = _spans(every[:, 0], every[:, 1])
            kept, done = [], 0
            for a, e in gone.tolist():
                kept.append(text[done:a])
                done = e
            kept.append(text[done:])
            out.append((row["id"], len(text), gone.tolist(), b"".join(kept)))
        if out:
            yield _emit(["id", "n_bytes", "spans", "kept"], (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.binary()), out)


def repeated(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", sample: int = SAMPLE, hot: int = HOT, block: int = BLOCK, memory: int = MEMORY) -> DataFrame:
    """id, n_bytes, spans (removed byte ranges) and kept (remaining bytes) of every row; identifiers are integers."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    scratch = Scratch(spark)
    parts, buckets = partitions_for(docs, PART_BYTES), partitions_for(docs, BUCKET_BYTES)
    groups = buckets = -(-buckets // parts) * parts
    slim = docs.select(F.col(ident).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    slim = slim.withColumn("r", F.xxhash64("t"))  # tells rows apart that share an identifier
    slim = slim.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    named = slim.where("id IS NOT NULL")
    held = spark.sparkContext.broadcast(hot_strings(named, sample, hot))
    # documents of one group meet in one task, where their equal tuples are merged before they travel
    tuples = named.repartitionById(parts, "g").sortWithinPartitions("g").mapInArrow(trimmed(_tuples(buckets, held, block)), "bucket int, g int, blob binary")
    replies = scratch.save(tuples.repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_settle(buckets)), "g int, blob binary"), "replies")
    asked = replies.select(F.lit(0).alias("kind"), "g", F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("r"), F.col("blob").alias("t"))
    mixed = asked.unionByName(named.select(F.lit(1).alias("kind"), "g", "id", "r", "t")).repartitionById(parts, "g").sortWithinPartitions("g", "kind")
    decided = scratch.save(mixed.mapInArrow(trimmed(_decide(buckets, held, block)), "kind int, bucket int, g int, id long, r long, blob binary"), "decided")
    scratch.drop("replies")
    found = decided.where("kind = 2").select("bucket", "g", "blob").repartitionById(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(trimmed(_compare(buckets, memory)), "g int, id long, r long, blob binary")
    found = scratch.save(found, "found")
    spans = decided.where("kind = 1").select("g", "id", "r", "blob").unionByName(found).select(F.lit(0).alias("kind"), "g", "id", "r", F.col("blob").alias("t"))
    final = spans.unionByName(slim.select(F.lit(1).alias("kind"), F.coalesce("g", F.lit(0)).alias("g"), "id", "r", "t")).repartition(parts, "g", "id").sortWithinPartitions("id", "r", "kind")
    return final.mapInArrow(trimmed(_cut), "id long, n_bytes long, spans array<array<long>>, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without 50-byte strings of documents with smaller identifiers."""
    out = repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x[1] - x[0])
    return out.select(F.col("id").alias("doc_id"), "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = f"""
WITH body AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
piece AS (SELECT doc_id, c, x[1000 * c + 1:1000 * c + 998 + {2 * LENGTH}] AS y FROM (SELECT doc_id, x, unnest(range(0, len(x) // 1000 + 1)) AS c FROM body)),
gram AS (SELECT doc_id, 500 * c + j AS i, hash(y[2 * j + 1:2 * j + {2 * LENGTH}]) AS h
         FROM (SELECT doc_id, c, y, unnest(range(0, len(y) // 2 - {LENGTH - 1})) AS j FROM piece WHERE len(y) >= {2 * LENGTH})),
early AS (SELECT h, min(doc_id) AS first FROM gram GROUP BY h),
hit AS (SELECT doc_id, i FROM gram JOIN early USING (h) WHERE first < doc_id),
island AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k
           FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM hit)),
span AS (SELECT doc_id, k, min(i) AS a, max(i) + {LENGTH} AS b FROM island GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
cut AS (SELECT doc_id, sum(b - a) AS n, count(*) AS m, max(b) AS last, string_agg(x[2 * p + 1:2 * a], '' ORDER BY a) AS head FROM gap JOIN body USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(m, 0) AS n_spans,
       sha256(unhex(CASE WHEN m IS NULL THEN x ELSE head || x[2 * last + 1:] END)) AS kept_sha256
FROM body LEFT JOIN cut USING (doc_id)
"""
