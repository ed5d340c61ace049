"""Vectorised byte-level BPE token counts and ids.

Texts are split into pre-tokens with array operations that follow the public
split pattern (contractions, letters, numbers, other signs, white space), every
pre-token is hashed, and only pre-tokens that a worker has not met before are
encoded. Merges never cross pre-tokens, so the ids equal those of a whole-text
encoding; tests compare both. With ``added``, texts are cut at the added tokens
of the vocabulary's JSON file first, and each of them is a pre-token of its own.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache
from pathlib import Path

import numpy as np

L, N, S, O = 1, 2, 3, 0
_POINTS = 0x110000
#: Pre-tokens that a worker remembers before it starts afresh; about 100 bytes each.
REMEMBER = 500_000


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point, by the same engine's categories as the split pattern."""
    import regex

    table = np.zeros(_POINTS, np.uint8)
    every = "".join(chr(c) for c in range(_POINTS) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((L, r"\p{L}+"), (N, r"\p{N}+"), (S, r"\s+")):
        for m in regex.finditer(pattern, every):
            points = np.frombuffer(m[0].encode("utf-32-le"), "<u4")
            table[points] = kind
    return table


@lru_cache(1)
def _random() -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, _POINTS, np.int64).astype(np.uint64)


class _Powers:
    """Powers of an odd multiplier modulo 2^64, as many as the longest pre-token needs."""

    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            m = np.uint64(pow(0x9E3779B97F4A7C15, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * m])
        return self.table


_powers = _Powers()


def split_points(texts: list[str], added: re.Pattern | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of the joined texts, pre-token starts, text starts with the end appended); what ``added`` matches is one pre-token."""
    joined = "".join(texts)
    cp = np.frombuffer(joined.encode("utf-32-le"), "<u4")
    n = len(cp)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    if not n:
        return cp, np.zeros(0, np.int64), at
    cls = _classes()[cp]
    whole = np.zeros((0, 2), np.int64)
    if added is not None and added.search(joined):
        whole = np.array([(a + m.start(), a + m.end()) for a, t in zip(at.tolist(), texts) for m in added.finditer(t)], np.int64).reshape(-1, 2)
    edges = np.union1d(at, whole.ravel())  # what is between them is split on its own
    doc_start = np.zeros(n + 1, bool)
    doc_start[edges] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])
    start |= doc_start[:n]
    space = cls == S
    # the last sign of a run of white space that something follows in the same text
    last = space.copy()
    last[:-1] &= ~space[1:] & ~doc_start[1:n]
    last[-1] = False
    plain = last & (cp == 32)
    start |= last
    start[1:] &= ~plain[:-1] | doc_start[1:n]
    # contractions: an apostrophe that begins a pre-token and is followed by one of the endings
    quote = np.flatnonzero((cp == 39) & start)
    if len(quote):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        a, b = padded[quote + 1], padded[quote + 2]
        ends = edges[np.searchsorted(edges, quote, "right")]
        one = np.isin(a, [ord(c) for c in "stmd"]) & (quote + 1 < ends)
        two = ((a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (quote + 2 < ends)
        for found, size in ((quote[one], 2), (quote[two & ~one], 3)):
            start[found + 1] = False
            after = found + size
            start[after[after < n]] = True
    for a, b in whole.tolist():
        start[a + 1 : b] = False
    return cp, np.flatnonzero(start), at


def hashes(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of code points that begin at ``starts``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = np.diff(np.append(starts, len(cp)))
    place = np.arange(len(cp)) - np.repeat(starts, sizes)
    weighted = _random()[cp] * _powers.upto(int(sizes.max()))[place]
    h = np.add.reduceat(weighted, starts) + sizes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Encoder:
    """Ids and counts for lists of texts; one per worker process and vocabulary file."""

    def __init__(self, path: str):
        import public_tokenizers as public
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        coding = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.one = coding.encode_ordinary
        self.split = regex.compile(public.PATTERN).findall
        self.short: dict[str, int] = {}
        self.piece = coding._core_bpe.encode_single_piece
        file = Path(path).with_suffix(".json")
        self.added = {t["content"]: t["id"] for t in json.loads(file.read_text())["added_tokens"]} if file.exists() else {}
        self.pattern = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        #: Characters beyond a place that an added token over it may reach.
        self.reach = max(map(len, self.added), default=1) - 1
        self._forget()

    def _forget(self) -> None:
        self.index: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.offsets, self.known = np.zeros(1 << 14, np.int64), 0

    def _learn(self, pieces: list[str]) -> None:
        coded = [[self.added[p]] if p in self.added else self.piece(p.encode()) for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        total = int(sizes.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + len(coded) + 1 > len(self.offsets):
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        self.flat[self.used : self.used + total] = np.fromiter((i for c in coded for i in c), np.uint32, total)
        self.offsets[self.known] = self.used
        np.cumsum(sizes, out=self.offsets[self.known + 1 : self.known + 1 + len(coded)])
        self.offsets[self.known + 1 : self.known + 1 + len(coded)] += self.used
        self.known += len(coded)
        self.used += total

    def pretokens(self, texts: list[str], added: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, index of each pre-token's ids, pre-token bounds of the texts, code point bounds of the texts)."""
        cp, starts, at = split_points(texts, self.pattern if added else None)
        unique, first, inverse = np.unique(hashes(cp, starts), return_index=True, return_inverse=True)
        if self.known + len(unique) > REMEMBER:
            self._forget()
        get = self.index.get
        where = np.fromiter((get(h, -1) for h in unique.tolist()), np.int64, len(unique))
        new = np.flatnonzero(where < 0)
        if len(new):
            begin = starts[first[new]]
            ends = np.append(starts, len(cp))[first[new] + 1]
            joined = "".join(texts)
            self.index.update(zip(unique[new].tolist(), range(self.known, self.known + len(new))))
            where[new] = np.arange(self.known, self.known + len(new))
            self._learn([joined[a:b] for a, b in zip(begin.tolist(), ends.tolist())])
        return starts, where[inverse], np.searchsorted(starts, at), at

    def short_pretokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(characters, tokens) of the pre-tokens of one short text, added tokens cut out: the split pattern itself costs less here than array operations."""
        parts = self.split(text) if self.pattern is None or not self.pattern.search(text) else self._parts(text)
        known = self.short
        try:
            counts = [known[p] for p in parts]
        except KeyError:
            if len(known) > REMEMBER:
                known.clear()
            for p in parts:
                if p not in known:
                    known[p] = 1 if p in self.added else len(self.piece(p.encode()))
            counts = [known[p] for p in parts]
        return np.fromiter(map(len, parts), np.int64, len(parts)), np.array(counts, np.int64)

    def _parts(self, text: str) -> list[str]:
        out, done = [], 0
        for m in self.pattern.finditer(text):
            out += [*self.split(text[done : m.start()]), m[0]]
            done = m.end()
        return out + self.split(text[done:])

    def counts(self, index: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token."""
        return self.offsets[index + 1] - self.offsets[index]

    def encode(self, texts: list[str], added: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in one array, bounds of each text's ids)."""
        _, index, bounds, _ = self.pretokens(texts, added)
        sizes = self.counts(index)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.offsets[index] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[take], ends[bounds]


@lru_cache(4)
def encoder(path: str | None = None) -> Encoder:
    """The worker's encoder for a rank file; by default the 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers as public

        path = public.path("byte_bpe_50k.tiktoken")
    return Encoder(path)


def blocks(texts: list[str], most: int = 1 << 20):
    """Consecutive (first, texts) with at most ``most`` characters each; a longer text is a block of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]
