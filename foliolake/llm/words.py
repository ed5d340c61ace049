"""Vectorised word splitting and hashing over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_S = np.uint64(31)


@lru_cache(4)
def _tables(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(is a word byte, random value of a byte after A-Z became a-z)."""
    byte = np.arange(256)
    low = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    if kind == "alnum":  # [^\x00-\x2F\x3A-\x60\x7B-\x7F]
        inside = (low >= 48) & (low <= 57) | (low >= 97) & (low <= 122) | (low >= 128)
    elif kind == "space":  # [^\x20\x09-\x0D]
        inside = ~((low == 32) | (low >= 9) & (low <= 13))
    else:
        raise ValueError(kind)
    value = np.random.default_rng(11).integers(1, 1 << 63, 256, np.int64).astype(np.uint64)
    return inside, value[low]


class _Powers:
    def __init__(self):
        self.table = np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        while len(self.table) < n:
            m = np.uint64(pow(0xD1342543DE82EF95, len(self.table), 1 << 64))
            self.table = np.concatenate([self.table, self.table * m])
        return self.table


_powers = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64-bit values."""
    h = (h ^ (h >> _S)) * _MIX
    return h ^ (h >> np.uint64(29))


def word_stretches(texts: list[bytes], kind: str, most: int = 1 << 19):
    """(starts of all words in the joined texts, bounds of each text's words, stretches).

    A stretch is (first word, powers-weighted characters, starts of its words among them, sizes), of about
    ``most`` bytes, so what is held beside the words does not grow with the texts.
    """
    inside_of, value = _tables(kind)
    data = np.frombuffer(b" ".join(texts), np.uint8)
    inside = inside_of[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    place = np.flatnonzero(begin)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])

    def stretches():
        cut = np.unique(np.append(np.searchsorted(place, np.arange(0, len(data), most)), len(place)))
        if cut[0]:
            cut = np.append(0, cut)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            span = slice(int(place[a]), int(place[b]) if b < len(place) else len(data))
            within = inside[span]
            chars = value[data[span][within]]
            starts = np.flatnonzero(begin[span][within])
            sizes = np.diff(np.append(starts, len(chars)))
            order = np.arange(len(chars)) - np.repeat(starts, sizes)
            chars *= _powers.upto(int(sizes.max()))[order]
            yield a, chars, starts, sizes, order

    return place, np.searchsorted(place, at), stretches()


def hash_words(texts: list[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each lower-cased word, bounds of each text's words)."""
    place, bounds, stretches = word_stretches(texts, kind)
    out = np.zeros(len(place), np.uint64)
    for first, chars, starts, sizes, _ in stretches:
        out[first : first + len(starts)] = mix(np.add.reduceat(chars, starts) + sizes.astype(np.uint64))
    return out, bounds


def byte_blocks(texts: list[bytes], most: int = 1 << 20):
    """Consecutive (first, texts) of at most ``most`` bytes; a longer text is a block of its own."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t)
    if first < len(texts):
        yield first, texts[first:]
