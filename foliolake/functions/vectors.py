"""Vector arithmetic and quantisation.

Inner products of array columns are expressions. Quantised forms are byte
columns and go through Arrow batches, because the JVM has no half floats.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("float32", "float16", "int8", "binary")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / F.nullif(size, F.lit(0.0))).otherwise(0.0)


def to_bytes(vector: np.ndarray, mode: str) -> bytes:
    """One vector in the byte form of ``mode``."""
    v = np.asarray(vector, np.float32)
    if mode == "float32":
        return v.astype("<f4").tobytes()
    if mode == "float16":
        return v.astype("<f2").tobytes()
    if mode == "int8":
        return np.clip(v * (127.0 / (np.abs(v).max(initial=0.0) + 1e-8)), -127, 127).astype(np.int8).tobytes()
    if mode == "binary":
        return np.packbits(v > 0).tobytes()
    raise ValueError(f"unknown quantisation {mode!r}; choose from {MODES}")


def from_bytes(data: bytes, mode: str, dims: int) -> np.ndarray:
    """The vector of a byte form; int8 keeps the direction only, binary gives signs."""
    if mode in ("float32", "float16"):
        return np.frombuffer(data, "<f4" if mode == "float32" else "<f2").astype(np.float32)
    if mode == "int8":
        return np.frombuffer(data, np.int8).astype(np.float32) / 127.0
    if mode == "binary":
        return np.unpackbits(np.frombuffer(data, np.uint8))[:dims].astype(np.float32) * 2 - 1
    raise ValueError(f"unknown quantisation {mode!r}; choose from {MODES}")


def stride(mode: str, dims: int) -> int:
    """Bytes of one vector."""
    return {"float32": 4 * dims, "float16": 2 * dims, "int8": dims, "binary": -(-dims // 8)}[mode]


def _matrix(s: pd.Series, to) -> pd.Series:
    """``to`` on the stacked vectors of a batch that are not null; those of another length on their own."""
    out = pd.Series([None] * len(s), index=s.index, dtype=object)
    sizes = s.map(lambda v: -1 if v is None else len(v))
    for n in sizes[sizes >= 0].unique():
        at = s.index[sizes == n]
        out[at] = to(np.stack(s[at].to_numpy()) if n else np.zeros((len(at), 0), np.float32), int(n))
    return out


def quantised(c: Column, mode: str) -> Column:
    """Byte form of an array column; null stays null."""
    to_bytes(np.zeros(1), mode)

    def pack(m: np.ndarray, n: int) -> list[bytes]:
        m = m.astype(np.float32)
        if mode == "int8":
            m = np.clip(m * (np.float32(127.0) / (np.abs(m).max(axis=1, initial=0.0) + np.float32(1e-8)))[:, None], -127, 127).astype(np.int8)
        elif mode == "binary":
            m = np.packbits(m > 0, axis=1)
        else:
            m = m.astype("<f4" if mode == "float32" else "<f2")
        return [row.tobytes() for row in m]

    def run(s: pd.Series) -> pd.Series:
        return _matrix(s, pack)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(c)


def dequantised(c: Column, mode: str, dims: int) -> Column:
    """Array column of a byte column; bytes of a wrong length give null."""
    size = stride(mode, dims)

    def unpack(m: np.ndarray, n: int) -> list:
        if n != size:
            return [None] * len(m)
        m = m.astype(np.uint8)
        if mode in ("float32", "float16"):
            m = m.view("<f4" if mode == "float32" else "<f2").astype(np.float32)
        elif mode == "int8":
            m = m.view(np.int8).astype(np.float32) / np.float32(127.0)
        else:
            m = np.unpackbits(m, axis=1)[:, :dims].astype(np.float32) * 2 - 1
        return list(m)

    def run(s: pd.Series) -> pd.Series:
        return _matrix(s.map(lambda b: None if b is None else np.frombuffer(b, np.uint8)), unpack)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(c)


def legacy_vectors(c: Column, mode: str, dims: int) -> Column:
    """Vectors of base64 strings, as old catalogues hold them; what is missing or cannot be read is a vector of zeros."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dims)
    return F.coalesce(dequantised(F.try_to_binary(c, F.lit("base64")), mode, dims), zeros)


def embedded(c: Column, embed: Callable[[list[str]], np.ndarray], size: int = 64) -> Column:
    """Vectors of a text column by ``embed``, which sees at most ``size`` texts at once; order is kept and nulls stay null."""

    def run(s: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(s), index=s.index, dtype=object)
        wanted = s[s.notna()]
        for at in range(0, len(wanted), size if size > 0 else max(len(wanted), 1)):
            part = wanted.iloc[at : at + size] if size > 0 else wanted
            out[part.index] = list(np.asarray(embed(part.tolist()), np.float32))
        return out

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(c)


def embed_text(summary: Column, title: Column, text: Column) -> Column:
    """What is embedded of a section: its summary, else its title and the first 300 characters of its text."""
    own = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.substring(F.coalesce(text, F.lit("")), 1, 300))
    return F.regexp_replace(F.coalesce(F.nullif(summary, F.lit("")), own), r"^\s+|\s+$", "")


def int8_levels(c: Column) -> Column:
    """The int8 form as an array of integers, without leaving the JVM."""
    top = F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))
    return F.transform(c, lambda x: F.least(F.greatest(x.cast("double") * (127.0 / (top + 1e-8)), F.lit(-127.0)), F.lit(127.0)).cast("int"))


def hashed_embedding(c: Column, dims: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashes of terms, scaled to unit length."""
    from .text import terms

    spots = F.transform(terms(c), lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(dims)).alias("i"), F.when(F.pmod(F.xxhash64(t, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(spots, F.lit(0.0), lambda a, x: a + F.when(x["i"] == d, x["s"]).otherwise(0.0)))
    size = norm(raw)
    return F.transform(raw, lambda x: (x / F.greatest(size, F.lit(1e-12))).cast("float"))
