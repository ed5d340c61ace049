"""Passages: natural boundaries with overlap, and plain word windows."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let


def _pieces(text: str, size: int):
    """Paragraphs; of too long ones the sentences; of too long ones windows."""
    for part in re.split(r"\n\s*\n", text):
        part = part.strip()
        if len(part) <= size:
            if part:
                yield part
            continue
        for sentence in filter(None, map(str.strip, re.split(r"(?<=[.!?])\s+", part))):
            yield from (sentence[i : i + size] for i in range(0, len(sentence), size))


def passages(text: str | None, size: int = 2_000, overlap: int = 200) -> list[str]:
    """Passages of at most ``size`` characters; each repeats up to ``overlap`` of the one before, if there is room."""
    text = text.strip() if text else ""
    if len(text) <= size or size <= 0:
        return [text] if text else []
    overlap = min(max(overlap, 0), size // 2)
    out: list[str] = []
    now = ""
    for piece in _pieces(text, size):
        if now and len(now) + 1 + len(piece) > size:
            out.append(now)
            joined = f"{now[-overlap:]} {piece}".strip() if overlap else piece
            now = joined if len(joined) <= size else piece
        else:
            now = f"{now} {piece}" if now else piece
    return [*out, now] if now else out


def passage_column(c: Column, size: int = 2000, overlap: int = 200) -> Column:
    """An array of passages."""

    def run(s: pa.Array) -> pa.Array:
        # a batch has 10,000 texts; Python holds those of 100 with their passages
        parts = [pa.array([passages(t, size, overlap) for t in s.slice(at, 100).to_pylist()], pa.list_(pa.string())) for at in range(0, len(s), 100)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    run.__annotations__ = {"s": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<string>")(c)


def explode_passages(sections: DataFrame, size: int = 2000, overlap: int = 200, text: str = "text") -> DataFrame:
    """One row per passage, with chunk_idx."""
    others = [c for c in sections.columns if c != text]
    return sections.select(*others, F.posexplode(passage_column(F.col(text), size, overlap)).alias("chunk_idx", "chunk"))


def word_windows(c: Column, size: int = 512) -> Column:
    """Consecutive windows of ``size`` words joined by spaces."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(w, i, F.lit(size)), " "))

    # the words are told apart once, and not again for each window
    return let(F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda x: x != ""), cut)
