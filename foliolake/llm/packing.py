"""Best-fit packing of tokenised documents into sequences of fixed capacity.

A document is its ids and one separator; longer ones are cut so that only the
first piece is shorter than the capacity. What is packed then depends on piece
lengths alone, so the plan is made on the histogram of lengths, which has at
most ``capacity`` rows whatever the input. Pieces above a third of the capacity
are at most two in a sequence: they are paired greedily, the longest with the
longest that still fits. Smaller ones, longest first, go where they leave the
smallest gap. The plan lists runs of equal sequences; pieces find their place
in it by their rank among the pieces of their length, which is a prefix sum
over partitions and not a sort of the data. No row is moved for packing.

Defined cases: a null text is empty, so its document is the separator alone.
Null and repeated identifiers are packed row by row like any other. An empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import blocks, encoder
from .scratch import Scratch, arrow_bytes, trimmed

NAME = "op3_best_fit_packing"
CAPACITY, SEPARATOR = 2048, 0


class Plan:
    """Runs of equal sequences built from a histogram; ``segments[length]`` has the places of its pieces in rank order."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.bins = capacity, 0
        self.segments: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)  # (pieces, first bin, pieces in each bin, offset)
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
        large = sorted((n for n in counts if 3 * n > capacity), reverse=True)
        left = {n: counts[n] for n in large}
        for n in large:
            while left[n]:
                # the longest partner that fits; a piece may pair with one of its own length
                mate = next((m for m in large if m <= capacity - n and left[m] > (m == n)), None)
                if mate is None:
                    self._place([(n, 1)], left[n])
                    left[n] = 0
                else:
                    times = left[n] // 2 if mate == n else min(left[n], left[mate])
                    self._place([(n, 2)] if mate == n else [(n, 1), (mate, 1)], times)
                    left[n] -= times
                    left[mate] -= times
        for n in sorted((n for n in counts if 3 * n <= capacity), reverse=True):
            rest = counts[n]
            for gap in sorted(g for g in self.gaps if g >= n):
                each = gap // n
                runs = self.gaps.pop(gap)
                while runs and rest:
                    first, bins = runs.pop()
                    full = min(bins, rest // each)
                    if full:
                        self._fill(n, each, first, full, gap)
                        rest -= full * each
                    if full < bins and rest:
                        self._fill(n, rest, first + full, 1, gap)
                        rest, full = 0, full + 1
                    if full < bins:
                        runs.append((first + full, bins - full))
                if runs:
                    self.gaps[gap] += runs
                if not rest:
                    break
            if rest:
                each = capacity // n
                if rest // each:
                    self._place([(n, each)], rest // each)
                if rest % each:
                    self._place([(n, rest % each)], 1)

    def _fill(self, n: int, each: int, first: int, bins: int, gap: int) -> None:
        self.segments[n].append((each * bins, first, each, self.capacity - gap))
        if gap - each * n:
            self.gaps[gap - each * n].append((first, bins))

    def _place(self, items: list[tuple[int, int]], bins: int) -> None:
        first, used = self.bins, 0
        self.bins += bins
        for n, each in items:
            self.segments[n].append((each * bins, first, each, used))
            used += n * each
        if used < self.capacity:
            self.gaps[self.capacity - used].append((first, bins))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """(base of each length in the flat arrays, first rank, first bin, pieces in each bin, offset)."""
        base = np.zeros(self.capacity + 2, np.int64)
        flat = []
        for n in range(self.capacity + 1):
            rank = 0
            for pieces, first, each, offset in self.segments.get(n, ()):
                flat.append((rank, first, each, offset))
                rank += pieces
            base[n + 1] = len(flat)
        return (base, *np.array(flat, np.int64).reshape(-1, 4).T)


def locate(arrays: tuple[np.ndarray, ...], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank among their length."""
    base, first_rank, first_bin, each, offset = arrays
    lo, hi = base[length], base[length + 1]  # a binary search in each length's own segments
    while (open_ := hi - lo > 1).any():
        mid = (lo + hi) // 2
        up = open_ & (first_rank[np.minimum(mid, len(first_rank) - 1)] <= rank)
        lo, hi = np.where(up, mid, lo), np.where(open_ & ~up, mid, hi)
    r = rank - first_rank[lo]
    return first_bin[lo] + r // each[lo], offset[lo] + r % each[lo] * length


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, separator: int = SEPARATOR, ranks: str | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for the ranks, the task and the place among its pieces of this length."""
    arrow_bytes(docs.sparkSession)
    kind = docs.schema[ident].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, t()) for n, t in (("piece", T.IntegerType), ("start", T.LongType), ("length", T.LongType), ("ids_crc32", T.LongType), ("part", T.IntegerType), ("local", T.LongType)))])

    def cut(batches):
        me, coder, seen = TaskContext.get().partitionId(), encoder(ranks), defaultdict(int)
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for first, some in blocks([t or "" for t in batch.column("text").to_pylist()]):
                ids, bounds = coder.encode(some, added=True)
                ids = np.insert(ids.astype("<u4"), bounds[1:], separator)
                bounds = bounds + np.arange(len(bounds))
                for i in range(len(some)):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    start, size = 0, (b - a) % capacity or capacity
                    piece = 0
                    while start < b - a:
                        local = seen[size]
                        seen[size] = local + 1
                        for column, value in zip(rows, (first + i, piece, start, size, zlib.crc32(ids[a + start : a + start + size]), local)):
                            column.append(value)
                        start, size, piece = start + size, capacity, piece + 1
            at = pa.array(rows[0], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:5]), pa.array([me] * len(at), pa.int32()), pa.array(rows[5], pa.int64())], names=schema.names)

    return docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).mapInArrow(trimmed(cut), schema)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, separator: int = SEPARATOR, ranks: str | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = Scratch(spark).save(pieces(docs, capacity=capacity, separator=separator, ranks=ranks, ident=ident, text=text), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    counts = {r.length: r.n for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.sparkContext.broadcast(Plan(counts, capacity).arrays())  # bounded by the capacity, not by the input
    out = T.StructType([*(f for f in cut.schema if f.name not in ("part", "local")), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for b in batches:
            sequence, offset = locate(plan.value, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in out.names[:-2]), pa.array(sequence), pa.array(offset)], names=out.names)

    ranked = cut.join(before, ["part", "length"]).select(*out.names[:-2], (F.col("before") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(place, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None  # SQL has no byte-level BPE; tests compare with the tokenizer and check every sequence
