"""Toxicity by FTRL-proximal logistic regression over hashed word grams.

Features of a text are hashed word unigrams, bigrams, skip-grams (words two
apart) and word beginnings of 5 to 7 bytes, which carry over to inflected and
compound words. Their value falls with the length of the text, so a few hits
in a long text count less. Per-coordinate learning rates and L1 shrinkage leave
few weights other than zero; these are broadcast, and their number is bounded
by the size of the hash space.

The model is fitted on a bounded sample: the ``SAMPLE`` labelled rows with the
smallest hash of their identifier. Labels come only from rows outside the
held-out quarter (crc32 of the identifier as text, modulo 4, equal to 2).

Defined cases: null and empty texts have no features and get the score of the
intercept; rows without an identifier count as not held out and are not used
for fitting; null labels are ignored, contradicting ones count as toxic;
without labels of both classes every score is 0. Of rows with one identifier the
largest text is fitted. A very long text has at most 2^20 features of 8 bytes, so
the sample on the driver is bounded, and takes 17 MB where texts have some hundred
words. Extra columns pass through :func:`reject` untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, arrow_bytes, fresh, trimmed
from .words import byte_blocks, mix, word_stretches

NAME = "op5_toxicity"
#: Labelled rows that are fitted on at most, and passes over them.
SAMPLE, EPOCHS = 5000, 3
BITS, ALPHA, BETA, L1, L2, THRESHOLD = 20, 0.2, 1.0, 3.0, 0.0, 0.3
BEGINNINGS = (5, 6, 7)
_NEXT, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(ident: Column) -> Column:
    """Whether labels of this row are only for evaluation."""
    return F.coalesce(F.crc32(ident.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash bucket) of every gram occurrence, and the words of each text."""
    place, bounds, stretches = word_stretches(texts, "alnum")
    sizes = np.diff(bounds)
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    word = np.empty(len(place), np.uint64)
    found, whose = [word], [owner]
    for first, chars, starts, length, within in stretches:
        here = slice(first, first + len(starts))
        word[here] = mix(np.add.reduceat(chars, starts) + length.astype(np.uint64))
        for k in BEGINNINGS:
            longer = length > k
            found.append(mix(np.add.reduceat(np.where(within < k, chars, np.uint64(0)), starts) + np.uint64(1000 + k))[longer])
            whose.append(owner[here][longer])
    for apart, factor in ((1, _NEXT), (2, _SKIP)):
        same = owner[:-apart] == owner[apart:]
        found.append(mix(word[:-apart] * factor + word[apart:])[same])
        whose.append(owner[apart:][same])
    return np.concatenate(whose), (np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), sizes


def _values(whose: np.ndarray, bucket: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, value) of distinct features."""
    key, count = np.unique(whose << BITS | bucket, return_counts=True)
    text = key >> BITS
    return text, key & ((1 << BITS) - 1), np.log1p(200 * count / (sizes[text] + 30))


class Ftrl:
    """FTRL-proximal state; ``learn`` takes one example, ``weights`` gives the sparse model."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last one is the intercept

    def _weights(self, at) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0, w)

    def _intercept(self) -> float:
        return float(-self.z[-1] / ((self.beta + self.n[-1] ** 0.5) / self.alpha))

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        w, b = self._weights(at), self._intercept()
        g = 1 / (1 + np.exp(-np.clip(w @ value + b, -35, 35))) - label
        step = g * value
        self.z[at] += step - (np.sqrt(self.n[at] + step * step) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += step * step
        self.z[-1] += g - ((self.n[-1] + g * g) ** 0.5 - self.n[-1] ** 0.5) / self.alpha * b
        self.n[-1] += g * g

    def weights(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(buckets, weights other than zero, intercept)."""
        w = self._weights(slice(0, 1 << BITS))
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32), self._intercept()


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, epochs: int = EPOCHS, ident: str = "doc_id", text: str = "text", label: str = "toxic"):
    """Weights from the labelled rows that are not held out, or None where they lack a class."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    known = labels.where(F.col(label).isNotNull() & F.col(ident).isNotNull() & ~held_out(F.col(ident))).groupBy(F.col(ident).alias("i")).agg(F.max(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("i"), "i").limit(sample)  # bounded: broadcast below
    named = docs.select(F.col(ident).alias("i"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t")).join(F.broadcast(chosen), "i")
    number = F.col("i").cast("long") if isinstance(docs.schema[ident].dataType, T.IntegralType) else F.xxhash64(F.col("i").cast("string"))
    rows = named.groupBy("i").agg(F.max("y").alias("y"), F.max("t").alias("t")).select(number.alias("i"), "y", "t")

    def features(batches):
        for b in batches:
            at, value, ys = [], [], b.column("y")
            for _, some in byte_blocks(b.column("t").to_pylist()):
                whose, bucket, v = _values(*grams(some))
                cut = np.searchsorted(whose, np.arange(len(some) + 1))
                for i in range(len(some)):
                    at.append(bucket[cut[i] : cut[i + 1]].astype("<i4").tobytes())
                    value.append(v[cut[i] : cut[i + 1]].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("i"), ys, pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["i", "y", "at", "value"])

    scratch = Scratch(spark)
    held = scratch.save(rows.mapInArrow(trimmed(features), "i long, y int, at binary, value binary"), "features")
    examples = [(r.i, r.y, np.frombuffer(r.at, "<i4"), np.frombuffer(r.value, "<f4")) for r in held.toLocalIterator()]
    scratch.drop("features")
    if len({y for _, y, _, _ in examples}) < 2:
        return None
    examples.sort(key=lambda e: (e[0] * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))  # an order that does not follow the partitions
    model = Ftrl()
    for _ in range(epochs):
        for _, y, at, value in examples:
            model.learn(at, value, y)
    return model.weights()


def score(docs: DataFrame, model, *, text: str = "text", into: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 added."""
    arrow_bytes(docs.sparkSession)
    if model is None:
        return docs.withColumn(into, F.lit(0.0))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, weights, intercept = held.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weights
        for texts in parts:
            out = np.empty(len(texts))
            for first, some in byte_blocks(list(texts)):
                whose, bucket, sizes = grams(some)
                used = dense[bucket] != 0
                t, k, v = _values(whose[used], bucket[used], sizes)
                logit = np.bincount(t, dense[k] * v, len(some)) + intercept
                out[first : first + len(some)] = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pd.Series(out)

    probability = trimmed(probability)
    # pandas_udf reads the hints as objects, and this module keeps them as text
    probability.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(into, F.pandas_udf(probability, T.DoubleType())(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def reject(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with their columns."""
    p = fresh(docs, "__score")
    return score(docs, fit(docs, labels, ident=ident, text=text), text=text, into=p).where(F.col(p) < threshold).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and decision of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs.select("doc_id", "text"), fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


SQL = None  # a fitted model; tests measure held-out accuracy
