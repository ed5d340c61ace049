"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

The rows get global numbers (range partitioning by identifier, a count per
partition, prefix sums of the counts). A keyed Feistel network permutes
``[0, 4^b)``, the smallest such domain that holds all rows, and walks its cycle
until the image is below the number of rows: a permutation of the rows that
needs no state. ``shard = image mod shards`` and ``slot = image div shards``,
so shard sizes differ by one row at most, and :func:`place` and :func:`locate`
compute either direction from the row number alone.

Defined cases: null identifiers come first; rows that tie in identifier are
ordered by size and checksum and, if these tie too, are interchangeable. A null
text has no bytes. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, arrow_bytes

NAME = "op8_feistel_shards"
SHARDS, SEED, ROUNDS = 24, 20240917, 6
_PRIME, _MASK = (1 << 31) - 1, (1 << 64) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(multiplier, addend, multiplier) below 2^31 for each round, from a splitmix generator."""
    state, keys = seed & _MASK, []
    for _ in range(rounds):
        triple = []
        for _ in range(3):
            state = (state + 0x9E3779B97F4A7C15) & _MASK
            z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
            z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
            triple.append((z ^ (z >> 31)) % (_PRIME - 1) + 1)
        keys.append(tuple(triple))
    return keys


def half_bits(n: int) -> int:
    """Bits of half a block in the smallest domain 4^b >= n."""
    return max(1, ((max(n, 1) - 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, b: int, keys) -> np.ndarray:
    mask = (1 << b) - 1
    left, right = x >> b, x & mask
    for a, k, m in keys:
        left, right = right, left ^ ((right * a + k) % _PRIME * m % _PRIME & mask)
    return left << b | right


def _inverse(y: np.ndarray, b: int, keys) -> np.ndarray:
    mask = (1 << b) - 1
    left, right = y >> b, y & mask
    for a, k, m in reversed(keys):
        left, right = right ^ ((left * a + k) % _PRIME * m % _PRIME & mask), left
    return left << b | right


def _walk(x: np.ndarray, n: int, seed: int, step) -> np.ndarray:
    b, keys = half_bits(n), round_keys(seed)
    y = step(np.asarray(x, np.int64), b, keys)
    while len(out := np.flatnonzero(y >= n)):
        y[out] = step(y[out], b, keys)
    return y


def place(row: np.ndarray, n: int, shards: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(shard, slot) of global row numbers."""
    y = _walk(row, n, seed, _network)
    return y % shards, y // shards


def locate(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int = SEED) -> np.ndarray:
    """The global row number at a shard's slot."""
    return _walk(np.asarray(slot, np.int64) * shards + shard, n, seed, _inverse)


def shard_rows(docs: DataFrame, *, shards: int = SHARDS, seed: int = SEED, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row (global number), shard, slot for every row."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    slim = docs.select(F.col(ident).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    ordered = slim.repartitionByRange("doc_id", "size", "text_crc32").sortWithinPartitions("doc_id", "size", "text_crc32")
    numbered = Scratch(spark).save(ordered.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "rows")
    counts = {r.part: r.n for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row per partition
    parts = sorted(counts)
    total = sum(counts.values())
    offsets = spark.createDataFrame(list(zip(parts, accumulate([0, *(counts[p] for p in parts[:-1])]))), "part int, first long")
    kind = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    @F.pandas_udf(kind)
    def placed(row: pd.Series) -> pd.DataFrame:
        shard, slot = place(row.to_numpy(), total, shards, seed)
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    rows = numbered.join(F.broadcast(offsets), "part").withColumn("row", F.col("at") + F.col("first"))
    return rows.withColumn("place", placed("row")).select("doc_id", "size", "text_crc32", "row", "place.shard", "place.slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into 24 shards whose row counts are at most one apart."""
    rows = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


SQL = None  # no CRC-32 in the SQL engine; tests compare with a loop over the rows
