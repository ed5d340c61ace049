"""Nearest neighbours over vectors of sections.

Exact search: query vectors are few and go to the rows; each Arrow batch of rows
is one matrix product per worker. Rows never meet other rows, and only the best
of each batch leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.small import ROWS
from ..functions.vectors import norm

#: Sections in a block of :func:`similar_pairs`; a pair of blocks has 8 MB of cosines.
BLOCK = 1000
SCHEMA = "qid string, doc_id string, sec_idx int, score double"


def nearest(vectors: DataFrame, queries: DataFrame, k: int, *, where: Column | None = None, block: int = 1000, most: int = ROWS) -> DataFrame:
    """qid, doc_id, sec_idx, score of the ``k`` nearest rows of (doc_id, sec_idx, embedding), cosine mapped to [0, 1].

    ``queries`` are (qid, embedding). Up to ``most`` of them go to every worker; more are dealt into blocks, as
    the rows are, and each pair of blocks is worked on in a task. A query without length finds nothing; a row
    without length scores 0.5. ``where`` filters rows before the search.
    """
    from .search import top_k

    rows = vectors if where is None else vectors.where(where)
    rows = rows.where("embedding IS NOT NULL").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("sec_idx").cast("int").alias("sec_idx"), "embedding")
    named = queries.where("embedding IS NOT NULL").select(F.col("qid").cast("string").alias("qid"), "embedding")
    asked = [(r.qid, r.embedding) for r in named.limit(most + 1).collect()]
    if len(asked) > most:
        return top_k(_in_blocks(rows, named, k, most, block), k)
    names, matrix = _directions([q for q, _ in asked], np.array([v for _, v in asked], np.float64) if asked else None)
    held = rows.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches):
        names, matrix = held.value
        for b in batches:
            if len(names) and b.num_rows:
                yield from _best(names, matrix, b, k, block)

    return top_k(rows.mapInArrow(run, SCHEMA), k)


def _directions(names: list[str], matrix: np.ndarray | None) -> tuple[list[str], np.ndarray | None]:
    """Names and unit vectors of those that have a length."""
    if matrix is None or not len(matrix):
        return [], None
    size = np.linalg.norm(matrix, axis=1)
    at = np.flatnonzero(size > 0)
    return [names[i] for i in at.tolist()], matrix[at] / size[at][:, None]


def _table(column: pa.Array, n: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1)


def _best(names: list[str], matrix: np.ndarray, b: pa.RecordBatch, k: int, block: int):
    """The best rows of a batch for each query."""
    rows = _table(b.column("embedding"), b.num_rows)
    size = np.linalg.norm(rows, axis=1)
    rows = rows / np.where(size > 0, size, 1)[:, None]
    ids, idx = np.array(b.column("doc_id").to_pylist(), object), b.column("sec_idx").to_numpy()
    tie = np.lexsort((idx, ids))
    for at in range(0, len(names), block):
        scores = (matrix[at : at + block] @ rows[tie].T + 1) / 2
        keep = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        q = np.repeat(np.arange(len(scores)), keep.shape[1])
        pick = tie[keep.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([names[at + i] for i in q.tolist()], pa.string()), pa.array(ids[pick].tolist(), pa.string()), pa.array(idx[pick], pa.int32()), pa.array(scores[q, keep.ravel()])], names=["qid", "doc_id", "sec_idx", "score"])


def _in_blocks(rows: DataFrame, queries: DataFrame, k: int, most: int, block: int) -> DataFrame:
    """The best rows of each block of rows for each query; rows meet every block of at most ``most`` queries."""
    spark = rows.sparkSession
    blocks = -(-queries.count() // most) * 2  # blocks by hash are uneven
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).withColumn("rb", numbers(parts))
    right = rows.withColumn("rb", F.pmod(F.xxhash64("doc_id", "sec_idx"), F.lit(parts)).cast("int")).withColumn("qb", numbers(blocks))

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and r.num_rows:
            names, matrix = _directions(q["qid"].to_pylist(), _table(q["embedding"].combine_chunks(), q.num_rows))
            for b in r.combine_chunks().to_batches(max_chunksize=10_000) if names else ():
                out += _best(names, matrix, b, k, block)
        return pa.Table.from_batches(out) if out else pa.table({"qid": pa.array([], pa.string()), "doc_id": pa.array([], pa.string()), "sec_idx": pa.array([], pa.int32()), "score": pa.array([], pa.float64())})

    return left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(meet, SCHEMA)


def similar_pairs(vectors: DataFrame, threshold: float = 0.68, most: int | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, from_idx, to_idx, weight: pairs of sections of one document with cosine ``threshold`` or more, both ways.

    The sections of a document are dealt into blocks of about ``block`` by hash; every pair of blocks is one
    matrix product in a task of its own. With ``most``, documents of more sections
    than that have no pairs, as under the rule of 1000.
    """
    counted = vectors.groupBy("doc_id").agg(F.count("*").alias("n"))
    sizes = (counted if most is None else counted.where(F.col("n") <= most)).select("doc_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    unit = vectors.select("doc_id", "sec_idx", "embedding", norm(F.col("embedding")).alias("size"), F.size("embedding").alias("dims")).where("size > 0 AND sec_idx IS NOT NULL")
    own = F.pmod(F.xxhash64("sec_idx"), F.col("blocks")).cast("int")
    dealt = unit.join(sizes, "doc_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("blocks", "other")
    schema = T.StructType([T.StructField("doc_id", vectors.schema["doc_id"].dataType), *(T.StructField(n, vectors.schema["sec_idx"].dataType) for n in ("from_idx", "to_idx")), T.StructField("weight", T.DoubleType())])

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        own, idx = t["own"].to_numpy(), t["sec_idx"].to_numpy()
        rows = np.asarray(t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(idx), -1)
        size = t["size"].to_numpy()
        first = np.flatnonzero(own == t["lo"][0].as_py())
        second = np.flatnonzero(own == t["hi"][0].as_py())
        weight = rows[first] @ rows[second].T / (size[first][:, None] * size[second])
        near = weight >= threshold
        if t["lo"][0].as_py() == t["hi"][0].as_py():
            near &= idx[first][:, None] < idx[second]
        i, j = np.nonzero(near)
        a, b, w = first[i], second[j], weight[i, j]
        a, b, w = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
        return pa.table([t["doc_id"].take(pa.array(a)), t["sec_idx"].take(pa.array(a)), t["sec_idx"].take(pa.array(b)), pa.array(w)], names=schema.names)

    return dealt.groupBy("doc_id", "dims", "lo", "hi").applyInArrow(run, schema)


def mean_vector(vectors: DataFrame, by: list[str]) -> DataFrame:
    """…by, embedding: the mean of the vectors of each group; sums are combined before they move."""
    places = vectors.select(*by, F.posexplode("embedding").alias("i", "x"))
    means = places.groupBy(*by, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))
