"""Exact deduplication by content sort.

Sampled splitters range-partition the bytes of the normalised texts, every
partition is sorted externally, so equal texts are neighbours, and full
comparisons of neighbours find the groups. The splitter keys are a 64-character
prefix, a 64-bit hash and the identifier: they stay small however long the
texts are, and because the identifier belongs to the key a group that holds a
third of all rows is spread over many partitions. Only the first and last hash
value of a partition can continue in another one; those edge runs are joined by
SHA-256, and there are at most a few of them per partition.

Defined cases: a null text equals the empty text. A null identifier sorts below
every other and stays only if its whole group has none. Repeated rows with one
identifier are all marked ``kept`` by :func:`exact_groups`; of them
:func:`exact_dedup` keeps one row. An empty table gives an empty result. Other
columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, arrow_bytes, fresh, trimmed

PREFIX = 64
NAME = "op9_exact_dedup"


def _sorted(df: DataFrame, text: str, ident: str, keep: str) -> tuple[DataFrame, str]:
    """``df`` with a hash column, range-partitioned and sorted by content, the row that stays first in its run."""
    h = fresh(df, "__hash")
    df = df.withColumn(h, F.xxhash64(text))
    order: Column = F.col(ident).desc_nulls_last() if keep == "max" else F.col(ident).asc_nulls_last()
    ranged = df.repartitionByRange(F.substring(text, 1, PREFIX), F.col(h), order)
    return ranged.sortWithinPartitions(F.substring(text, 1, PREFIX), F.col(h), F.col(text), order), h


def exact_groups(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", keep: str = "max", normalise=lambda c: c) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    id_type = docs.schema[ident].dataType
    slim = docs.select(F.col(ident).alias("doc_id"), normalise(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    ordered, h = _sorted(slim, "text", "doc_id", keep)
    out = T.StructType([T.StructField("doc_id", id_type), T.StructField("local_keep", id_type), T.StructField("local_n", T.LongType()), T.StructField("text_sha256", T.StringType()), T.StructField("edge", T.BooleanType())])
    id_arrow = pa.int64() if isinstance(id_type, T.LongType) else None

    def scan(batches):
        # Only identifiers are kept of a run, so a task's memory follows the rows of its range and not their texts.
        ids, keeps, sizes, shas, edges = [], [], [], [], []
        schema = None

        def slim_batches():
            nonlocal schema
            for b in batches:
                schema = b.schema
                yield b

        def flush():
            kind = id_arrow or schema.field("doc_id").type
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(keeps, kind), pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), pa.array(edges, pa.bool_())], names=out.names)

        for rows, sha, edge in _id_runs(slim_batches(), h):
            n = len(rows)
            ids += rows
            keeps += [rows[0]] * n
            sizes += [n] * n
            shas += [sha] * n
            edges += [edge] * n
            if len(ids) >= 8192:
                yield flush()
                ids, keeps, sizes, shas, edges = [], [], [], [], []
        if ids:
            yield flush()

    scratch = Scratch(spark)
    rows = scratch.save(ordered.mapInArrow(trimmed(scan), out), "rows")
    best = F.max("doc_id") if keep == "max" else F.min("doc_id")
    # at most the runs of a partition's first and last hash: a bounded number of rows per partition
    edges = rows.where("edge").groupBy("text_sha256").agg(best.alias("edge_keep"), F.count("*").alias("edge_n"))
    joined = rows.join(F.broadcast(edges), "text_sha256", "left")
    keep_id = F.when(F.col("edge"), F.col("edge_keep")).otherwise(F.col("local_keep"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.when(F.col("edge"), F.col("edge_n")).otherwise(F.col("local_n")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def _id_runs(batches: Iterator[pa.RecordBatch], h: str) -> Iterator[tuple[list, str, bool]]:
    """Walks sorted rows; yields (identifiers, sha256, edge) for each run of equal texts."""
    first_hash, held, cur = None, [], None
    for batch in batches:
        ids = batch.column("doc_id").to_pylist()
        texts, hashes = batch.column("text"), batch.column(h).to_pylist()
        for i, hv in enumerate(hashes):
            t = texts[i].as_py()
            if cur is not None and cur[0] == hv and cur[1] == t:
                cur[2].append(ids[i])
                continue
            if cur is not None:
                held.append((cur[0], hashlib.sha256(cur[1].encode()).hexdigest(), cur[2]))
                if cur[0] != hv:
                    for k, sha, rows in held:
                        yield rows, sha, k == first_hash
                    held = []
            else:
                first_hash = hv
            cur = (hv, t, [ids[i]])
    if cur is not None:
        for k, sha, rows in [*held, (cur[0], hashlib.sha256(cur[1].encode()).hexdigest(), cur[2])]:
            yield rows, sha, True


def exact_dedup(docs: DataFrame, *, ident: str = "doc_id", text: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one per distinct text."""
    spark = docs.sparkSession
    arrow_bytes(spark)
    norm = fresh(docs, "__norm")
    ordered, h = _sorted(docs.withColumn(norm, F.coalesce(F.col(text), F.lit(""))), norm, ident, keep)
    sha, edge, pid = fresh(docs, "__sha"), fresh(docs, "__edge"), fresh(docs, "__pid")
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField(sha, T.StringType()), T.StructField(edge, T.BooleanType()), T.StructField(pid, T.IntegerType())])

    def scan(batches):
        # a run is told by its first row; only winners of the last hash value wait, copied out of their batches
        first_hash = last = None
        held: list[tuple[pa.RecordBatch, list[int], list[str]]] = []
        me = TaskContext.get().partitionId()

        def emit(edges):
            for rows, hashes, shas in held:
                extra = [pa.array(shas, pa.string()), pa.array([h in edges for h in hashes], pa.bool_()), pa.array([me] * len(hashes), pa.int32())]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in columns), *extra], names=schema.names)

        for batch in batches:
            texts, hashes = batch.column(norm), batch.column(h).to_pylist()
            won, shas = [], []
            for i, hv in enumerate(hashes):
                t = texts[i].as_py()
                if last is None:
                    first_hash = hv
                elif last == (hv, t):
                    continue
                last = (hv, t)
                won.append(i)
                shas.append(hashlib.sha256(t.encode()).hexdigest())
            if not won:
                continue
            rows, hashes = batch.take(pa.array(won)), [hashes[i] for i in won]
            ended = next((i for i in range(len(won), 0, -1) if hashes[i - 1] != last[0]), 0)
            if ended or held and held[-1][1][-1] != last[0]:
                held.append((rows.slice(0, ended), hashes[:ended], shas[:ended]))
                yield from emit((first_hash,))
                held, rows, hashes, shas = [], rows.slice(ended), hashes[ended:], shas[ended:]
            held.append((rows, hashes, shas))
        if last is not None:
            yield from emit((first_hash, last[0]))

    won = Scratch(spark).save(ordered.mapInArrow(trimmed(scan), schema), "winners")
    order = F.col(ident).desc_nulls_last() if keep == "max" else F.col(ident).asc_nulls_last()
    rank = fresh(won, "__rank")
    # one winner per partition and text at most, so this window's groups are bounded by the number of partitions
    resolved = won.where(F.col(edge)).withColumn(rank, F.row_number().over(Window.partitionBy(sha).orderBy(order, pid))).where(F.col(rank) == 1)
    return won.where(~F.col(edge)).select(*columns).unionByName(resolved.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts over the whole table; the largest doc_id stays."""
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
