"""Index tables on disk that follow their documents: fingerprints decide what is built anew."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folder import delete, exists, saved, shared_folder, state_of
from ..functions.small import few
from ..functions.text import counted

#: Most asked terms that become a filter on the files; more are joined.
LISTED = 1000


def fingerprints(sections: DataFrame) -> DataFrame:
    """doc_id, hash, n_secs: SHA-256 over the identifier, the number of sections and, of each, id, length and first 200 characters.

    Only these pieces travel to one task per document, not the texts.
    """
    piece = F.struct("sec_idx", "id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"), F.substring(F.coalesce("text", F.lit("")), 1, 200).alias("head"))
    grouped = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(piece)).alias("parts"))

    def run(batches):
        for b in batches:
            hashes = []
            for doc, parts in zip(b["doc_id"], b["parts"]):
                size = struct.Struct(">I").pack
                pieces = [str(doc).encode(), size(len(parts))]
                for p in parts:
                    pieces += [(p["id"] or "").encode(), size(p["n"]), p["head"].encode()]
                hashes.append(hashlib.sha256(b"".join(pieces)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "hash": hashes, "n_secs": [len(p) for p in b["parts"]]})

    return grouped.mapInPandas(run, "doc_id string, hash string, n_secs int") if dict(sections.dtypes)["doc_id"] == "string" else grouped.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, "doc_id string, hash string, n_secs int")


def text_fingerprints(sections: DataFrame) -> DataFrame:
    """doc_id, hash: the same idea inside the JVM, over id, length and head of each section joined by line ends."""
    line = F.concat_ws("|", F.col("id"), F.char_length(F.coalesce("text", F.lit(""))).cast("string"), F.substring(F.coalesce("text", F.lit("")), 1, 200))
    return sections.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", line.alias("line")))), lambda x: x["line"]), "\n").cast("binary"), 256).alias("hash"))


def whole_fingerprints(sections: DataFrame) -> DataFrame:
    """doc_id, hash: over id and a digest of the whole text of each section, so no change is missed; the digests travel, not the texts."""
    line = F.concat_ws("|", F.col("id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    return sections.groupBy("doc_id").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", line.alias("line")))), lambda x: x["line"]), "\n").cast("binary"), 256).alias("hash"))


def stale(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents whose fingerprint is not in the registry."""
    return current.join(registry.select("doc_id", "hash"), ["doc_id", "hash"], "left_anti")


def gone(current: DataFrame, registry: DataFrame) -> DataFrame:
    """Registered documents that no longer exist."""
    return registry.join(current.select("doc_id"), "doc_id", "left_anti")


def refreshed(index: DataFrame, rebuilt: DataFrame, changed: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Index rows with those of changed documents replaced and those of removed ones left out."""
    out = changed.select("doc_id") if removed is None else changed.select("doc_id").unionByName(removed.select("doc_id"))
    return index.join(out.distinct(), "doc_id", "left_anti").unionByName(rebuilt)


def postings(sections: DataFrame) -> DataFrame:
    """doc_id, sec_idx, length, distinct, term, tf of (doc_id, sec_idx, tokens): the stored form of the lexical index; terms are counted inside a row."""
    # sizes first: what stands beside a generator is computed for each of its rows
    sized = sections.select("doc_id", "sec_idx", F.size("tokens").alias("length"), F.size(F.array_distinct("tokens")).alias("distinct"), "tokens")
    return sized.select("doc_id", "sec_idx", "length", "distinct", F.inline(counted(F.col("tokens"))))


@dataclass
class Stored:
    """A lexical index on disk, with the methods that ``search`` asks for: only the rows of asked terms are read."""

    rows: DataFrame
    scopes: DataFrame
    lengths: DataFrame

    def hits(self, asked: DataFrame, mark) -> DataFrame:
        terms = asked.select("term").distinct()
        rows = self.rows
        if few(terms, LISTED):
            # a list of terms reaches the files, whose row groups are sorted by term
            rows = rows.where(F.col("term").isin([r.term for r in terms.collect()]))
        else:
            rows = rows.join(mark(terms), "term")
        return rows.select("doc_id", "sec_idx", "length", "distinct", "term", F.col("tf").cast("long").alias("tf"))

    def totals(self, by: list[str]) -> DataFrame:
        return self._scope(by).select(*by, "n", "mean")

    def mean_idf(self, by: list[str]) -> DataFrame:
        return self._scope(by).select(*by, "mean_idf")

    def norms(self, by: list[str]) -> DataFrame:
        return self.lengths.select("doc_id", "sec_idx", F.col("own_norm" if by else "norm").alias("norm"))

    def _scope(self, by: list[str]) -> DataFrame:
        return self.scopes.where("own" if by else "NOT own")


def write(sections: DataFrame, folder: str) -> None:
    """Writes the index of (doc_id, sec_idx, tokens): postings sorted by term, totals of the whole and of each document, and norms."""
    from . import search

    spark = sections.sparkSession
    rows = saved(postings(sections).repartition("term").sortWithinPartitions("term"), f"{folder}/postings")
    sizes = sections.select("doc_id", F.size("tokens").alias("size"))
    scopes, norms = [], []
    for by in ([], ["doc_id"]):
        totals = sizes.groupBy(*by).agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
        df = rows.groupBy(*by, "term").agg(F.count("*").alias("df"))
        with_n = df.join(totals, by) if by else df.crossJoin(F.broadcast(totals))  # one row of totals
        idf = saved(with_n.select(*by, "term", search._raw_idf().alias("raw"), search._smooth_idf().alias("smooth")), f"{folder}/idf{len(by)}")
        mean = idf.groupBy(*by).agg(F.avg("raw").alias("mean_idf"))
        # a document whose sections have no terms has no mean
        whole = totals.join(mean, by, "left") if by else totals.crossJoin(F.broadcast(mean))
        scopes.append(whole.select((F.col("doc_id") if by else F.lit(None).cast(sections.schema["doc_id"].dataType)).alias("doc_id"), F.lit(bool(by)).alias("own"), "n", "mean", "mean_idf"))
        norms.append(rows.join(idf, [*by, "term"]).groupBy("doc_id", "sec_idx").agg(F.sqrt(F.sum((F.col("tf") * F.col("smooth")) ** 2)).alias("own_norm" if by else "norm")))
    scopes[0].unionByName(scopes[1]).write.mode("overwrite").parquet(f"{folder}/scopes")
    norms[0].join(norms[1], ["doc_id", "sec_idx"]).write.mode("overwrite").parquet(f"{folder}/norms")
    for name in ("idf0", "idf1"):
        delete(spark, f"{folder}/{name}")
    spark.createDataFrame([(1,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done")


def stored(spark: SparkSession, folder: str) -> Stored:
    return Stored(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "scopes", "norms")))


def is_stored(spark: SparkSession, folder: str) -> bool:
    """Whether a complete index is there."""
    return exists(spark, f"{folder}/done/_SUCCESS")


def invalidate(spark: SparkSession, folder: str) -> None:
    delete(spark, folder)


def kept(spark: SparkSession, source: str, sections: Callable[[], DataFrame], name: str = "lexical") -> Stored:
    """The index of what lies at ``source``: built once in the shared folder, and again when files there change."""
    folder = _folder(spark, source, name)
    if not is_stored(spark, folder):
        write(sections(), folder)
    return stored(spark, folder)


def present(spark: SparkSession, source: str, name: str = "lexical") -> Stored | None:
    """The index of what lies at ``source`` as it is now, if :func:`kept` has built one."""
    folder = _folder(spark, source, name)
    return stored(spark, folder) if is_stored(spark, folder) else None


def _folder(spark: SparkSession, source: str, name: str) -> str:
    return f"{shared_folder(spark)}/index-{name}-{state_of(spark, source)}"


def statistics(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """doc_id, n_sections and the number of edges of each kind."""
    n = sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"))
    kinds = edges.groupBy("doc_id").pivot("edge_type", ["child", "parent", "semantic", "sibling"]).count()
    return n.join(kinds, "doc_id", "left").na.fill(0)
