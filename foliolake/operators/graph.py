"""The graph of a document's sections: an edge table, one hop of expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import similar_pairs

#: What a neighbour adds to a section's score, by kind of edge; parents add nothing.
GAIN = {"child": 0.15, "sibling": 0.10, "semantic": 0.12}


def edges(numbered: DataFrame, vectors: DataFrame | None = None, *, threshold: float = 0.68, most: int | None = None) -> DataFrame:
    """doc_id, from_idx, to_idx, edge_type, weight: child and parent 1.0, sibling 0.8, semantic by cosine.

    With ``most``, documents of more sections have no semantic edges (the reference: 1000).
    """
    tied = numbered.where("parent_idx IS NOT NULL").select("doc_id", F.col("parent_idx").alias("p"), F.col("sec_idx").alias("c"))
    down = tied.select("doc_id", F.col("p").alias("from_idx"), F.col("c").alias("to_idx"), F.lit("child").alias("edge_type"), F.lit(1.0).alias("weight"))
    up = tied.select("doc_id", F.col("c").alias("from_idx"), F.col("p").alias("to_idx"), F.lit("parent").alias("edge_type"), F.lit(1.0).alias("weight"))
    a, b = tied.withColumnRenamed("c", "from_idx"), tied.withColumnRenamed("c", "to_idx")
    side = a.join(b, ["doc_id", "p"]).where("from_idx <> to_idx").select("doc_id", "from_idx", "to_idx", F.lit("sibling").alias("edge_type"), F.lit(0.8).alias("weight"))
    out = down.unionByName(up).unionByName(side)
    if vectors is not None:
        out = out.unionByName(similar_pairs(vectors, threshold, most).withColumn("edge_type", F.lit("semantic")))
    return out


def edge_counts(edge_table: DataFrame) -> DataFrame:
    return edge_table.groupBy("doc_id", "edge_type").agg(F.count("*").alias("n_edges"))


def expand(seeds: DataFrame, edge_table: DataFrame) -> DataFrame:
    """qid, doc_id, sec_idx, score: seeds plus what they pass on along one hop; sections reached anew join in."""
    gain = F.coalesce(*[F.when(F.col("edge_type") == k, F.lit(g)) for k, g in GAIN.items()])
    used = edge_table.where(F.col("edge_type").isin(*GAIN))
    passed = seeds.join(used, (seeds["doc_id"] == used["doc_id"]) & (seeds["sec_idx"] == used["from_idx"])).select("qid", seeds["doc_id"], F.col("to_idx").alias("sec_idx"), (gain * F.col("weight") * F.col("score")).alias("score"))
    return seeds.select("qid", "doc_id", "sec_idx", "score").unionByName(passed).groupBy("qid", "doc_id", "sec_idx").agg(F.sum("score").alias("score"))


def expand_outline(seeds: DataFrame, numbered: DataFrame, edge_table: DataFrame | None = None) -> DataFrame:
    """What :func:`expand` gives for the child and sibling edges of ``numbered``, and further edges, without a table of sibling pairs.

    The seeds of a parent are summed and the sum goes to its children once, less what each would get from itself,
    so a parent of n children costs n rows and not n squared.
    """
    tied = numbered.where("parent_idx IS NOT NULL").select("doc_id", F.col("parent_idx").alias("p"), "sec_idx")
    down = seeds.select("qid", "doc_id", F.col("sec_idx").alias("p"), "score").join(tied, ["doc_id", "p"]).select("qid", "doc_id", "sec_idx", (GAIN["child"] * F.col("score")).alias("score"))
    own = seeds.join(tied, ["doc_id", "sec_idx"]).select("qid", "doc_id", "sec_idx", "p", "score")
    total = own.groupBy("qid", "doc_id", "p").agg(F.sum("score").alias("total"), F.count("*").alias("n"))
    mine = own.select("qid", "doc_id", "sec_idx", F.col("score").alias("mine"))
    around = total.join(tied, ["doc_id", "p"]).join(mine, ["qid", "doc_id", "sec_idx"], "left").where(F.col("n") > F.col("mine").isNotNull().cast("int"))
    side = around.select("qid", "doc_id", "sec_idx", (GAIN["sibling"] * 0.8 * (F.col("total") - F.coalesce("mine", F.lit(0.0)))).alias("score"))
    passed = down.unionByName(side)
    if edge_table is not None:
        more = expand(seeds, edge_table)  # holds the seeds themselves
        return more.unionByName(passed).groupBy("qid", "doc_id", "sec_idx").agg(F.sum("score").alias("score"))
    return seeds.select("qid", "doc_id", "sec_idx", "score").unionByName(passed).groupBy("qid", "doc_id", "sec_idx").agg(F.sum("score").alias("score"))
