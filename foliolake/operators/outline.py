"""Section numbers, parents and children from heading levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def _before() -> Window:
    return Window.partitionBy("doc_id").orderBy("sec_idx").rowsBetween(Window.unboundedPreceding, -1)


def _last(level: int) -> Column:
    """Index of the last section of ``level`` above this one."""
    return F.max(F.when(F.col("level") == level, F.col("sec_idx"))).over(_before())


def parents(sections: DataFrame) -> DataFrame:
    """Adds parent_idx: the nearest section above with a smaller level, null at the top."""
    nearest = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > n, _last(n)) for n in range(1, LEVELS)])
    return sections.withColumn("parent_idx", nearest)


def number(sections: DataFrame) -> DataFrame:
    """Adds parent_idx, id ("§1.2"), parent_id and depth. Skipped levels close up: a level-4 heading below a level-1 one is its child.

    A section above is an ancestor if its level is smaller and no later one has a level that is smaller
    still; the ancestor at a depth is the last section of that depth. So the whole path comes from
    running windows over one document, which share one exchange; nothing is joined.
    """
    marks = [f"__last{n}" for n in range(1, LEVELS)]
    seen = sections.withColumns({m: _last(n) for n, m in enumerate(marks, 1)})
    below = lambda n: F.greatest(F.lit(-1), *[F.coalesce(m, F.lit(-1)) for m in marks[: n - 1]], F.lit(-1))
    up = [F.when((F.col("level") > n) & (F.coalesce(m, F.lit(-1)) > below(n)), 1).otherwise(0) for n, m in enumerate(marks, 1)]
    nearest = F.greatest(F.lit(None).cast("int"), *[F.when(F.col("level") > n, F.col(m)) for n, m in enumerate(marks, 1)])
    placed = seen.withColumns({"parent_idx": nearest, "depth": sum(up[1:], up[0]) + 1}).drop(*marks)
    # partitioned by the document and more, so the exchange above serves here too
    own = F.row_number().over(Window.partitionBy("doc_id", "parent_idx").orderBy("sec_idx"))
    here = Window.partitionBy("doc_id").orderBy("sec_idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    steps = [f"__step{n}" for n in range(1, LEVELS + 1)]
    ranked = placed.withColumn("__own", own).withColumns({s: F.last(F.when(F.col("depth") == n, F.col("__own")), ignorenulls=True).over(here) for n, s in enumerate(steps, 1)})
    path = lambda n: F.concat(F.lit("§"), F.array_join(F.slice(F.array(*[F.col(s).cast("string") for s in steps]), F.lit(1), n), "."))
    return ranked.withColumns({"id": path(F.col("depth")), "parent_id": F.when(F.col("depth") > 1, path(F.col("depth") - 1))}).drop("__own", *steps)


def children(numbered: DataFrame) -> DataFrame:
    """doc_id, id, children (ids in reading order) of every section."""
    below = numbered.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sec_idx", "id"))), lambda x: x["id"]).alias("children"))
    return numbered.select("doc_id", "id").join(below, ["doc_id", "id"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def squared(tables):
    """Tables whose rows have the width of their header: padded with empty cells or cut."""

    def fit(t):
        n = F.size(t["headers"])
        rows = F.transform(t["rows"], lambda r: F.when(n == 0, r).otherwise(F.slice(F.concat(r, F.array_repeat(F.lit(""), n)), F.lit(1), n)))
        return F.struct(t["table_id"].alias("table_id"), t["caption"].alias("caption"), t["headers"].alias("headers"), rows.alias("rows"))

    return F.transform(tables, fit)


def normalise(raw: DataFrame) -> DataFrame:
    """Raw sections of a source to numbered sections with squared tables and token estimates."""
    from ..functions.text import token_estimate

    good = raw.where("error IS NULL").withColumn("tables", squared(F.col("tables")))
    return number(good).withColumn("token_count", token_estimate(F.col("text")))
