"""Tables that are small: broadcast after their rows were counted, and spread over the cores."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most rows of questions, question terms or query vectors that go to every executor.
ROWS = 100_000


def few(df: DataFrame, rows: int = ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; no more than one beyond is counted."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows; otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if few(df, rows) else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its files make fewer partitions than there are cores; larger tables stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def first_of(df: DataFrame, keys: dict, order: str) -> DataFrame:
    """One row for each value of ``keys`` (names and columns): the values, and the row's least ``order``; counts are combined before they move."""
    return df.groupBy(*(c.alias(n) for n, c in keys.items())).agg(F.min(order).alias(order))
