"""A folder as a stream of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.outline import normalise
from ..sources.files import sections_of

_FILE = "path string, modificationTime timestamp, length long, content binary"


def follow(spark: SparkSession, folder: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parses files as they appear below ``folder`` and writes numbered sections to ``out``/batch=N.

    The batch number names the partition, so a batch that is run again replaces its own rows. With
    ``once`` the query ends when it has taken what is there.
    """
    files = spark.readStream.format("binaryFile").schema(_FILE).option("recursiveFileLookup", "true").load(folder)

    def write(batch: DataFrame, number: int) -> None:
        normalise(sections_of(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    started = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def latest(sections: DataFrame) -> DataFrame:
    """Of documents that were ingested more than once, the sections of the last batch."""
    from pyspark.sql import functions as F

    last = sections.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return sections.join(last, ["doc_id", "batch"], "left_semi")
