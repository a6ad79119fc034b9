"""Streaming ingest: new and changed text files replace their rows in the index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import index as store
from ..operators import flow
from ..settings import Settings, load
from ..sources.files import source_path


def ingest(spark: SparkSession, folder: str, index: str, state: str, settings: Settings | None = None, embed: Callable[[F.Column], F.Column] | None = None) -> StreamingQuery:
    """Every text file below folder becomes rows of the index, once; state keeps the progress. Stops when all is read.

    A batch builds the index's next version from the files that it holds and those of the batch: a file that
    comes again replaces its rows. A batch that is lost and run again finds its files reusable or replaces them.
    """
    settings = settings or load()
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).load(folder)

    def add(batch: DataFrame, number: int) -> None:
        old_files, old_chunks = store.load(spark, index)
        latest = batch.groupBy(source_path(F.col("path")).alias("source")).agg(F.max_by("content", "modificationTime").alias("content")).withColumn("file_hash", F.sha2("content", 256))
        keep = old_files.join(latest.select("source"), "source", "left_anti").select("source")
        known, chunks = old_files.join(latest.select("source"), "source", "left_semi"), old_chunks.join(latest.select("source"), "source", "left_semi")
        made = store.build(latest, known, chunks, lambda todo: flow.extract(todo, settings, "demo-fast"), embed)
        store.save(old_files.join(keep, "source", "left_semi").unionByName(made[0]), old_chunks.join(keep, "source", "left_semi").unionByName(made[1]), index)

    return files.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()
