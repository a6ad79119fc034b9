"""The index: tables of chunks and of files, built file by file and swapped as one version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import tokens
from .operators.corpus import chunk_id, dedup_within, incremental

FILES = "source string, file_hash string, status string, reason string, extractor string, coverage double, chunks long"
CHUNKS = "chunk_id string, source string, file_hash string, content_hash string, page int, kind string, ord long, text string, toks array<string>, dl int, embedding array<float>"


def version(spark: SparkSession, path: str) -> int:
    """The last whole version of the index; 0 if there is none."""
    try:
        return spark.read.schema("at string, version int").parquet(f"{path}/manifest").agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(files, chunks) of the last version; empty tables if there is none."""
    last = version(spark, path)
    if not last:
        return spark.createDataFrame([], FILES), spark.createDataFrame([], CHUNKS)
    return tuple(spark.read.schema(s).parquet(f"{path}/{name}/version={last}") for name, s in (("files", FILES), ("chunks", CHUNKS)))


def save(files: DataFrame, chunks: DataFrame, path: str) -> None:
    """A new version beside the old one. Readers see it once its manifest, written last, is there: both tables change as one, and an index may be made from itself."""
    spark = files.sparkSession
    number = version(spark, path) + 1
    for name, df, schema in (("files", files, FILES), ("chunks", chunks, CHUNKS)):
        columns = [c.split()[0] for c in schema.split(", ")]
        # A run that was lost before may have left this folder.
        df.select(*columns).write.mode("overwrite").parquet(f"{path}/{name}/version={number}")
    spark.range(1).select(F.current_timestamp().cast("string").alias("at")).write.parquet(f"{path}/manifest/version={number}")


def chunks_of(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """listed(source, chunk_ids) -> its chunks; ids that the index lacks are dropped."""
    return listed.select(F.explode("chunk_ids").alias("chunk_id")).join(chunks, "chunk_id")


def counts(files: DataFrame, chunks: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: files indexed and failed, files whose content another has, chunks, and chunks left out as copies within their file."""
    f = files.agg(F.count_if(F.col("status") != "hard_fail").alias("indexed_files"), F.count_if(F.col("status") == "hard_fail").alias("failed_files"), (F.count("file_hash") - F.count_distinct("file_hash")).alias("duplicate_files"))
    c = chunks.agg(F.count(F.lit(1)).alias("indexed_chunks"))
    d = extracted.agg((F.count(F.lit(1)) - F.count_distinct("source", "content_hash")).alias("deduplicated_chunks"))
    return f.crossJoin(c).crossJoin(d)


def build(files: DataFrame, old_files: DataFrame, old_chunks: DataFrame, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], embed: Callable[[F.Column], F.Column] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(files, chunks, extracted): files(source, file_hash, ...) of now against an index.

    A file of equal hash and usable quality keeps its rows. All others are extracted anew: extract(files) gives
    outcomes(source, extractor, status, reason, coverage, n_chunks) and chunks(source, page, ord, kind, text). Rows
    of files that are gone or changed go. A hard fail, or a result without chunks, has a row in files and no
    chunks. Within a file only the first of equal texts stays; it is embedded after that.
    """
    known = old_chunks.groupBy("source").agg(F.count(F.lit(1)).alias("held"))
    previous = old_files.join(known, "source", "left").select("source", "file_hash", "status", F.coalesce("held", F.lit(0)).alias("chunks"), "coverage")
    plan = incremental(files.select("source", "file_hash"), previous)
    keep = plan.where("action = 'reuse'").select("source")
    todo = files.join(plan.where("action = 'extract'").select("source"), "source", "left_semi")
    outcomes, found = extract(todo)
    failed = (F.col("status") == "hard_fail") | (F.coalesce("n_chunks", F.lit(0)) == 0)
    new_files = files.select("source", "file_hash").join(outcomes, "source").select(
        "source", "file_hash", F.when(failed, "hard_fail").otherwise(F.col("status")).alias("status"), F.when(failed & (F.col("status") != "hard_fail"), "chunks==0").otherwise(F.col("reason")).alias("reason"),
        "extractor", "coverage", F.when(failed, 0).otherwise(F.col("n_chunks")).cast("long").alias("chunks"),
    )
    good = new_files.where("status <> 'hard_fail'").select("source", "file_hash")
    extracted = found.join(good, "source").withColumn("content_hash", F.sha2("text", 256))
    once = dedup_within(extracted.select("source", "file_hash", "content_hash", "page", "kind", "ord", "text"), "source", "content_hash", ["ord"])
    vectors = embed(F.col("text")) if embed else F.lit(None).cast("array<float>")
    made = once.withColumn("toks", tokens(F.col("text"))).select(
        chunk_id(F.col("source"), F.col("file_hash"), F.col("page"), F.col("kind"), F.col("content_hash")).alias("chunk_id"),
        "source", "file_hash", "content_hash", "page", "kind", "ord", "text", "toks", F.size("toks").alias("dl"), vectors.alias("embedding"),
    )
    return old_files.join(keep, "source", "left_semi").unionByName(new_files), old_chunks.join(keep, "source", "left_semi").unionByName(made), extracted
