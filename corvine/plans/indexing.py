"""Registered queries of the cascade, the index and questions over documents as files; registry.py imports this module."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import index, plugins
from ..functions import text
from ..operators import corpus, flow
from ..settings import load
from ..sources.files import source_path
from ..sources.scratch import written
from . import registry as r
from .registry import documents, query, table

SETTINGS = load(environment={})


@query("SELECT doc_id, (p - 1) // 4 * 4 + 1 || '-' || least((p - 1) // 4 * 4 + 4, 10) AS window_tag FROM (SELECT doc_id, doc_id // 20 % 10 + 1 AS p FROM documents)")
def page_windows(spark, sf):
    page = (F.floor(F.col("doc_id") / 20) % 10 + 1).cast("int")
    return documents(spark, sf).select("doc_id", flow.window_tag(page, F.lit(10), 4).alias("window_tag"))


@query("SELECT doc_id, '/data/' || (doc_id % 9) || '/d' || doc_id || '.txt' AS source FROM documents")
def source_paths(spark, sf):
    path = F.concat(F.lit("hdfs://host:9000/data//x/../"), (F.col("doc_id") % 9).cast("string"), F.lit("/./d"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents(spark, sf).select("doc_id", source_path(path).alias("source"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE round(value, 2) END AS number FROM events")
def number_or_none(spark, sf):
    i = F.col("event_id")
    raw = F.when(i % 4 == 0, F.lit(None)).when(i % 4 == 1, "n/a").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", F.round(raw.try_cast("double"), 2).alias("number"))


@query("SELECT user_id, coalesce(avg(CASE WHEN event_type = 'error' THEN value END), 0) IS NOT NULL AS known, avg(CASE WHEN event_type = 'error' THEN value END) IS NULL AS empty FROM events GROUP BY user_id")
def empty_means(spark, sf):
    """A mean of nothing is 0 in one report and null in the other."""
    mean = F.avg(F.when(F.col("event_type") == "error", F.col("value")))
    return table(spark, sf, "events").groupBy("user_id").agg(F.coalesce(mean, F.lit(0.0)).isNotNull().alias("known"), mean.isNull().alias("empty"))


@query("SELECT source, min(lang) FILTER (doc_id = f) AS first_lang FROM (SELECT *, min(doc_id) FILTER (coalesce(lang, '') <> '' AND doc_id % 3 <> 0) OVER (PARTITION BY source) AS f FROM documents) GROUP BY source")
def first_metadata(spark, sf):
    """The first value of a file's chunks, in order, that is not empty."""
    value = F.when(F.col("doc_id") % 3 != 0, F.nullif(F.col("lang"), F.lit("")))
    return documents(spark, sf).groupBy("source").agg(F.min_by(value, F.when(value.isNotNull(), F.col("doc_id"))).alias("first_lang"))


@query("SELECT source, doc_id FROM documents WHERE doc_id % 5 <> 0 AND doc_id % 4 = 0")
def chunk_hydration(spark, sf):
    """Each file lists the ids divisible by 4; the index lacks those divisible by 5."""
    rows = documents(spark, sf)
    listed = rows.where("doc_id % 4 = 0").groupBy("source").agg(F.collect_list(F.col("doc_id")).alias("chunk_ids"))
    held = rows.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("chunk_id"), "source")
    return index.chunks_of(listed, held).select("source", F.col("chunk_id").alias("doc_id"))


def _now(spark, sf):
    """Each document is a file; those divisible by 6 have blank texts, those by 11 a suffix that nothing reads."""
    i = F.col("doc_id")
    words = F.when(i % 6 == 0, " ").otherwise(F.coalesce("text", F.lit("")))
    name = F.concat(F.lit("/d"), i.cast("string"), F.when(i % 11 == 0, ".doc").otherwise(".txt"))
    return documents(spark, sf).select("doc_id", name.alias("source"), words.cast("binary").alias("content"), F.sha2(words, 256).alias("file_hash"))


@query("""WITH n AS (SELECT doc_id, '/d' || doc_id || CASE WHEN doc_id % 11 = 0 THEN '.doc' ELSE '.txt' END AS source, CASE WHEN doc_id % 6 = 0 THEN ' ' ELSE coalesce(text, '') END AS t FROM documents),
o AS (SELECT *, doc_id % 3 = 1 AS held FROM n), s AS (SELECT source, sha256(t) AS file_hash, held AND doc_id % 4 <> 0 AS reused, doc_id % 11 = 0 AS unread, NOT regexp_matches(t, '[^ \t\n\r]') AS blank FROM o)
SELECT source, file_hash, CASE WHEN reused THEN 'reused' WHEN unread THEN 'n/a' ELSE 'plain_text' END AS extractor, CASE WHEN reused THEN 'pass' WHEN unread OR blank THEN 'hard_fail' ELSE 'pass' END AS status,
  CASE WHEN reused THEN '' WHEN unread THEN 'exception: unsupported file type .doc' WHEN blank THEN 'chunks==0' ELSE '' END AS reason FROM s""")
def incremental_build(spark, sf):
    """The files of now against an index that has a third of them, of which a quarter has changed, and one that is gone."""
    now = _now(spark, sf)
    old = now.where("doc_id % 3 = 1")
    old_files = old.select(
        "source", F.when(F.col("doc_id") % 4 == 0, "x").otherwise(F.col("file_hash")).alias("file_hash"), F.lit("pass").alias("status"), F.lit("").alias("reason"), F.lit("reused").alias("extractor"), F.lit(1.0).alias("coverage"), F.lit(1).cast("long").alias("chunks"),
    )
    gone = spark.createDataFrame([("/gone.txt", "x", "pass", "", "reused", 1.0, 1)], index.FILES)
    old_chunks = old_files.unionByName(gone).select(*[(F.col(c.split()[0]) if c.split()[0] in ("source", "file_hash") else F.lit(None).cast(c.split()[1])).alias(c.split()[0]) for c in index.CHUNKS.split(", ")])
    files, _, _ = index.build(now.drop("doc_id"), old_files.unionByName(gone), old_chunks, lambda todo: flow.extract(todo, SETTINGS, "demo-fast"))
    return files.select("source", "file_hash", "extractor", "status", "reason")


#: Characters of a book's row, at most but for the last of its documents.
PART_CHARS = 2_000_000


def _books(spark, sf):
    """Each source is a page file: its documents, by id, are its pages. Its rows have about PART_CHARS characters each, with pages `first` to `last`, so that no task holds a whole file."""
    docs = documents(spark, sf).where("source is not null").select("source", "doc_id", F.coalesce("text", F.lit("")).alias("t"))
    sizes = docs.groupBy("source", "doc_id").agg(F.sum(F.length("t")).alias("chars"), F.sum(F.length("t") - F.length(F.replace("t", F.lit("\f"), F.lit(""))) + 1).alias("n"))
    placed = written(corpus.running_sum(sizes, [F.col("source"), F.col("doc_id")], "chars", "upto").withColumn("part", F.floor(F.col("upto") / PART_CHARS)), "placed")
    upto = F.sum("n").over(Window.partitionBy("source").orderBy("part"))
    pages = placed.groupBy("source", "part").agg(F.sum("n").alias("n")).select(F.col("source").alias("of"), F.col("part").alias("at"), (upto - F.col("n") + 1).cast("int").alias("first"), upto.cast("int").alias("last"))
    where = placed.select(F.col("source").alias("s"), F.col("doc_id").alias("d"), "part")
    listed = docs.join(where, F.col("source").eqNullSafe(F.col("s")) & F.col("doc_id").eqNullSafe(F.col("d"))).groupBy("source", "part").agg(F.array_sort(F.collect_list(F.struct("doc_id", "t"))).alias("d"))
    parts = listed.join(pages, (F.col("source") == F.col("of")) & (F.col("part") == F.col("at")))
    return written(parts.select(F.concat(F.lit("/"), "source", F.lit(".pdf")).alias("source"), "first", "last", F.array_join(F.transform("d", lambda x: x["t"]), "\f").cast("binary").alias("content")), "books")


@query()
def cascade_demo_fast(spark, sf):
    return flow.extract(_books(spark, sf), SETTINGS, "demo-fast")[0]


@query()
def cascade_full_quality(spark, sf):
    return flow.extract(_books(spark, sf), SETTINGS, "full-quality")[0]


@query()
def ask_answers(spark, sf):
    """Every benchmark passage is asked over all documents, each a chunk of its source."""
    from ..ask import ask

    rows = documents(spark, sf).select(F.sha2(F.col("doc_id").cast("string"), 256).substr(1, 24).alias("chunk_id"), "source", F.lit(None).cast("int").alias("page"), F.lit("text").alias("kind"), "text", text.tokens(F.col("text")).alias("toks"))
    # Stored, as an index is: every search reads the columns that it needs, and nothing is joined.
    chunks = written(rows.select("*", F.size("toks").alias("dl"), plugins.embedded(F.col("text")).alias("embedding")), "chunks")
    asked = r._asked(spark, sf)
    out = ask(chunks, asked, SETTINGS, "bge_m3")
    return out.select("query_id", "refused", F.sha2("answer", 256).alias("answer_sha256"), F.size("sources").alias("n_sources"))


@query("SELECT item_id AS query_id, CASE WHEN len(string_split(text, ' ')) <= 1 THEN 1 ELSE 2 END AS n_rewrites FROM benchmark")
def query_rewrites(spark, sf):
    from ..ask import rewritten

    return rewritten(r._asked(spark, sf), 3).groupBy("query_id").agg(F.count(F.lit(1)).cast("int").alias("n_rewrites"))


