"""File sources and sinks: discovery, plain text, gold sets, queries, checkpoints, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("pdf", "txt", "csv", "md")
GOLD = "query string, relevant_patterns array<string>"
# The queries of a benchmark without a file of its own.
QUERIES = (
    "Что такое регуляризация в глубоком обучении?",
    "Какие цели у AI Act в ЕС?",
    "Как считается Recall@K в RAG?",
    "Сравни embedding и reranker в RAG пайплайне",
)


def discover(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, below: str | None = None) -> DataFrame:
    """path, modificationTime, length, content of the folder's files by suffix (any case), without those in the folder `below`; a missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes))
    return files if below is None else files.where(~F.col("path").contains(f"/{below.strip('/')}/"))


def pages_of(spark: SparkSession, folder: str, below: str | None = None) -> DataFrame:
    """discover() of page files alone, sorted by path."""
    return discover(spark, folder, ("pdf",), below).orderBy("path")


def source_path(path: Column) -> Column:
    """A file's path without scheme and host, and without empty, `.` and `..` steps: the name of its rows in the index."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")
    steps = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    # Each `..` takes the step before it away.
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def sources(folders: dict[str, DataFrame], mode: str = "both") -> DataFrame:
    """(origin, path) of demo files, uploads, or both; nothing at all is an error."""
    wanted = {"demo": ["demo"], "uploads": ["uploads"], "both": ["demo", "uploads"]}
    if mode not in wanted:
        raise ValueError(f"mode must be one of {', '.join(wanted)}")
    parts = [folders[n].select(F.lit(n).alias("origin"), "path").distinct() for n in wanted[mode] if n in folders]
    if not any(p.head(1) for p in parts):
        raise ValueError("there are no files to index")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def plain_text(files: DataFrame) -> DataFrame:
    """path, file_hash, text: UTF-8 with bad bytes dropped; tables of text files are not parsed."""
    text = F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit(""))
    return files.select("path", F.sha2("content", 256).alias("file_hash"), text.alias("text"))


def gold_set(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Lines of {query, relevant_patterns}; blank lines are skipped, malformed ones raise. strict: an empty set or a blank query raises, too."""
    rows = spark.read.schema(GOLD).option("mode", "FAILFAST").json(path)
    if strict:
        n, bad = rows.agg(F.count(F.lit(1)), F.count_if(F.coalesce(F.trim("query"), F.lit("")) == "")).first()
        if not n or bad:
            raise ValueError(f"{path}: {f'{bad} blank queries' if n else 'no queries'}")
    return rows


def query_list(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(query_id, query): lines of .txt and .md files, `query` of JSON lines that have one; without a path the fixed ones."""
    if path is None:
        return spark.createDataFrame(list(enumerate(QUERIES)), "query_id long, query string")
    if path.lower().endswith((".txt", ".md")):
        rows = spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")
    else:
        rows = spark.read.schema("query string").option("mode", "FAILFAST").json(path).where("query is not null")
    return rows.select(F.monotonically_increasing_id().alias("query_id"), "query")


def checkpoint_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines of JSON; malformed ones are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(df: DataFrame, path: str, write) -> None:
    """Writes df with write(writer, folder) beside path and moves it there: a job that fails leaves what was there before, which df may be read from."""
    spark = df.sparkSession
    beside, before = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    write(df.write, beside)
    (new, store), (old, _), (now, _) = _files(spark, beside), _files(spark, before), _files(spark, path)
    if store.exists(now):
        store.rename(now, old)
    if not store.rename(new, now):
        store.rename(old, now)
        raise OSError(f"could not move {beside} to {path}")
    store.delete(old, True)


def save_log(log: DataFrame, path: str) -> None:
    replace(log, path, lambda w, at: w.json(at))


def save_csv(report: DataFrame, path: str) -> None:
    replace(report, path, lambda w, at: w.csv(at, header=True))


def save_json(report: DataFrame, path: str) -> None:
    """One JSON object a line, nulls included."""
    replace(report, path, lambda w, at: w.option("ignoreNullFields", False).json(at))


def save_tsv(rows: DataFrame, path: str) -> None:
    """Tab-separated lines without a head; tabs and line ends within values become spaces."""
    values = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]+", " ") for c in rows.columns]
    replace(rows.select(F.concat_ws("\t", *values).alias("value")), path, lambda w, at: w.text(at))


def markdown(rows: DataFrame) -> DataFrame:
    """(line): rows of a markdown table without its head; pipes and line ends within values are escaped."""
    values = [F.regexp_replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), r"[\r\n]+", " ") for c in rows.columns]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |")).alias("line"))


def markdown_head(rows: DataFrame) -> str:
    return f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}"
