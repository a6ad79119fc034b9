"""Command line: index, ask, pdf-regression, selfcheck, prewarm, benchmark-rerank, quality-gate. Reports are JSON lines."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import index, plugins
from .ask import ask, candidates
from .operators import flow, retrieval
from .settings import Settings, load, profile
from .sources import files

RERANKERS = ("amberoad", "bge_m3", "jina_multilingual")


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="corvine")
    out.add_argument("--env", help="file of settings")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, text: str, *options: tuple) -> None:
        one = sub.add_parser(name, help=text)
        for flag, kind, default in options:
            if kind is bool:
                one.add_argument(flag, action="store_true")
            else:
                one.add_argument(flag, type=kind, default=default, required=default is ...) if flag.startswith("-") else one.add_argument(flag, type=kind)

    tops = (("--retrieve-top-k", int, 0), ("--rerank-top-n", int, 0), ("--final-top-k", int, 0))
    command("index", "build or update the index", ("--data-dir", str, ...), ("--extractor", str, "docling"), ("--fast", bool, None), ("--profile", str, None), ("--reset-index", bool, None), ("--output", str, None))
    command("ask", "answer a question", ("query", str, None), ("--reranker", str, None), *tops, ("--skip-preflight", bool, None))
    command("pdf-regression", "extract every page file and report", ("--data-dir", str, ...), ("--extractor", str, "docling"), ("--fast", bool, None), ("--profile", str, "full-quality"), ("--output", str, None))
    command("selfcheck", "check the plug-ins", ("--skip-chat", bool, None), ("--skip-embeddings", bool, None))
    command("prewarm", "load the re-rankers", ("--only", str, None), ("--skip-selfcheck", bool, None))
    command("benchmark-rerank", "compare re-rankers on fixed candidates", ("--queries-file", str, None), ("--only", str, None), ("--retrieve-top-k", int, 50), ("--rerank-top-n", int, 10))
    command(
        "quality-gate", "measure retrieval against a gold set", ("--goldset", str, ...), ("--retrieve-top-k", int, 50), ("--metric-k", int, 10),
        ("--min-recall", float, 0.55), ("--min-mrr", float, 0.45), ("--min-ndcg", float, 0.5), ("--output", str, None),
    )
    return out


def read(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = files.SUFFIXES) -> DataFrame:
    found = files.discover(spark, folder, suffixes)
    return found.select(files.source_path(F.col("path")).alias("source"), F.sha2("content", 256).alias("file_hash"), "content")


def run_index(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    old_files, old_chunks = index.load(spark, s.index_dir)
    if a.reset_index:
        old_files, old_chunks = old_files.limit(0), old_chunks.limit(0)
    kind = profile(a.profile or s.ingest_profile, a.fast, a.extractor)
    made = index.build(read(spark, a.data_dir), old_files, old_chunks, lambda todo: flow.extract(todo, s, kind), lambda text: plugins.embedded(text, batch=s.embedding_batch_size))
    index.save(made[0], made[1], s.index_dir)
    return index.counts(*index.load(spark, s.index_dir), made[2])


def run_ask(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    if not a.skip_preflight and not checks()["ok"]:
        raise RuntimeError("the preflight check failed")
    queries = spark.createDataFrame([(0, a.query)], "query_id long, query string")
    return ask(index.load(spark, s.index_dir)[1], queries, s, a.reranker, a.retrieve_top_k, a.rerank_top_n, a.final_top_k)


def run_regression(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    return flow.extract(read(spark, a.data_dir, ("pdf",)), s, profile(a.profile, a.fast, a.extractor))[0]


def checks(embeddings: bool = True, chat: bool = True) -> dict:
    """Whether each plug-in answers: name, ok, and what went wrong."""
    probes = {"embeddings": lambda: len(plugins.Embedding(plugins.create("embedder", "hashed"))(["probe"])[0]) > 0, "chat": lambda: bool(plugins.create("answerer", "extract").answer("probe", "A probe."))}
    rows = []
    for name, wanted in (("embeddings", embeddings), ("chat", chat)):
        if wanted:
            try:
                rows.append({"name": name, "ok": bool(probes[name]()), "error": None})
            except Exception as e:  # noqa: BLE001  a failed probe is its result
                rows.append({"name": name, "ok": False, "error": f"{type(e).__name__}: {e}"})
    return {"ok": all(r["ok"] for r in rows), "failed": [r["name"] for r in rows if not r["ok"]], "checks": rows}


class Preflight:
    """checks(), remembered for `ttl` seconds."""

    def __init__(self, ttl: float, clock=time.monotonic) -> None:
        self.ttl, self.clock, self.held = ttl, clock, None

    def __call__(self) -> dict:
        now = self.clock()
        if self.held is None or now - self.held[0] >= self.ttl:
            self.held = now, checks()
        return self.held[1]


def prewarm(names: tuple[str, ...] = RERANKERS) -> list[dict]:
    """Makes each re-ranker and scores one pair: name, ok, milliseconds, error."""
    out = []
    for name in names:
        began, error = time.monotonic(), None
        try:
            plugins.create("reranker", name).score([("probe", "probe")])
        except Exception as e:  # noqa: BLE001  a failed load is its result
            error = f"{type(e).__name__}: {e}"
        out.append({"name": name, "ok": error is None, "ms": round(1000 * (time.monotonic() - began), 1), "error": error})
    return out


def run_benchmark(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    queries = files.query_list(spark, a.queries_file)
    rows = candidates(index.load(spark, s.index_dir)[1], queries, s, a.retrieve_top_k, drop=False).join(queries, "query_id")
    names = (a.only,) if a.only else RERANKERS
    scored = rows.withColumns({f"score_{n}": plugins.reranked_score(F.col("query"), F.col("text"), n) for n in names})
    best = retrieval.compare_scorers(scored, {n: F.col(f"score_{n}") for n in names})
    return best.select("query_id", "query", "backend", "chunk_id", "source", "candidate_pos")


def run_gate(spark: SparkSession, a: argparse.Namespace, s: Settings) -> DataFrame:
    gold = files.gold_set(spark, a.goldset, strict=True).select(F.monotonically_increasing_id().alias("query_id"), "query", "relevant_patterns").checkpoint()
    chunks = index.load(spark, s.index_dir)[1]
    ranked = retrieval.by_source(candidates(chunks, gold.select("query_id", "query"), s, a.retrieve_top_k))
    patterns = gold.select("query_id", F.explode("relevant_patterns").alias("pattern")).where("pattern <> ''")
    matched = chunks.select(F.col("source").alias("item")).distinct().join(retrieval.small(patterns), F.lower("item").contains(F.lower("pattern"))).select("query_id", "item").distinct()
    metrics = retrieval.retrieval_metrics(ranked, matched, a.metric_k)
    means = metrics.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
    return retrieval.gate(means, a.min_recall, a.min_mrr, a.min_ndcg)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    s = load(a.env)
    if a.command in ("selfcheck", "prewarm"):
        rows = [checks(not a.skip_embeddings, not a.skip_chat)] if a.command == "selfcheck" else prewarm((a.only,) if a.only else RERANKERS)
        print("\n".join(json.dumps(r) for r in rows))
        return int(not all(r["ok"] for r in rows))
    spark = spark or SparkSession.builder.appName("corvine").getOrCreate()
    run = {"index": run_index, "ask": run_ask, "pdf-regression": run_regression, "benchmark-rerank": run_benchmark, "quality-gate": run_gate}[a.command]
    report = run(spark, a, s)
    if getattr(a, "output", None):
        files.save_json(report, a.output)
        report = spark.read.schema(report.schema).json(a.output)
    ok = True
    for row in report.toJSON().toLocalIterator():
        print(row)
        ok = json.loads(row).get("ok", True) and ok
    return int(not ok)


if __name__ == "__main__":
    sys.exit(main())
