"""Questions over an index, from rewrites to an answer, for any number of questions at once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import plugins
from .functions.text import years
from .operators import retrieval
from .operators.corpus import latest_by
from .settings import Settings
from .sources.scratch import written

EMPTY = "The index is empty."


def rewritten(queries: DataFrame, n: int, rewriter: str = "halves") -> DataFrame:
    """(query_id, rewrite, query) of queries(query_id, query), the rewrites numbered from 0."""

    @F.pandas_udf("array<string>")
    def made(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = plugins.create("rewriter", rewriter)
        for part in parts:
            yield part.map(lambda q: plugins.rewrites(model, q or "", n))

    return written(queries.select("query_id", F.posexplode(made("query")).alias("rewrite", "query")), "rewrites")


def candidates(chunks: DataFrame, queries: DataFrame, settings: Settings, k: int, embedder: str = "hashed", rewriter: str = "halves", drop: bool = True) -> DataFrame:
    """chunks is read several times, so it should be a stored table. (query_id, pos, item, score, bm25_score, dense_score, and the chunk's columns): two fusions over the rewrites' lists."""
    asked = rewritten(queries, settings.rewrite_n, rewriter).withColumn("turn", F.xxhash64("query_id", "rewrite"))
    # Chunks are numbered by the digits of their ids: dense search takes numbers.
    numbered = chunks.withColumn("item", F.conv(F.substring("chunk_id", 1, 15), 16, 10).cast("long"))
    lexical = retrieval.bm25_topk(numbered.select(F.col("item").alias("doc_id"), "dl", "toks"), asked.select(F.col("turn").alias("query_id"), "query"), k).select(F.col("query_id").alias("turn"), F.lit(0).alias("list_no"), F.col("doc_id").alias("item"), "rank", "score")
    vectors = asked.select(F.col("turn").alias("query_id"), plugins.embedded(F.col("query"), embedder).alias("qvec"))
    dense = retrieval.dense_topk(numbered.select(F.col("item").alias("vec_id"), "embedding"), vectors, k).select(F.col("query_id").alias("turn"), F.lit(1).alias("list_no"), F.col("vec_id").alias("item"), "rank", "score")
    lists = written(lexical.unionByName(dense).join(asked.select("turn", "query_id", "rewrite"), "turn").drop("turn"), "lists")
    found = retrieval.small(written(retrieval.two_level(lists, k, settings.rrf_k, drop), "candidates"))  # so that texts are not shuffled for them
    return found.join(numbered.select("item", "chunk_id", "source", "page", "kind", "text"), "item")


def ask(
    chunks: DataFrame, queries: DataFrame, settings: Settings, reranker: str | None = None, retrieve_k: int = 0, rerank_n: int = 0, final_k: int = 0, embedder: str = "hashed", rewriter: str = "halves", answerer: str = "extract",
) -> DataFrame:
    """queries(query_id, query) -> query_id, answer, refused (reason or null), context, sources.

    Numbers of 0 take the settings' values. A question whose finals are refused has the reason as its answer.
    """
    if not chunks.head(1):
        return queries.select("query_id", F.lit(EMPTY).alias("answer"), F.lit("no_context").alias("refused"), F.lit("").alias("context"), F.array().cast("array<string>").alias("sources"))
    reranker, k = reranker or settings.default_reranker, retrieve_k or settings.retrieve_top_k
    rows = candidates(chunks, queries, settings, k, embedder, rewriter).join(retrieval.small(queries.select("query_id", "query")), "query_id")
    rows = rows.withColumns({"query_years": years(F.col("query")), "source_years": years(F.concat_ws(" ", "source", "text"))})
    if settings.retrieval_year_boost_enabled:
        rows = retrieval.year_boost(rows, settings.retrieval_year_boost).drop("boosted")
    if settings.retrieval_source_diversity_enabled:
        rows = retrieval.source_diversity(rows, settings.retrieval_source_max_chunks_per_source, k)
    ranked = retrieval.rerank(rows, plugins.reranked_score(F.col("query"), F.col("text"), reranker), rerank_n or settings.rerank_top_n)
    last = final_k or settings.final_top_k
    if settings.rerank_year_retention_enabled:
        hit = F.coalesce(F.arrays_overlap("query_years", "source_years"), F.lit(False))
        finals = retrieval.year_retention(ranked.withColumn("year_hit", hit), last, settings.rerank_year_retention_max_score_gap)
    else:
        finals = ranked.where(F.col("pos") <= last)
    finals = written(finals.select("query_id", "pos", "chunk_id", "source", "page", "text", "rerank_score"), "finals")
    verdicts = retrieval.grounding(finals, queries.select("query_id", F.lit(reranker).alias("backend")), settings.grounded_min_chunks, settings.grounded_min_total_context_chars)
    sources = finals.groupBy("query_id", "source").agg(F.min("pos").alias("first")).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "source"))), lambda x: x["source"]).alias("sources"))
    full = queries.select("query_id", "query").join(verdicts.select("query_id", F.col("reason").alias("refused")), "query_id").join(retrieval.answer_context(finals), "query_id", "left").join(sources, "query_id", "left")

    @F.pandas_udf("string")
    def answers(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = plugins.create("answerer", answerer)
        for asked, refused, context in parts:
            yield pd.Series([f"No grounded answer: {r}" if r is not None else plugins.answer_or_reason(model, q or "", c or "") for q, r, c in zip(asked, refused, context, strict=True)], index=asked.index)

    return full.select("query_id", answers("query", "refused", "context").alias("answer"), "refused", F.coalesce("context", F.lit("")).alias("context"), F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def judge(answers: DataFrame, queries: DataFrame, providers: list[str], log: str, retries: int = 2) -> DataFrame:
    """Judges every question by every provider that has no success in the log at that path, appends the runs to it, and returns the latest run of each.

    log rows: provider, query_id, status (success, failed, timeout), message, the judge's three measures, at.
    """
    spark = answers.sparkSession
    schema = "provider string, query_id long, status string, message string, faithfulness double, answer_relevance double, context_relevance double, at long"
    todo = answers.join(queries.select("query_id", "query"), "query_id").select(F.explode(F.array(*map(F.lit, providers))).alias("provider"), F.col("query_id").cast("long").alias("query_id"), "query", "answer", "context")
    runs = 0
    try:
        before = spark.read.schema(schema).parquet(log)
        runs = 1 + (before.agg(F.max("at")).first()[0] or 0)
        todo = todo.join(before.where("status = 'success'").select("provider", "query_id").distinct(), ["provider", "query_id"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                try:
                    model = plugins.create("judge", r.provider)
                    m = plugins.with_retry(lambda r=r, model=model: model.judge(r.query or "", r.answer or "", r.context or ""), retries)
                    rows.append((r.provider, r.query_id, "success", None, m["faithfulness"], m["answer_relevance"], m["context_relevance"], runs))
                except TimeoutError as e:
                    rows.append((r.provider, r.query_id, "timeout", str(e), None, None, None, runs))
                except Exception as e:  # noqa: BLE001  a failed run is a row of the log
                    rows.append((r.provider, r.query_id, "failed", f"{type(e).__name__}: {e}", None, None, None, runs))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]).astype({c: "float64" for c in ("faithfulness", "answer_relevance", "context_relevance")})

    todo.mapInPandas(run, schema).write.mode("append").parquet(log)
    return latest_by(spark.read.schema(schema).parquet(log), ["provider", "query_id"], ["at"])
