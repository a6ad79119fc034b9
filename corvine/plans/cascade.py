"""Registered queries of list merging, page checks, recovery, verdicts and helper functions; registry.py imports this module."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import cascade, corpus, retrieval
from ..sources.scratch import written
from . import registry as r
from .registry import ORACLES, documents, query, table

# --- lists of several rewrites -----------------------------------------------------------------------------

_SCORED = "scored AS (SELECT query_id, 0 AS list_no, doc_id AS item, score FROM best UNION ALL SELECT query_id, 1, vec_id, score FROM dense)"


def _scored(spark, sf):
    lexical = r.QUERIES["bm25_topk"](spark, sf).select("query_id", F.lit(0).alias("list_no"), F.col("doc_id").alias("item"), "score")
    return lexical.unionByName(r.QUERIES["dense_topk"](spark, sf).select("query_id", F.lit(1).alias("list_no"), F.col("vec_id").alias("item"), "score"))


@query(f"WITH {r._BM25}, {r._DENSE}, {_SCORED} SELECT query_id, item, max(score) AS score FROM scored GROUP BY ALL")
def merge_max(spark, sf):
    return _scored(spark, sf).groupBy("query_id", "item").agg(F.max("score").alias("score"))


@query(f"WITH {r._BM25}, {r._DENSE}, {_SCORED} SELECT query_id, item, arg_max(score, list_no) AS score FROM scored GROUP BY ALL")
def merge_last(spark, sf):
    return _scored(spark, sf).groupBy("query_id", "item").agg(F.max_by("score", "list_no").alias("score"))


#: Each query is asked twice: as it is, and without the second half of its words.
_REWRITES = "(SELECT item_id * 2 + n AS item_id, CASE n WHEN 0 THEN text ELSE array_to_string(string_split(text, ' ')[1:greatest(1, len(string_split(text, ' ')) // 2)], ' ') END AS text FROM benchmark, range(2) t(n))"


def _rewritten(spark, sf):
    """(query_id, rewrite, list_no, item, rank, score): lexical and dense lists of both rewrites; they share the dense one."""
    words = F.split("query", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(words) / 2).cast("int"))), " ")
    asked = r._asked(spark, sf).select("query_id", F.posexplode(F.array("query", half)).alias("n", "query"))
    found = retrieval.bm25_topk(r.lexical(spark, sf), asked.select((F.col("query_id") * 2 + F.col("n")).alias("query_id"), "query"))
    lexical = found.select(F.expr("query_id div 2").alias("query_id"), (F.col("query_id") % 2).cast("int").alias("rewrite"), F.lit(0).alias("list_no"), F.col("doc_id").alias("item"), "rank", "score")
    dense = r._dense(spark, sf).select("query_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("rewrite"), F.lit(1).alias("list_no"), F.col("vec_id").alias("item"), "rank", "score")
    return written(lexical.unionByName(dense), "lists")  # fusions read them several times


@query(f"""WITH {r._BM25.replace("AS tok FROM benchmark", f"AS tok FROM {_REWRITES}")},
fused AS (SELECT query_id // 2 AS query_id, doc_id AS item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(query_id % 2 * 1000 + rank) AS first FROM best GROUP BY ALL)
SELECT query_id, item, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INT) AS pos FROM fused""")
def multi_query_fusion(spark, sf):
    lists = _rewritten(spark, sf).where("list_no = 0").select("query_id", F.col("rewrite").alias("list_no"), "item", "rank")
    return retrieval.rrf(lists).select("query_id", "item", "score", "pos")


@query(f"""WITH {r._BM25}, g AS (SELECT query_id, rank, doc_id % 4 AS grade, row_number() OVER (PARTITION BY query_id ORDER BY doc_id % 4 DESC, rank) AS ideal FROM best)
SELECT query_id, round(CASE WHEN sum((2 ** grade - 1) / log2(ideal + 1.0)) = 0 THEN 0 ELSE sum((2 ** grade - 1) / log2(rank + 1.0)) / sum((2 ** grade - 1) / log2(ideal + 1.0)) END, 6) AS ndcg FROM g GROUP BY query_id""")
def graded_ndcg(spark, sf):
    ranked = r.QUERIES["bm25_topk"](spark, sf).select("query_id", F.col("rank").alias("pos"), (F.col("doc_id") % 4).alias("grade"))
    return retrieval.graded_ndcg(ranked)


@query(f"""WITH {r._RERANKED}, b AS (SELECT query_id, 'overlap' AS backend, doc_id, pos FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) = 1
UNION ALL SELECT query_id, 'fusion', doc_id, pos FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) = 1
UNION ALL SELECT query_id, 'shortest', doc_id, pos FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY -length(text) DESC, pos) = 1) SELECT query_id, backend, doc_id, pos AS candidate_pos FROM b""")
def rerank_benchmark(spark, sf):
    rows = r._candidates(spark, sf).join(retrieval.small(r._asked(spark, sf)), "query_id")
    scorers = {"overlap": retrieval.overlap_score(F.col("query"), F.col("text")), "fusion": F.col("score"), "shortest": -F.length("text").cast("double")}
    return retrieval.compare_scorers(rows, scorers).select("query_id", "backend", "doc_id", "candidate_pos")


@query("""SELECT item_id AS query_id, array_to_string(list_filter(w, lambda x, i: list_position(w, x) = i)[1:5], ' ') AS terms FROM (SELECT item_id, list_filter(string_split(text, ' '), lambda x: trim(x) <> '') AS w FROM benchmark)""")
def rewrite_list(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(text.first_distinct(F.split("text", " "), 5), " ").alias("terms"))


@query("SELECT provider, item_id AS query_id, format('q{:02d}', row_number() OVER (PARTITION BY provider ORDER BY item_id)) AS name FROM benchmark, (VALUES ('left'), ('right')) v(provider)")
def gold_runs(spark, sf):
    numbered = corpus.running_sum(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("one")), [F.col("query_id")], "one", "number")
    return numbered.select(F.explode(F.array(F.lit("left"), F.lit("right"))).alias("provider"), "query_id", F.format_string("q%02d", "number").alias("name"))


# --- pages, fragments, recovery ------------------------------------------------------------------------------


@query(f"WITH {r._PARTS}, {r.LOW} SELECT *, chars < 450 OR short_ratio > 0.55 OR (table_like AND NOT has_table) OR poisoned AS low FROM p")
def low_quality_pages(spark, sf):
    return cascade.low_pages(*r.pages_of(spark, sf))


@query()
def fragment_merging(spark, sf):
    return cascade.merge_fragments(r._files(spark, sf).select("source", "page", F.col("doc_id").alias("ord"), "text"))


@query(f"WITH {r._PARTS}, {r._PAGES} SELECT source, chars_per_page < 450 OR empty_ratio > 0.25 OR short_ratio > 0.55 AS poor FROM stats")
def quality_poor(spark, sf):
    return r.QUERIES["extraction_stats"](spark, sf).select("source", cascade.quality_poor(F.col("chars_per_page"), F.col("empty_ratio"), F.col("short_ratio")).alias("poor"))


_TRIES = """tries AS (SELECT doc_id AS attempt_no, source, doc_id % 97 / 97.0 AS coverage, doc_id % 13 AS n_chunks,
  concat_ws('; ', CASE WHEN doc_id % 97 / 97.0 < 0.85 THEN 'page_coverage<0.85' END, CASE WHEN doc_id % 5 = 0 THEN 'poison_ratio' END) AS reason FROM documents),
st AS (SELECT *, CASE WHEN reason <> '' THEN 'hard_fail' ELSE 'pass' END AS was FROM tries)"""


def _tries(spark, sf):
    i = F.col("doc_id")
    coverage = i % 97 / 97.0
    reason = F.concat_ws("; ", F.when(coverage < 0.85, "page_coverage<0.85"), F.when(i % 5 == 0, "poison_ratio"))
    return documents(spark, sf).select(i.alias("attempt_no"), "source", coverage.alias("coverage"), (i % 13).alias("n_chunks"), reason.alias("reason")).withColumn("status", F.when(F.col("reason") != "", "hard_fail").otherwise("pass"))


@query(f"""WITH {_TRIES}, low AS (SELECT *, was = 'hard_fail' AND n_chunks > 0 AND reason = 'page_coverage<0.85' AS low FROM st)
SELECT attempt_no, low AND coverage < 0.35 AS recover, low AND coverage >= 0.55 AS downgraded, CASE WHEN low AND coverage >= 0.55 THEN 'soft_fail' ELSE was END AS status FROM low""")
def recovery_downgrade(spark, sf):
    return cascade.recovery(_tries(spark, sf)).select("attempt_no", "recover", "downgraded", "status")


@query("""SELECT doc_id, doc_id % 4 IN (0, 1) AS success, doc_id % 4 >= 2 AND doc_id % 3 <> 0 AS timed_out, doc_id % 4 >= 2 AND doc_id % 3 <> 0 AND doc_id % 5 = 0 AS timed_out_empty,
  CAST(CASE WHEN 300 - doc_id % 400 <= 0 THEN 0 ELSE least(45 + doc_id % 200, 180, 300 - doc_id % 400) END AS INT) AS seconds FROM documents""")
def attempt_budget(spark, sf):
    i = F.col("doc_id")
    status = F.when(i % 4 == 0, "pass").when(i % 4 == 1, "soft_fail").otherwise("hard_fail")
    reason = F.when((i % 4 >= 2) & (i % 3 != 0), "Timeout: attempt").when(i % 4 >= 2, "exception: parser")
    flags = text.attempt_flags(status, reason, i % 5)
    return documents(spark, sf).select("doc_id", *[c.alias(n) for n, c in flags.items()], text.resolved_timeout(45 + i % 200, F.lit(180), 300 - i % 400).alias("seconds"))


@query(f"WITH d AS (SELECT doc_id, list_filter(string_split({r.TABLES}, chr(10))[1:80], lambda x: contains(x, '|')) AS l FROM documents) SELECT doc_id, len(l) >= 3 AS table_like FROM d")
def pdf_table_like(spark, sf):
    tabled = F.when(F.floor(F.col("doc_id") / 20) % 5 == 0, F.replace("text", F.lit(" "), F.lit(" | "))).otherwise(F.regexp_replace("text", r"[ \t]+", " "))
    return documents(spark, sf).select("doc_id", text.looks_like_pdf_table(tabled).alias("table_like"))


@query()
def chunk_dispatch(spark, sf):
    kinds = documents(spark, sf).select("doc_id", "text", F.when(text.looks_like_table(F.col("text")), "table").otherwise("text").alias("kind"))
    return chunking.chunk_long(kinds, "text", "kind").drop("text", "kind")


@query(r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[ \t\n\r\f]+|[ \t\n\r\f]+$', '', 'g') AS t FROM documents),
m AS (SELECT *, length(t) AS n, length(t) // 2 AS mid, least(400, greatest(40, length(t) // 10)) AS w FROM d),
s AS (SELECT *, substring(t, greatest(1, mid - w) + 1, mid - greatest(1, mid - w) + 1) AS back, substring(t, mid + 2, least(n - 1, mid + w) - mid) AS ahead FROM m),
c AS (SELECT *, CASE WHEN regexp_matches(back, '\s') THEN mid - length(regexp_extract(back, '\s(\S*)$', 1)) WHEN regexp_matches(ahead, '\s') THEN mid + 1 + length(regexp_extract(ahead, '^\S*')) ELSE mid END AS cut FROM s),
h AS (SELECT doc_id, CASE WHEN n <= 2 THEN t ELSE regexp_replace(substring(t, 1, cut), '[ \t\n\r\f]+$', '') END AS a, CASE WHEN n <= 2 THEN '' ELSE regexp_replace(substring(t, cut + 1), '^[ \t\n\r\f]+', '') END AS b FROM c)
SELECT doc_id, CAST(length(a) AS INT) AS n_left, CAST(length(b) AS INT) AS n_right, sha256(a || '|' || b) AS halves_sha256 FROM h""")
def embedding_halves(spark, sf):
    left, right = text.halves(F.col("text"))
    return documents(spark, sf).select("doc_id", F.length(left).alias("n_left"), F.length(right).alias("n_right"), F.sha2(F.concat(left, F.lit("|"), right), 256).alias("halves_sha256"))


_REPLIES = ('["a", "b"]', 'Sure: ["x y", "", "z"] done', "no list here", '{"k": 1}')


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'a,b' WHEN 1 THEN 'x y,z' ELSE '' END AS items FROM events")
def reply_lists(spark, sf):
    reply = F.element_at(F.array(*[F.lit(x) for x in _REPLIES]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf, "events").select("event_id", F.array_join(text.json_list(reply), ",").alias("items"))


@query("SELECT event_id, event_id % 3 <> 0 AS too_long, CASE WHEN event_id % 3 = 1 AND event_id % 40 < 32 THEN CAST(event_id % 40 AS INT) END AS item FROM events")
def token_limit_items(spark, sf):
    i = F.col("event_id")
    message = F.when(i % 3 == 0, "Bad request").when(i % 3 == 1, F.concat(F.lit("Tokens limit exceeded at index "), (i % 40).cast("string"), F.lit(" : too long"))).otherwise("RequestEntityTooLargeError")
    return table(spark, sf, "events").select("event_id", text.token_limit(message).alias("too_long"), text.offending_index(message, F.lit(32)).alias("item"))


# --- runs and verdicts ------------------------------------------------------------------------------------------


@query(f"WITH {r._LOG} SELECT provider, count(*) AS processed, count(*) FILTER (status = 'success') AS ok, count(*) FILTER (status <> 'success') AS failed, count(DISTINCT user_id) AS users, 1000000 - count(*) AS remaining FROM log GROUP BY provider")
def run_summary(spark, sf):
    ok = F.col("status") == "success"
    return r._events(spark, sf).groupBy("provider").agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.count_distinct("user_id").alias("users"), (F.lit(1_000_000) - F.count(F.lit(1))).alias("remaining"))


@query(f"WITH {r._LATEST} SELECT provider, query_id, status FROM lat WHERE status <> 'success'")
def provider_failures(spark, sf):
    return r._latest(spark, sf).where("status <> 'success'").select("provider", "query_id", "status")


@query(f"""WITH {r._LOG}, v AS (SELECT count(*) AS total, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status <> 'success' AND status <> 'timeout' AND message = 'Invalid RAGAS score: 2') AS fatal FROM log)
SELECT *, CASE WHEN total > 0 AND completed = total THEN 'PASS' WHEN fatal > 0 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS verdict FROM v""")
def ci_verdict(spark, sf):
    _, again = text.failure_class(F.col("status"), F.col("message"))
    return cascade.run_verdict(r._events(spark, sf).withColumn("again", again))


@query(f"""WITH {r._LATEST}, k AS (SELECT 'documents' AS name, count(*) > 0 AS ok, true AS mandatory FROM documents UNION ALL SELECT 'labels', count(DISTINCT quality) = 2, true FROM labels
UNION ALL SELECT 'success', count(*) FILTER (status = 'success') > 0, true FROM lat UNION ALL SELECT 'no_failures', count(*) FILTER (status <> 'success') = 0, false FROM lat)
SELECT coalesce(string_agg(name, ',' ORDER BY name) FILTER (NOT ok), '') AS failed, CASE WHEN count(*) FILTER (mandatory AND NOT ok) > 0 THEN 'Not ready' WHEN count(*) FILTER (NOT ok) > 0 THEN 'Conditionally ready' ELSE 'Ready' END AS verdict FROM k""")
def readiness_verdict(spark, sf):
    check = lambda rows, name, ok, must: rows.agg(F.lit(name).alias("name"), ok.alias("ok"), F.lit(must).alias("mandatory"))
    runs = r._latest(spark, sf)
    checks = check(documents(spark, sf), "documents", F.count(F.lit(1)) > 0, True).unionByName(check(table(spark, sf, "labels"), "labels", F.count_distinct("quality") == 2, True))
    checks = checks.unionByName(check(runs, "success", F.count_if(F.col("status") == "success") > 0, True)).unionByName(check(runs, "no_failures", F.count_if(F.col("status") != "success") == 0, False))
    return cascade.readiness(checks)


@query("SELECT DISTINCT 'demo' AS origin, source AS path FROM documents UNION ALL SELECT DISTINCT 'upload', url FROM pages")
def source_union(spark, sf):
    demo = documents(spark, sf).select(F.lit("demo").alias("origin"), F.col("source").alias("path")).distinct()
    return demo.unionByName(table(spark, sf, "pages").select(F.lit("upload").alias("origin"), F.col("url").alias("path")).distinct())


@query("""SELECT source, n_docs, round(quality, 6) AS quality FROM (SELECT source, count(*) AS n_docs, avg(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""")
def stats_table(spark, sf):
    """The report on all files; its page sorts and filters by any column, by default by none."""
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("quality").alias("q"))
    return corpus.report(rows.select("source", "n_docs", F.round("q", 6).alias("quality")))


@query("""SELECT source, n_docs, round(quality, 6) AS quality FROM (SELECT source, count(*) AS n_docs, avg(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) WHERE n_docs >= 2 AND contains(lower(source), '1')""")
def stats_table_filtered(spark, sf):
    rows = documents(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.avg("quality").alias("q"))
    return corpus.report(rows.select("source", "n_docs", F.round("q", 6).alias("quality")), [F.col("n_docs") >= 2, F.lower("source").contains("1")], ["-quality", "source"])


@query(f"""WITH {r._BM25.replace("AS tok FROM benchmark", f"AS tok FROM {_REWRITES}")}, {r._DENSE},
l AS MATERIALIZED (SELECT query_id // 2 AS query_id, query_id % 2 AS rewrite, 0 AS list_no, doc_id AS item, rank, score FROM best UNION ALL SELECT query_id, n, 1, vec_id, rank, score FROM dense, range(2) t(n)),
i1 AS (SELECT query_id, rewrite, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS s, min((rewrite * 2 + list_no) * 1000 + rank) AS first FROM l GROUP BY ALL),
i2 AS (SELECT query_id, rewrite, item FROM i1 QUALIFY row_number() OVER (PARTITION BY query_id, rewrite ORDER BY s DESC, first) <= 10),
kept AS (SELECT query_id, item, coalesce(max(score) FILTER (list_no = 0), 0) AS bm25_score, coalesce(max(score) FILTER (list_no = 1), 0) AS dense_score FROM l SEMI JOIN i2 ON l.query_id = i2.query_id AND l.rewrite = i2.rewrite AND l.item = i2.item GROUP BY ALL),
o1 AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min((rewrite * 2 + list_no) * 1000 + rank) AS first FROM l GROUP BY ALL), o2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS p FROM o1 QUALIFY p <= 10)
SELECT query_id, item, score, bm25_score, dense_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY p) AS INT) AS pos FROM o2 JOIN kept USING (query_id, item)""")
def ask_candidates(spark, sf):
    return retrieval.two_level(_rewritten(spark, sf))


ORACLES["rehydrated_candidates"] = ORACLES["ask_candidates"].replace("SELECT query_id, item, score, bm25_score, dense_score,", "SELECT query_id, item, score, coalesce(bm25_score, 0) AS bm25_score, coalesce(dense_score, 0) AS dense_score,").replace("o2 JOIN kept", "o2 LEFT JOIN kept")


@query()
def rehydrated_candidates(spark, sf):
    return retrieval.two_level(_rewritten(spark, sf), drop=False)
