"""Registered queries over the driver's tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chunking, text
from ..operators import cascade, corpus, retrieval
from ..sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
_RAW = r"regexp_extract_all(coalesce({0}, ''), '[\p{{L}}\p{{N}}_\-]+')"
_DIGITS = r"length(regexp_replace(t, '[^\p{Nd}]', '', 'g'))"


def _tokens(column: str = "text") -> str:
    return (
        f"list_filter(list_transform({_RAW.format(column)}, lambda t: trim(replace(lower(t), 'ё', 'е'), '-_')), "
        rf"lambda t: length(t) >= 2 AND t NOT IN ({_STOP}) AND NOT ({_DIGITS} > 0 AND {_DIGITS} >= length(t) * 0.6) AND regexp_matches(t, '\p{{L}}'))"
    )


_WS = r"trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g'))"
#: Derived texts for features that the tables lack.
POISON = "CASE WHEN doc_id % 7 = 0 THEN replace(text, ' ', chr(92) || 'n') ELSE text END"
TABLES = "CASE WHEN doc_id // 20 % 5 = 0 THEN replace(text, ' ', ' | ') ELSE text END"


# --- scalar text functions -----------------------------------------------------------------------------


@query(f"SELECT doc_id, array_to_string({_tokens()}, ' ') AS toks FROM documents")
def text_tokenize(spark, sf):
    return documents(spark, sf).select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("toks"))


@query(f"SELECT doc_id, CAST(len({_RAW.format('text')}) AS INT) AS n_raw, CAST(len({_tokens()}) AS INT) AS n_tokens FROM documents")
def text_token_stats(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(text.raw_tokens(F.col("text"))).alias("n_raw"), F.size(text.tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT doc_id, {_WS.format('text')} AS norm, lower({_WS.format('text')}) AS key FROM documents")
def text_normalize_ws(spark, sf):
    return documents(spark, sf).select("doc_id", text.normalize_ws(F.col("text")).alias("norm"), text.text_key(F.col("text")).alias("key"))


@query("""SELECT doc_id, array_to_string(list_distinct_ordered, ',') AS years FROM (
  SELECT doc_id, list_filter(string_split_regex('/corpus/' || source || '_' || (2015 + doc_id % 10) || '_' || doc_id || '_1999.txt', '[^0-9]+'), lambda y: regexp_full_match(y, '(19|20)[0-9]{2}')) AS l,
         list_filter(l, lambda y, i: list_position(l, y) = i) AS list_distinct_ordered FROM documents)""")
def text_years(spark, sf):
    path = F.concat(F.lit("/corpus/"), "source", F.lit("_"), (2015 + F.col("doc_id") % 10).cast("string"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("_1999.txt"))
    return documents(spark, sf).select("doc_id", F.array_join(text.years(path), ",").alias("years"))


@query(rf"""WITH d AS (SELECT doc_id, {POISON} AS t FROM documents)
SELECT doc_id, round(len(regexp_extract_all(t, '\\[nrt]|\\x[0-9a-fA-F]{{2}}|\\u[0-9a-fA-F]{{4}}')) * 1000.0 / greatest(1, length(t)), 6) AS escaped_per_1k,
       round((length(t) - length(replace(t, chr(92), ''))) * 1000.0 / greatest(1, length(t)), 6) AS backslash_per_1k, CAST(0 AS DOUBLE) AS control_ratio FROM d""")
def text_poison_signals(spark, sf):
    poisoned = F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit(" "), F.lit("\\n"))).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", *[F.round(c, 6).alias(n) for n, c in text.poison_signals(poisoned).items()])


@query(f"""WITH d AS (SELECT doc_id, list_filter(string_split({TABLES}, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, len(l) >= 5 AND len(list_filter(l[1:60], lambda x: contains(x, '|') OR contains(x, chr(9)) OR len(list_filter(string_split_regex(trim(x), ' {{2,}}'), lambda p: p <> '')) >= 3)) >= 4 AS table_like FROM d""")
def text_table_like(spark, sf):
    tabled = F.when(F.floor(F.col("doc_id") / 20) % 5 == 0, F.replace("text", F.lit(" "), F.lit(" | "))).otherwise(F.col("text"))
    return documents(spark, sf).select("doc_id", text.looks_like_table(tabled).alias("table_like"))


@query(r"""SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '_', 'g'), '._-'), 60), ''), 'file') AS slug FROM documents""")
def text_slug(spark, sf):
    return documents(spark, sf).select("doc_id", text.slug(F.col("text")).alias("slug"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def hash_content(spark, sf):
    return documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("content_hash"))


_ERRORS = "CASE event_type WHEN 'error' THEN 'HTTP 503 Service Unavailable' WHEN 'view' THEN 'Read timeout at host' WHEN 'click' THEN 'Too Many Requests (429)' WHEN 'signup' THEN 'Invalid RAGAS score: 2' ELSE 'LLMDidNotFinish' END"


def _events(spark, sf):
    kinds = F.col("event_type")
    message = F.when(kinds == "error", "HTTP 503 Service Unavailable").when(kinds == "view", "Read timeout at host").when(kinds == "click", "Too Many Requests (429)").when(kinds == "signup", "Invalid RAGAS score: 2").otherwise("LLMDidNotFinish")
    status = F.when(kinds == "error", "failed").when(kinds == "view", "timeout").otherwise("success")
    metric = text.clamp_score(F.col("value") / 100)
    provider = F.when(F.col("event_id") % 2 == 0, "left").otherwise("right")
    return table(spark, sf, "events").select("event_id", "user_id", "ts", "value", "props", kinds, message.alias("message"), status.alias("status"), metric.alias("metric"), provider.alias("provider"))


_LOG = f"""log AS (SELECT event_id, user_id, ts, value, props, {_ERRORS} AS message, CASE event_type WHEN 'error' THEN 'failed' WHEN 'view' THEN 'timeout' ELSE 'success' END AS status,
  least(greatest(value / 100, 0), 1) AS metric, CASE WHEN event_id % 2 = 0 THEN 'left' ELSE 'right' END AS provider FROM events)"""


@query(f"""WITH {_LOG} SELECT event_id, CASE WHEN status = 'timeout' THEN 'timeout' WHEN message = 'Invalid RAGAS score: 2' THEN 'ragas_validation' WHEN message = 'LLMDidNotFinish' THEN 'llm_did_not_finish'
  WHEN message LIKE 'Too Many%' THEN 'rate_limit' WHEN message LIKE 'HTTP 503%' THEN 'server_5xx' ELSE 'failed' END AS code, status = 'timeout' OR message <> 'Invalid RAGAS score: 2' AS again,
  message IN ('HTTP 503 Service Unavailable', 'Read timeout at host', 'Too Many Requests (429)') AS retryable FROM log""")
def classify_failure(spark, sf):
    code, again = text.failure_class(F.col("status"), F.col("message"))
    return _events(spark, sf).select("event_id", code.alias("code"), again.alias("again"), text.is_retryable(F.col("message")).alias("retryable"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0 ELSE round(least(greatest(value / 100 - 0.5, 0), 1), 6) END AS score FROM events")
def score_clamp(spark, sf):
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value") / 100 - 0.5)
    return table(spark, sf, "events").select("event_id", F.round(text.clamp_score(raw), 6).alias("score"))


@query("""SELECT doc_id, CAST(least(greatest(CASE WHEN doc_id % 3 = 0 THEN floor((45 + ceil(n_chars / 100) * 30 + ceil(n_chars / 1000 / 10) * 20) * 1.8)
  ELSE 45 + ceil(n_chars / 100) * 30 + ceil(n_chars / 1000 / 10) * 20 END, 15), 600) AS INT) AS timeout_sec FROM documents""")
def adaptive_timeout(spark, sf):
    return documents(spark, sf).select("doc_id", text.adaptive_timeout(F.col("n_chars"), F.col("n_chars") / 1000, F.col("doc_id") % 3 == 0).alias("timeout_sec"))


# --- chunking --------------------------------------------------------------------------------------------

_CHARS = r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS chunk_ord, chunk FROM (
  SELECT doc_id, k, regexp_replace(substring(t, k * 800 + 1, 1000), '^\s+|\s+$', '', 'g') AS chunk
  FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents), unnest(range(0, CASE WHEN length(t) <= 1000 THEN 1 ELSE CAST(ceil((length(t) - 1000) / 800.0) AS INT) + 1 END)) AS u(k)) WHERE chunk <> ''"""


@query(_CHARS)
def chunk_chars(spark, sf):
    return chunking.chunked(documents(spark, sf).select("doc_id", "text"), chunking.char_chunks(F.col("text"))).drop("text")


_TOKEN_CHUNKS = rf"""WITH d AS (SELECT doc_id, text, {_RAW.format('text')} AS r, regexp_extract_all(text, '[\p{{L}}\p{{N}}_\-]+[^\p{{L}}\p{{N}}_\-]*') AS u FROM documents)
SELECT doc_id, CAST(k AS INT) AS chunk_ord, CASE WHEN len(r) <= 60 THEN {_WS.format('text')} ELSE
  {_WS.format("array_to_string(u[k * 50 + 1:least(k * 50 + 60, len(r)) - 1], '') || r[least(k * 50 + 60, len(r))]")} END AS chunk
FROM d, unnest(range(0, CASE WHEN len(r) <= 60 THEN 1 ELSE CAST(ceil((len(r) - 60) / 50.0) AS INT) + 1 END)) AS t(k) WHERE len(r) > 0"""


@query(_TOKEN_CHUNKS)
def chunk_tokens(spark, sf):
    return chunking.chunked(documents(spark, sf).select("doc_id", "text"), chunking.token_chunks(F.col("text"), 60, 10)).drop("text")


@query(rf"""WITH s AS (SELECT doc_id, n, x AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents) WHERE trim(x) <> ''),
d AS (SELECT doc_id, n, text, {_RAW.format('text')} AS r, regexp_extract_all(text, '[\p{{L}}\p{{N}}_\-]+[^\p{{L}}\p{{N}}_\-]*') AS u FROM s)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INT) AS chunk_ord, CASE WHEN len(r) <= 60 THEN {_WS.format('text')} ELSE
  {_WS.format("array_to_string(u[k * 50 + 1:least(k * 50 + 60, len(r)) - 1], '') || r[least(k * 50 + 60, len(r))]")} END AS chunk
FROM d, unnest(range(0, CASE WHEN len(r) <= 60 THEN 1 ELSE CAST(ceil((len(r) - 60) / 50.0) AS INT) + 1 END)) AS t(k)""")
def chunk_sections(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return chunking.section_chunks(docs, "text", 60, 10).drop("text")


@query()
def table_chunking(spark, sf):
    return chunking.table_chunks(documents(spark, sf).select("doc_id", "text"), "text", 30, 6).drop("text")


def _files(spark, sf):
    """Each source is a file, each document a chunk of it on page k % 10 + 1."""
    k = F.floor(F.col("doc_id") / 20)
    return documents(spark, sf).select("doc_id", "source", (k % 10 + 1).cast("int").alias("page"), "text", F.sha2("text", 256).alias("content_hash"))


_FILES = "f AS (SELECT doc_id, source, CAST(doc_id // 20 % 10 + 1 AS INT) AS page, text, sha256(text) AS content_hash FROM documents)"


@query(f"WITH {_FILES} SELECT doc_id, left(sha256(source || '|h|' || coalesce(CAST(nullif(page, 3) AS VARCHAR), 'None') || '|text|' || content_hash), 24) AS chunk_id FROM f")
def chunk_ids(spark, sf):
    page = F.nullif(F.col("page"), F.lit(3))
    return _files(spark, sf).select("doc_id", corpus.chunk_id(F.col("source"), F.lit("h"), page, F.lit("text"), F.col("content_hash")).alias("chunk_id"))


@query(f"WITH {_FILES} SELECT source, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY doc_id) = 1")
def dedup_within_source(spark, sf):
    return corpus.dedup_within(_files(spark, sf), "source", "content_hash", ["doc_id"]).select("source", "doc_id")


@query("SELECT count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct, count(*) - count(DISTINCT sha256(text)) AS n_repeats FROM documents")
def duplicate_hash_counts(spark, sf):
    h = F.sha2("text", 256)
    return documents(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(h).alias("n_distinct"), (F.count(F.lit(1)) - F.count_distinct(h)).alias("n_repeats"))


# --- retrieval ---------------------------------------------------------------------------------------------

_BM25 = f"""toks AS MATERIALIZED (SELECT doc_id, unnest({_tokens()}) AS tok FROM documents),
tf AS MATERIALIZED (SELECT doc_id, tok, count(*) AS tf FROM toks GROUP BY ALL), dl AS (SELECT doc_id, count(*) AS dl FROM toks GROUP BY ALL),
st AS (SELECT count(*) AS n, (SELECT count(*) FROM toks) / CAST(count(*) AS DOUBLE) AS avgdl FROM documents),
raw AS MATERIALIZED (SELECT tok, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY tok),
idf AS (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, (SELECT avg(raw) AS mean FROM raw)),
asked AS (SELECT item_id AS query_id, tok, count(*) AS qtf FROM (SELECT item_id, unnest({_tokens()}) AS tok FROM benchmark) GROUP BY ALL),
bm25 AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN tf USING (tok) JOIN idf USING (tok) JOIN dl USING (doc_id), st GROUP BY ALL),
every AS (SELECT query_id, doc_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM asked) CROSS JOIN (SELECT doc_id FROM documents) LEFT JOIN bm25 USING (query_id, doc_id)),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM every QUALIFY rank <= 10)"""


_INDEX: dict[tuple[str, str], str] = {}


def lexical(spark, sf):
    """The lexical index of documents: built once a session, read by every query that ranks them."""
    at = spark.sparkContext.applicationId, sf
    if at in _INDEX:
        try:
            return spark.read.parquet(_INDEX[at])
        except AnalysisException:  # the folder was cleared
            del _INDEX[at]
    index = written(retrieval.lexical_index(documents(spark, sf)), "lexical")
    if index.inputFiles():
        _INDEX[at] = index.inputFiles()[0].rpartition("/")[0]
    return index


def _asked(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


@query(f"WITH {_BM25} SELECT tok, df, round(idf, 6) AS idf FROM idf")
def bm25_stats(spark, sf):
    return retrieval.bm25_stats(lexical(spark, sf))[1].select("tok", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM best")
def bm25_topk(spark, sf):
    return retrieval.bm25_topk(lexical(spark, sf), _asked(spark, sf)).select("query_id", "doc_id", "score", "rank")


#: Each query is one word of its passage, the last: few documents or none have it, the rest of the list is padding.
_RARE = "(SELECT item_id, string_split(text, ' ')[-1] || ' zzunknown' AS text FROM benchmark)"


@query(f"""WITH {_BM25.replace("AS tok FROM benchmark", f"AS tok FROM {_RARE}")} SELECT query_id, doc_id, score, rank FROM best""")
def bm25_padded(spark, sf):
    last = F.concat(F.element_at(F.split("query", " "), -1), F.lit(" zzunknown"))
    return retrieval.bm25_topk(lexical(spark, sf), _asked(spark, sf).withColumn("query", last)).select("query_id", "doc_id", "score", "rank")


#: Every vector whose id is divisible by 100 is a query against all vectors; it is the vector of the benchmark item of a hundredth of its id.
_DENSE = """dense AS (SELECT q.vec_id // 100 AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS INT) AS rank
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10)"""


def _dense(spark, sf):
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.col("embedding").alias("qvec"))
    return retrieval.dense_topk(vectors, asked)


@query(f"WITH {_DENSE} SELECT query_id, vec_id, score, rank FROM dense")
def dense_topk(spark, sf):
    return _dense(spark, sf).select("query_id", "vec_id", "score", "rank")


@query("""WITH d AS (SELECT max(len(embedding)) AS dim FROM embeddings), q AS (SELECT vec_id AS query_id, CASE vec_id % 3 WHEN 0 THEN len(embedding) WHEN 1 THEN least(5, len(embedding)) ELSE 0 END AS n FROM embeddings)
SELECT query_id, CASE WHEN n <> dim THEN format('dense_dim_mismatch:query={},index={}', n, dim) END AS reason FROM q, d""")
def dense_reasons(spark, sf):
    vectors = table(spark, sf, "embeddings")
    cut = F.when(F.col("vec_id") % 3 == 0, F.col("embedding")).when(F.col("vec_id") % 3 == 1, F.slice("embedding", 1, 5))
    return retrieval.dense_reasons(vectors, vectors.select(F.col("vec_id").alias("query_id"), cut.alias("qvec")))


_LISTS = "lists AS (SELECT query_id, 0 AS list_no, doc_id AS item, rank FROM best UNION ALL SELECT query_id, 1, vec_id, rank FROM dense)"
_FUSED = """fused AS (SELECT query_id, item, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS first FROM lists GROUP BY ALL),
ranked AS (SELECT query_id, item, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first) AS INT) AS pos FROM fused)"""


def _lists(spark, sf):
    lexical = QUERIES["bm25_topk"](spark, sf).select("query_id", F.lit(0).alias("list_no"), F.col("doc_id").alias("item"), "rank")
    return lexical.unionByName(_dense(spark, sf).select("query_id", F.lit(1).alias("list_no"), F.col("vec_id").alias("item"), "rank"))


@query(f"WITH {_BM25}, {_DENSE}, {_LISTS}, {_FUSED} SELECT query_id, item, score, pos FROM ranked")
def rrf_fusion(spark, sf):
    return retrieval.rrf(_lists(spark, sf)).select("query_id", "item", "score", "pos")


_CANDIDATES = f"""{_BM25}, {_DENSE}, {_LISTS}, {_FUSED},
cand AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INT) AS pos, doc_id, score, source, text, 2015 + doc_id % 10 AS year FROM ranked JOIN documents ON doc_id = item)"""


def _candidates(spark, sf):
    docs = documents(spark, sf).select(F.col("doc_id").alias("item"), "source", "text")
    # Broadcast if they are few, so that texts are not shuffled for them.
    found = retrieval.small(written(retrieval.rrf(_lists(spark, sf)), "fused")).join(docs, "item")
    return found.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).alias("pos"), F.col("item").alias("doc_id"), "score", "source", "text", (2015 + F.col("item") % 10).alias("year"))


@query(f"WITH {_CANDIDATES} SELECT query_id, pos, doc_id, score, source FROM cand")
def hybrid_retrieve(spark, sf):
    return _candidates(spark, sf).select("query_id", "pos", "doc_id", "score", "source")


@query(f"""WITH {_CANDIDATES}, m AS (SELECT *, year = 2015 + query_id % 10 AND count(*) OVER (PARTITION BY query_id) > 1 AS boosted FROM cand),
a AS (SELECT *, bool_or(boosted) OVER (PARTITION BY query_id) AS hit_any FROM m)
SELECT query_id, doc_id, boosted, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN hit_any THEN score + CASE WHEN boosted THEN 0.12 ELSE 0 END END DESC, pos) AS INT) AS pos FROM a""")
def year_boost(spark, sf):
    rows = _candidates(spark, sf).withColumns({"query_years": F.array((2015 + F.col("query_id") % 10).cast("string")), "source_years": F.array(F.col("year").cast("string"))})
    return retrieval.year_boost(rows).select("query_id", "doc_id", "boosted", "pos")


@query(f"""WITH {_CANDIDATES}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY pos) AS nth, min(pos) OVER (PARTITION BY query_id, source) AS seen FROM cand)
SELECT query_id, doc_id, rn AS pos FROM (SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY nth > 1, CASE WHEN nth > 1 THEN pos ELSE nth END, seen) AS INT) AS rn FROM n) WHERE rn <= 8""")
def source_diversity(spark, sf):
    return retrieval.source_diversity(_candidates(spark, sf), cap=1, k=8).select("query_id", "doc_id", "pos")


_RERANKED = f"""{_CANDIDATES}, qs AS (SELECT item_id AS query_id, list_distinct({_tokens()}) AS q FROM benchmark),
sc AS (SELECT cand.*, round(len(list_intersect(q, {_tokens('text')})) / CAST(greatest(len(q), 1) AS DOUBLE), 6) AS rerank_score FROM cand JOIN qs USING (query_id)),
rer AS (SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS INT) AS pos) FROM sc),
ten AS (SELECT * FROM rer WHERE pos <= 10)"""


def _reranked(spark, sf, n=10):
    rows = _candidates(spark, sf).join(retrieval.small(_asked(spark, sf)), "query_id")
    return retrieval.rerank(rows, retrieval.overlap_score(F.col("query"), F.col("text")), n)


@query(f"WITH {_RERANKED} SELECT query_id, doc_id, pos, rerank_score FROM ten")
def rerank_topn(spark, sf):
    return _reranked(spark, sf).select("query_id", "doc_id", "pos", "rerank_score")


@query(f"WITH {_RERANKED} SELECT query_id, doc_id, pos FROM ten WHERE pos <= 5")
def final_topk(spark, sf):
    return _reranked(spark, sf, 5).select("query_id", "doc_id", "pos")


@query(f"""WITH {_RERANKED}, y AS (SELECT *, year = 2015 + query_id % 10 AS hit FROM ten),
m AS (SELECT *, bool_or(hit) FILTER (pos <= 3) OVER w AS kept, min(pos) FILTER (pos > 3 AND hit) OVER w AS cand_pos, max(pos) FILTER (pos <= 3) OVER w AS last, max(CASE WHEN pos = least(3, 10) THEN rerank_score END) OVER w AS cut3 FROM y WINDOW w AS (PARTITION BY query_id)),
p AS (SELECT *, coalesce(pos = cand_pos AND NOT kept AND cut3 - rerank_score <= 0.35, false) AS promoted FROM m), s AS (SELECT *, bool_or(promoted) OVER (PARTITION BY query_id) AS swap FROM p)
SELECT query_id, doc_id, promoted, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, pos) AS INT) AS pos FROM s WHERE promoted OR (pos <= 3 AND NOT (swap AND pos = last AND last >= 3))""")
def year_retention(spark, sf):
    rows = _reranked(spark, sf).withColumn("year_hit", F.col("year") == 2015 + F.col("query_id") % 10)
    return retrieval.year_retention(rows, 3).select("query_id", "doc_id", "promoted", "pos")


@query(f"""WITH {_RERANKED}, fin AS (SELECT * FROM ten WHERE pos <= 5 AND query_id % 7 <> 0 AND (query_id % 7 <> 1 OR pos <= 2)),
g AS (SELECT b.item_id AS query_id, count(fin.pos) AS n_chunks, arg_min(rerank_score, fin.pos) AS top_score, CAST(coalesce(sum(length(fin.text)), 0) AS BIGINT) AS chars,
  CASE b.item_id % 4 WHEN 0 THEN 1.8 WHEN 1 THEN 0.85 WHEN 2 THEN 0.75 ELSE CASE WHEN abs(arg_min(rerank_score, fin.pos)) <= 1.5 THEN 0.75 ELSE 4.5 END END::DOUBLE AS thr FROM benchmark b LEFT JOIN fin ON fin.query_id = b.item_id GROUP BY b.item_id)
SELECT query_id, n_chunks, top_score, chars, CASE WHEN n_chunks = 0 THEN 'no_context' WHEN n_chunks < 3 THEN 'too_few_chunks:' || n_chunks WHEN top_score < thr THEN 'low_rerank_score:' || round(top_score, 4)::DOUBLE || '<thr:' || thr WHEN chars < 800 THEN 'low_context_chars:' || chars END AS reason FROM g""")
def grounding_guardrail(spark, sf):
    """Finals of some queries are taken away, so that every reason is met; each query has one of four re-rankers."""
    i = F.col("query_id")
    finals = _reranked(spark, sf, 5).where((i % 7 != 0) & ((i % 7 != 1) | (F.col("pos") <= 2)))
    backends = F.when(i % 4 == 0, "amberoad").when(i % 4 == 1, " BGE_m3").when(i % 4 == 2, "jina_multilingual").otherwise("other")
    return retrieval.grounding(finals, _asked(spark, sf).select("query_id", backends.alias("backend")))


@query(f"""WITH {_RERANKED} SELECT query_id, string_agg('[S' || pos || '] source=' || source || ', page=' || (doc_id // 20 % 10 + 1) || chr(10) || text, chr(10) || chr(10) ORDER BY pos) AS context FROM ten WHERE pos <= 5 GROUP BY ALL""")
def answer_context(spark, sf):
    page = (F.floor(F.col("doc_id") / 20) % 10 + 1).cast("int")
    return retrieval.answer_context(_reranked(spark, sf, 5).withColumn("page", page))


@query(f"WITH {_RERANKED} SELECT query_id, string_agg(source || ':' || doc_id, ',' ORDER BY pos) AS citations FROM ten WHERE pos <= 5 GROUP BY ALL")
def citations(spark, sf):
    cited = _reranked(spark, sf, 5).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("pos", "source", "doc_id"))).alias("c"))
    return cited.select("query_id", F.array_join(F.transform("c", lambda x: F.concat(x["source"], F.lit(":"), x["doc_id"].cast("string"))), ",").alias("citations"))


_GOLD = f"""gold AS (SELECT DISTINCT query_id, item FROM (SELECT b.item_id AS query_id, d.doc_id AS item FROM benchmark b JOIN documents d ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)),
hits AS (SELECT query_id, doc_id AS item, rank AS pos FROM best SEMI JOIN gold ON best.query_id = gold.query_id AND best.doc_id = gold.item),
agg AS (SELECT query_id, count(DISTINCT item) AS found, min(pos) AS first, sum(1 / log2(pos + 1.0)) AS dcg FROM hits GROUP BY ALL),
met AS (SELECT query_id, round(coalesce(found, 0) / CAST(n AS DOUBLE), 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM (SELECT query_id, count(*) AS n FROM gold GROUP BY ALL) LEFT JOIN agg USING (query_id))"""


def _metrics(spark, sf):
    """Gold by rule: the documents whose id leaves the query's id modulo the number of queries."""
    ranked = QUERIES["bm25_topk"](spark, sf).select("query_id", F.col("doc_id").alias("item"), F.col("rank").alias("pos"))
    count = table(spark, sf, "benchmark").agg(F.count(F.lit(1)).alias("n"))
    items = documents(spark, sf).crossJoin(F.broadcast(count)).select(F.expr("doc_id % n").alias("query_id"), F.col("doc_id").alias("item"))
    return retrieval.retrieval_metrics(ranked, items.join(_asked(spark, sf).select("query_id"), "query_id"))


@query(f"WITH {_BM25}, {_GOLD} SELECT query_id, recall FROM met")
def recall_at_k(spark, sf):
    return _metrics(spark, sf).select("query_id", "recall")


@query(f"WITH {_BM25}, {_GOLD} SELECT query_id, rr FROM met")
def mrr(spark, sf):
    return _metrics(spark, sf).select("query_id", "rr")


@query(f"WITH {_BM25}, {_GOLD} SELECT query_id, ndcg FROM met")
def ndcg_at_k(spark, sf):
    return _metrics(spark, sf).select("query_id", "ndcg")


@query(f"WITH {_BM25}, {_GOLD} SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met")
def eval_summary(spark, sf):
    return _metrics(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))


@query(f"""WITH {_CANDIDATES}, gs AS (SELECT DISTINCT item_id AS query_id, source AS item FROM benchmark, (SELECT DISTINCT source FROM documents) WHERE contains(lower(source), 'src' || (item_id % 20))),
src AS (SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY first) AS pos FROM (SELECT query_id, source AS item, min(pos) AS first FROM cand GROUP BY ALL)),
h AS (SELECT src.query_id, count(*) FILTER (pos <= 10) AS found, min(pos) AS first, sum(1 / log2(pos + 1.0)) FILTER (pos <= 10) AS dcg FROM src SEMI JOIN gs ON src.query_id = gs.query_id AND src.item = gs.item GROUP BY ALL),
m AS (SELECT round(coalesce(found, 0) / n::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM (SELECT query_id, count(*) AS n FROM gs GROUP BY ALL) LEFT JOIN h USING (query_id)),
a AS (SELECT count(*) AS n, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM m) SELECT *, recall >= 0.55 AND mrr >= 0.45 AND ndcg >= 0.5 AS ok FROM a""")
def quality_gate(spark, sf):
    """Measured on the distinct sources of the retriever's candidates, against the sources that the gold patterns name."""
    ranked = retrieval.by_source(_candidates(spark, sf))
    gold = QUERIES["gold_pattern_match"](spark, sf).withColumnRenamed("source", "item")
    metrics = retrieval.retrieval_metrics(ranked, gold)
    return retrieval.gate(metrics.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg")))


@query("SELECT DISTINCT item_id AS query_id, source FROM benchmark, (SELECT DISTINCT source FROM documents) WHERE contains(lower(source), 'src' || (item_id % 20))")
def gold_pattern_match(spark, sf):
    patterns = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("pattern"))
    sources = documents(spark, sf).select("source").distinct()
    return sources.join(retrieval.small(patterns), F.lower("source").contains(F.col("pattern"))).select("query_id", "source").distinct()


# --- extraction quality, index, judge logs, reports ------------------------------------------------------------

#: What extraction has to tell apart, by the last digit of a file's name: no pages (3), empty texts (4), poisoned texts (6, one page of 7), tables (1, 2: as elements; 8, 9: lost).
_DIGIT = "right(source, 1)"
_PARTS = f"""f AS (SELECT doc_id, source, CAST(CASE WHEN {_DIGIT} = '3' THEN NULL ELSE doc_id // 20 % 10 + 1 END AS INT) AS page, doc_id % 11 = 0 AND {_DIGIT} IN ('1', '2') AS is_table,
  CASE WHEN {_DIGIT} = '4' THEN '' WHEN {_DIGIT} = '6' OR ({_DIGIT} = '7' AND doc_id // 20 % 10 = 2) THEN replace(text, ' ', chr(92) || 'n') WHEN doc_id // 20 % 5 = 0 AND {_DIGIT} IN ('1', '2', '8', '9') THEN replace(text, ' ', ' | ') ELSE text END AS text FROM documents)"""
_TRIM = "trim(coalesce({0}, ''), chr(32) || chr(9) || chr(10) || chr(13))"
_PAGES = f"""pg AS (SELECT source, page, count(*) AS n, coalesce(sum(length(text)), 0) AS chars, count(*) FILTER (length({_TRIM.format('text')}) < 120) AS n_short, bool_or({_TRIM.format('text')} <> '') AS worded, bool_or(is_table) AS tbl FROM f GROUP BY ALL),
sums AS (SELECT source, CAST(sum(n) AS BIGINT) AS n_chunks, CAST(sum(chars) AS BIGINT) AS n_chars, CASE WHEN count(page) > 0 THEN count(page) WHEN sum(chars) > 0 THEN 1 ELSE 0 END AS pages_seen, bool_or(tbl) AS has_table, sum(n_short) / sum(n) AS short_ratio,
  CASE WHEN count(page) > 0 THEN count(*) FILTER (page IS NOT NULL AND NOT worded) / CAST(count(page) AS DOUBLE) WHEN sum(chars) > 0 THEN 0 ELSE 1 END AS empty_ratio FROM pg GROUP BY source),
stats AS (SELECT source, n_chunks, n_chars, CAST(pages_seen AS BIGINT) AS pages_seen, has_table, round(n_chars / greatest(pages_seen, 1), 6) AS chars_per_page, round(short_ratio, 6) AS short_ratio, round(empty_ratio, 6) AS empty_ratio,
  round(least(1.0, pages_seen / (10.0 + ascii({_DIGIT}) % 4)), 6) AS coverage FROM sums)"""


def parts(spark, sf):
    """_PARTS: each source is a file, each document a chunk of it."""
    digit, k, words = F.right("source", F.lit(1)), F.floor(F.col("doc_id") / 20), F.col("text")
    bad = (digit == "6") | ((digit == "7") & (k % 10 == 2))
    changed = F.when(digit == "4", "").when(bad, F.replace(words, F.lit(" "), F.lit("\\n"))).when((k % 5 == 0) & digit.isin("1", "2", "8", "9"), F.replace(words, F.lit(" "), F.lit(" | "))).otherwise(words)
    page = F.when(digit != "3", (k % 10 + 1).cast("int"))
    return documents(spark, sf).select("doc_id", "source", page.alias("page"), ((F.col("doc_id") % 11 == 0) & digit.isin("1", "2")).alias("is_table"), changed.alias("text"))


def pages_of(spark, sf):
    files = parts(spark, sf)
    chunks = files.select("source", "page", F.col("doc_id").alias("ord"), "text", "is_table")
    return chunks, files.select("source", _total_pages().alias("total_pages")).distinct()


def _total_pages():
    """A file has 10 to 13 pages, by the last character of its name."""
    return F.lit(10.0) + F.ascii(F.right("source", F.lit(1))) % 4


@query(f"WITH {_PARTS}, {_PAGES} SELECT * FROM stats")
def extraction_stats(spark, sf):
    return corpus.extraction_stats(parts(spark, sf), _total_pages())


_POISONED = rf"""pt AS (SELECT source, CAST(doc_id // 20 % 10 + 1 AS INT) AS page, {POISON} AS t FROM documents),
ps AS (SELECT source, page, max(len(regexp_extract_all(t, '\\[nrt]|\\x[0-9a-fA-F]{{2}}|\\u[0-9a-fA-F]{{4}}')) * 1000.0 / greatest(1, length(t))) AS e, max((length(t) - length(replace(t, chr(92), ''))) * 1000.0 / greatest(1, length(t))) AS b FROM pt GROUP BY ALL),
poison AS (SELECT source, count(*) AS pages, count(*) FILTER (e >= 10 OR b >= 20) AS poisoned, round(max(e), 4) AS max_escaped_per_1k, round(max(b), 4) AS max_backslash_per_1k, CAST(0 AS DOUBLE) AS max_control_ratio,
  round(count(*) FILTER (e >= 10 OR b >= 20) / CAST(count(*) AS DOUBLE), 4) AS ratio FROM ps GROUP BY source)"""


def _poison(spark, sf):
    bad = F.when(F.col("doc_id") % 7 == 0, F.replace("text", F.lit(" "), F.lit("\\n"))).otherwise(F.col("text"))
    return corpus.poisoned_pages(_files(spark, sf).withColumn("text", bad))


@query(f"WITH {_POISONED} SELECT * FROM poison")
def poisoned_pages(spark, sf):
    return _poison(spark, sf)


_LINES = "list_filter(string_split({0}, chr(10)), lambda x: trim(x) <> '')"
_TABLE = "len({0}) >= 5 AND len(list_filter({0}[1:60], lambda x: contains(x, '|') OR contains(x, chr(9)) OR len(list_filter(string_split_regex(trim(x), ' {{2,}}'), lambda p: p <> '')) >= 3)) >= 4"
#: One row for each page of the scope of each file in f.
LOW = rf"""sc AS (SELECT source, unnest(range(1, 11 + ascii(right(source, 1)) % 4)) AS page FROM (SELECT DISTINCT source FROM f)),
c AS (SELECT *, regexp_replace(coalesce(text, ''), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS t, coalesce(text, '') AS raw FROM f),
s AS (SELECT source, page, CAST(sum(length(t)) AS BIGINT) AS chars, count(*) AS n, count(*) FILTER (length(t) < 120) AS short, bool_or(is_table) AS tbl, max(len(regexp_extract_all(raw, '\\[nrt]|\\x[0-9a-fA-F]{{2}}|\\u[0-9a-fA-F]{{4}}')) * 1000.0 / greatest(1, length(raw))) AS e,
  max((length(raw) - length(replace(raw, chr(92), ''))) * 1000.0 / greatest(1, length(raw))) AS b, max(len(regexp_extract_all(raw, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]')) / CAST(greatest(1, length(raw)) AS DOUBLE)) AS k FROM c GROUP BY ALL),
x AS (SELECT source, page, {_LINES.format("string_agg(left(t, 2000), chr(10) ORDER BY doc_id)")} AS l FROM (SELECT * FROM c WHERE t <> '' QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY doc_id) <= 8) GROUP BY ALL),
p AS (SELECT sc.source, CAST(sc.page AS INT) AS page, coalesce(chars, 0) AS chars, coalesce(n, 0) AS n_chunks, round(coalesce(short / CAST(n AS DOUBLE), 1), 6) AS short_ratio, coalesce(tbl, false) AS has_table,
  coalesce({_TABLE.format("l")}, false) AS table_like, coalesce(e >= 10 OR b >= 20 OR k >= 0.01, false) AS poisoned FROM sc LEFT JOIN s USING (source, page) LEFT JOIN x USING (source, page))"""


@query(f"""WITH {_PARTS}, {_PAGES}, {LOW}, z AS (SELECT source, count(*) AS scope, count(*) FILTER (n_chunks > 0) AS seen, count(*) FILTER (chars = 0) AS empty, count(*) FILTER (table_like) AS tables, count(*) FILTER (poisoned) AS bad FROM p GROUP BY source),
j AS (SELECT source, round(seen / scope::DOUBLE, 6) AS coverage, concat_ws('; ', CASE WHEN n_chunks = 0 THEN 'chunks==0' END, CASE WHEN seen / scope < 0.85 THEN 'page_coverage<' || round(seen / scope::DOUBLE, 4) || '<0.85' END, CASE WHEN bad / scope >= 0.35 THEN 'poisoned_text_ratio:' || round(bad / scope::DOUBLE, 4) || '>=thr:0.35' END) AS hard,
  concat_ws('; ', CASE WHEN chars_per_page < 450 THEN 'chars_per_page<' || round(chars_per_page, 2) || '<450' END, CASE WHEN empty / scope > 0.25 THEN 'empty_page_ratio>' || round(empty / scope::DOUBLE, 4) || '>0.25' END, CASE WHEN stats.short_ratio > 0.55 THEN 'short_chunk_ratio>' || round(stats.short_ratio, 4) || '>0.55' END,
  CASE WHEN tables >= greatest(2, ceil(scope * 0.12)) AND NOT has_table THEN 'table_loss' END, CASE WHEN bad > 0 THEN 'poisoned_text_detected:' || bad || '/' || scope END) AS soft FROM z JOIN stats USING (source))
SELECT source, coverage, CASE WHEN hard <> '' THEN 'hard_fail' WHEN soft <> '' THEN 'soft_fail' ELSE 'pass' END AS status, CASE WHEN hard <> '' THEN hard ELSE soft END AS reason FROM j""")
def routing_status(spark, sf):
    return corpus.routing(corpus.extraction_stats(parts(spark, sf), _total_pages()), cascade.low_pages(*pages_of(spark, sf)))


_ATTEMPTS = """att AS (SELECT source, doc_id AS attempt_no, CASE doc_id // 20 % 4 WHEN 0 THEN 'docling' WHEN 1 THEN 'pymupdf' WHEN 2 THEN 'unstructured' ELSE 'window' END AS extractor,
  CASE doc_id % 3 WHEN 0 THEN 'hard_fail' WHEN 1 THEN 'pass' ELSE 'soft_fail' END AS status,
  round(doc_id % 97 / 97.0, 6) AS coverage, round(doc_id % 7 / 7.0, 6) AS short_ratio, CAST(doc_id % 1009 AS DOUBLE) AS chars_per_page, doc_id % 13 AS n_chunks FROM documents)"""


@query(f"""WITH {_ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coverage DESC, CASE WHEN short_ratio = 0 THEN 1.0 ELSE short_ratio END, chars_per_page DESC, n_chunks DESC, attempt_no) AS rn FROM att WHERE status IN ('pass', 'soft_fail') AND n_chunks > 0),
m AS (SELECT *, max(coverage) FILTER (rn = 1 AND extractor = 'window') OVER w AS wc, min(rn) FILTER (extractor <> 'window') OVER w AS bo, max(coverage) FILTER (extractor <> 'window') OVER w AS oc FROM r WINDOW w AS (PARTITION BY source))
SELECT source, attempt_no, extractor, coverage FROM m WHERE rn = CASE WHEN oc >= wc + 0.15 THEN bo ELSE 1 END""")
def best_attempt(spark, sf):
    i = F.col("doc_id")
    kind = F.floor(i / 20) % 4
    attempts = documents(spark, sf).select(
        "source", i.alias("attempt_no"), F.when(kind == 0, "docling").when(kind == 1, "pymupdf").when(kind == 2, "unstructured").otherwise("window").alias("extractor"),
        F.when(i % 3 == 0, "hard_fail").when(i % 3 == 1, "pass").otherwise("soft_fail").alias("status"),
        F.round(i % 97 / 97.0, 6).alias("coverage"), F.round(i % 7 / 7.0, 6).alias("short_ratio"), (i % 1009).cast("double").alias("chars_per_page"), (i % 13).alias("n_chunks"),
    )
    return corpus.best_attempt(attempts).select("source", "attempt_no", "extractor", "coverage")


@query("""WITH old AS (SELECT d.doc_id, CASE WHEN d.doc_id % 10 = 0 THEN 'x' ELSE sha256(text) END AS h, CASE quality WHEN 1 THEN 'pass' WHEN 0 THEN 'hard_fail' END AS status, d.doc_id % 5 AS chunks, round(d.doc_id % 11 / 10.0, 6) AS coverage FROM documents d JOIN labels USING (doc_id))
SELECT CAST(d.doc_id AS VARCHAR) AS source, CASE WHEN old.h = sha256(text) AND status IN ('pass', 'soft_fail') AND chunks > 0 AND coverage >= 0.85 THEN 'reuse' ELSE 'extract' END AS action FROM documents d LEFT JOIN old USING (doc_id)""")
def incremental_reuse(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("doc_id").cast("string").alias("source"), F.sha2("text", 256).alias("file_hash"))
    old = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select(
        "source", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("file_hash")).alias("file_hash"), F.when(F.col("quality") == 1, "pass").when(F.col("quality") == 0, "hard_fail").alias("status"),
        (F.col("doc_id") % 5).alias("chunks"), F.round(F.col("doc_id") % 11 / 10.0, 6).alias("coverage"),
    )
    return corpus.incremental(docs.select("source", "file_hash"), old).select("source", "action")


@query(f"WITH {_LOG} SELECT user_id, event_id, status FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_by_key(spark, sf):
    return corpus.latest_by(_events(spark, sf), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "status")


METRICS = ["faithfulness", "answer_relevance", "context_relevance", "mean_recall_at_k", "mean_mrr", "mean_ndcg_at_k"]
RAGAS = METRICS[:3]
_LATEST = f"""{_LOG}, lat AS (SELECT provider, user_id AS query_id, status, metric AS faithfulness, metric * metric AS answer_relevance, 1 - metric AS context_relevance, metric / 2 AS mean_recall_at_k,
  CASE WHEN event_id % 5 <> 0 THEN metric END AS mean_mrr, CAST(NULL AS DOUBLE) AS mean_ndcg_at_k FROM log QUALIFY row_number() OVER (PARTITION BY provider, user_id ORDER BY ts DESC, event_id DESC) = 1)"""


def _latest(spark, sf):
    last, m = corpus.latest_by(_events(spark, sf), ["provider", "user_id"], ["ts", "event_id"]), F.col("metric")
    measures = [m, m * m, 1 - m, m / 2, F.when(F.col("event_id") % 5 != 0, m), F.lit(None).cast("double")]
    return last.select("provider", F.col("user_id").alias("query_id"), "status", *[c.alias(n) for n, c in zip(METRICS, measures, strict=True)])


_SUMMARY = "sm AS (SELECT provider, count(*) AS total, count(*) FILTER (status = 'success') AS completed, count(*) FILTER (status <> 'success') AS failed, count(*) FILTER (status = 'timeout') AS timed_out, " + ", ".join(f"round(avg({m}) FILTER (status = 'success'), 6) AS {m}" for m in METRICS) + ", CASE WHEN count(*) = count(*) FILTER (status = 'success') THEN 'complete' ELSE 'incomplete' END AS verdict FROM lat GROUP BY provider)"


@query(f"WITH {_LATEST}, {_SUMMARY} SELECT * FROM sm")
def provider_summary(spark, sf):
    return corpus.provider_summary(_latest(spark, sf), METRICS)


@query(f"""WITH {_LATEST} SELECT provider, 'completed' AS list, query_id FROM lat WHERE status = 'success' UNION ALL SELECT provider, 'failed', query_id FROM lat WHERE status <> 'success' UNION ALL SELECT provider, 'timed_out', query_id FROM lat WHERE status = 'timeout'""")
def provider_runs(spark, sf):
    return corpus.provider_runs(_latest(spark, sf))


@query(f"WITH {_LATEST}, {_SUMMARY} SELECT " + ", ".join(f"round(a.{m} - b.{m}, 4) AS {m}" for m in METRICS) + " FROM sm a JOIN sm b ON a.provider = 'left' AND b.provider = 'right'")
def provider_delta(spark, sf):
    return corpus.provider_delta(corpus.provider_summary(_latest(spark, sf), METRICS), "left", "right", METRICS)


@query(f"""WITH {_LATEST}, p AS (SELECT query_id, {", ".join(f"abs(max({m}) FILTER (provider = 'left') - max({m}) FILTER (provider = 'right')) AS {m}" for m in RAGAS)} FROM lat WHERE status = 'success' GROUP BY query_id HAVING count(DISTINCT provider) = 2)
SELECT query_id, round({" + ".join(RAGAS)}, 4) AS abs_delta_sum FROM p ORDER BY abs_delta_sum DESC, query_id LIMIT 5""")
def top_disagreements(spark, sf):
    return corpus.top_disagreements(_latest(spark, sf), "left", "right", RAGAS)


@query(f"WITH {_LATEST}, {_SUMMARY.replace('avg(', '0 * avg(')} SELECT CASE WHEN count(*) = 2 AND bool_and({' AND '.join(f'coalesce(abs({m}) <= 1e-12, false)' for m in RAGAS)}) THEN 'all_ragas_zero_both_judges' END AS warning FROM sm WHERE provider IN ('left', 'right')")
def zero_warning(spark, sf):
    """All metrics are set to 0, so that the warning is met."""
    rows = _latest(spark, sf)
    return corpus.zero_warning(corpus.provider_summary(rows.withColumns({m: F.col(m) * 0 for m in METRICS}), METRICS), "left", "right", RAGAS)


@query("SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY source ORDER BY n_docs DESC, source LIMIT 5")
def corpus_overview(spark, sf):
    return documents(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars")).orderBy(F.desc("n_docs"), "source").limit(5)


@query(rf"SELECT tok AS term, count(*) AS n FROM (SELECT unnest({_tokens()}) AS tok FROM documents) WHERE regexp_matches(tok, '^\p{{L}}{{4,}}$') GROUP BY tok ORDER BY n DESC, tok LIMIT 12")
def top_terms(spark, sf):
    return corpus.top_terms(documents(spark, sf))


@query("""SELECT coalesce(a.source, b.source) AS source, coalesce(n, 0) AS n, coalesce(quality, -1) AS quality FROM (SELECT source, count(*) AS n FROM documents GROUP BY ALL) a
FULL JOIN (SELECT source, round(avg(quality), 6) AS quality FROM documents JOIN labels USING (doc_id) GROUP BY ALL) b ON a.source = b.source""")
def document_stats(spark, sf):
    docs = documents(spark, sf)
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    marks = docs.join(table(spark, sf, "labels"), "doc_id").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("quality"))
    return counts.join(marks, "source", "full").select("source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quality", F.lit(-1.0)).alias("quality"))


@query(f"WITH {_PARTS}, {_PAGES} SELECT count(*) AS files, CAST(sum(n_chunks) AS BIGINT) AS chunks, count(*) FILTER (coverage < 0.85) AS hard_fails, round(avg(coverage), 6) AS coverage, round(avg(chars_per_page), 4) AS chars_per_page FROM stats")
def kpi_row(spark, sf):
    stats = QUERIES["extraction_stats"](spark, sf)
    return stats.agg(F.count(F.lit(1)).alias("files"), F.sum("n_chunks").alias("chunks"), F.count_if(F.col("coverage") < 0.85).alias("hard_fails"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg("chars_per_page"), 4).alias("chars_per_page"))


_SESSIONS = "ses AS (SELECT user_id AS session, max(event_id) AS mtime, sum(length(props)) AS size FROM events GROUP BY ALL)"


@query(f"""WITH {_SESSIONS}, n AS (SELECT max(mtime) AS now, sum(size) / 2 AS cap FROM ses), o AS (SELECT session, mtime, size, now - mtime > 150 AS old, cap FROM ses, n)
SELECT session, old OR sum(size) OVER (ORDER BY old, mtime DESC, session DESC) > cap AS evicted FROM o""")
def cache_eviction(spark, sf):
    sessions = table(spark, sf, "events").groupBy(F.col("user_id").alias("session")).agg(F.max("event_id").alias("mtime"), F.sum(F.length("props")).alias("size"))
    now, total = sessions.agg(F.max("mtime"), F.sum("size")).first()
    return corpus.evict(sessions, F.lit(now), 150, (total or 0) / 2)


@query("""WITH u AS (SELECT user_id AS session, event_id, row_number() OVER (PARTITION BY user_id, sha256(props) ORDER BY ts, event_id) = 1 AS fresh, ts FROM events)
SELECT session, event_id, fresh AND sum(CAST(fresh AS INT)) OVER (PARTITION BY session ORDER BY ts, event_id) <= 20 AS admitted FROM u""")
def upload_admission(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session"), "event_id", F.struct("ts", "event_id").alias("ord"), F.sha2("props", 256).alias("hash"))
    return corpus.admit(rows, 20).select("session", "event_id", "admitted")


@query("SELECT source, lang AS extractor FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, first) = 1")
def extractor_mode(spark, sf):
    counts = documents(spark, sf).groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first"))
    return counts.groupBy("source").agg(F.max_by("lang", F.struct("n", -F.col("first"))).alias("extractor"))


@query("SELECT source, batch, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT source, page, (row_number() OVER (PARTITION BY source ORDER BY page) - 1) // 3 AS batch FROM (SELECT DISTINCT source, CAST(doc_id // 20 % 10 + 1 AS INT) AS page FROM documents)) GROUP BY ALL")
def page_batches(spark, sf):
    numbered = _files(spark, sf).select("source", "page").distinct().withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("source").orderBy("page")) - 1) / 3))
    return numbered.groupBy("source", "batch").agg(F.array_join(F.array_sort(F.collect_list("page")), ",").alias("pages"))


@query("SELECT doc_id, source, CAST(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id // 20 % 10 + 1 END AS INT) AS page FROM documents WHERE doc_id % 7 = 0 OR doc_id // 20 % 10 + 1 NOT IN (2, 5) UNION ALL SELECT -doc_id - 1, source, CAST(doc_id // 20 % 10 + 1 AS INT) FROM documents WHERE doc_id // 20 % 10 + 1 IN (2, 5)")
def targeted_merge(spark, sf):
    base = _files(spark, sf).select("doc_id", "source", F.when(F.col("doc_id") % 7 != 0, F.col("page")).alias("page"))
    fresh = _files(spark, sf).where("page in (2, 5)").select((-F.col("doc_id") - 1).alias("doc_id"), "source", "page")
    kept = base.join(fresh.select("source", "page").distinct(), ["source", "page"], "left_anti")
    return kept.select("doc_id", "source", "page").unionByName(fresh)


from . import cascade as _cascade  # noqa: E402, F401  registers its queries here
from . import indexing as _indexing  # noqa: E402, F401
