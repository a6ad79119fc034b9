"""The engine's queries against their SQL on the smallest tables, and worked examples."""

import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvine.functions import chunking, text
from corvine.operators import cascade, corpus, retrieval
from corvine.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, data):
    def value(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5)
        return v if v is None or isinstance(v, (bool, str, int)) else round(float(v), 5)

    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((repr(tuple(value(r[k]) for k in order)) for r in data))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, duck, name):
    df, rel = QUERIES[name](spark, SF), duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(rel.columns, rel.fetchall())


def test_diversity_takes_turns(spark):
    c = spark.createDataFrame([(1, k + 1, d, s) for k, (d, s) in enumerate([("a1", "a"), ("a2", "a"), ("a3", "a"), ("b1", "b")])], "query_id int, pos int, doc string, source string")
    assert [r.doc for r in retrieval.source_diversity(c, cap=2, k=4).orderBy("pos").collect()] == ["a1", "b1", "a2", "a3"]


def test_year_boost(spark):
    c = spark.createDataFrame([(1, 1, 7.0, ["2020"], ["2019"]), (1, 2, 6.91, ["2020"], ["2020"]), (1, 3, 6.5, ["2020"], ["2021"])], "query_id int, pos int, score double, query_years array<string>, source_years array<string>")
    assert [r.source_years[0] for r in retrieval.year_boost(c).orderBy("pos").collect()] == ["2020", "2019", "2021"]


def test_year_retention(spark):
    schema = "query_id int, pos int, rerank_score double, year_hit boolean"
    near = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.7, False), (1, 3, 0.55, True)], schema)
    far = spark.createDataFrame([(1, 1, 0.9, False), (1, 2, 0.8, False), (1, 3, 0.3, True)], schema)
    assert [r.rerank_score for r in retrieval.year_retention(near, 2).orderBy("pos").collect()] == [0.9, 0.55]
    assert [r.rerank_score for r in retrieval.year_retention(far, 2, gap=0.2).orderBy("pos").collect()] == [0.9, 0.8]


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "x", 2), (1, "y", 3)], "query_id int, item string, pos int")
    gold = spark.createDataFrame([(1, "a"), (1, "b")], "query_id int, item string")
    r = retrieval.retrieval_metrics(ranked, gold, 3).first()
    assert r.recall == 0.5 and r.rr == 1.0 and r.ndcg == pytest.approx(1 / (1 + 1 / math.log2(3)), abs=1e-6)


def test_clamp(spark):
    d = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, -0.5), (3, 1.7), (4, 0.42), (5, None)], "k int, x double")
    assert [r.y for r in d.select("k", text.clamp_score(F.col("x")).alias("y")).orderBy("k").collect()] == [0, 0, 0, 1, 0.42, 0]


def test_chunks(spark):
    d = spark.createDataFrame([("a" * 2500,)], "t string")
    pieces = d.select(chunking.char_chunks(F.col("t")).alias("c")).first().c
    assert len(pieces) >= 3 and len(pieces[0]) == 1000
    table = spark.createDataFrame([("\n".join(f"row | value{k} | metric" for k in range(30)),)], "t string")
    packed = [r.chunk for r in chunking.table_chunks(table, "t", 30, 6).collect()]
    assert len(packed) > 1 and all(x.startswith("row | ") for p in packed for x in p.split("\n"))


def test_null_and_empty_texts(spark):
    d = spark.createDataFrame([(None,), ("",), ("   ",)], "t string")
    got = d.select(F.size(text.tokens(F.col("t"))).alias("n"), text.normalize_ws(F.col("t")).alias("w"), F.size(chunking.token_chunks(F.col("t"), 10, 2)).alias("c")).collect()
    assert all(r.n == 0 and r.w == "" and r.c == 0 for r in got)


ATTEMPT = "source string, attempt_no int, extractor string, status string, coverage double, short_ratio double, chars_per_page double, n_chunks int"


def test_best_attempt(spark):
    rows = [
        ("f", 1, "pages_window", "pass", 0.93, 0.1, 500.0, 9), ("f", 0, "layout", "pass", 0.92, 0.1, 500.0, 9), ("g", 1, "window", "soft_fail", 0.62, 0.1, 500.0, 9),
        # Not usable: no chunks, a hard fail, no status.
        ("u", 1, "layout", "pass", 0.99, 0.1, 500.0, 0), ("u", 2, "layout", "hard_fail", 0.98, 0.1, 500.0, 9), ("u", 3, "layout", "soft_fail", 0.5, 0.1, 500.0, 9), ("v", 1, "layout", None, 0.9, 0.1, 1.0, 3),
    ]
    got = {r.source: (r.extractor, r.attempt_no) for r in corpus.best_attempt(spark.createDataFrame(rows, ATTEMPT)).collect()}
    assert got == {"f": ("pages_window", 1), "g": ("window", 1), "u": ("layout", 3)}
    # Above 0 the gap never lets another win, since coverage leads the order; below 0 it does.
    assert {r.extractor for r in corpus.best_attempt(spark.createDataFrame(rows[:2], ATTEMPT), gap=-0.05).collect()} == {"layout"}


def test_extraction_without_pages(spark):
    rows = [("a", None, "words", None), ("b", None, "", None), ("b", None, None, True), ("c", 1, "x", False), ("c", 2, " ", None), ("c", None, "free", None)]
    got = {r.source: r for r in corpus.extraction_stats(spark.createDataFrame(rows, "source string, page int, text string, is_table boolean"), F.lit(4.0)).collect()}
    assert [(got[k].pages_seen, got[k].empty_ratio, got[k].coverage, got[k].has_table) for k in "abc"] == [(1, 0.0, 0.25, False), (0, 1.0, 0.0, True), (2, 0.5, 0.5, False)]


def test_routing_without_chunks(spark):
    chunks = spark.createDataFrame([("a", 1, 0, "w " * 400, False)], "source string, page int, ord long, text string, is_table boolean")
    files = spark.createDataFrame([("a", 1), ("b", 2)], "source string, total_pages int")
    got = {r.source: (r.status, r.reason) for r in corpus.routing(corpus.extraction_stats(chunks, F.lit(1.0)), cascade.low_pages(chunks, files)).collect()}
    assert got == {"a": ("pass", ""), "b": ("hard_fail", "chunks==0; page_coverage<0.0<0.85")}


def test_gate_without_gold(spark):
    means = spark.createDataFrame([(0, None, None, None)], "n long, recall double, mrr double, ndcg double")
    with pytest.raises(Exception, match="no source matches"):
        retrieval.gate(means).collect()


def test_dense_sizes(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0])], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.1]), (8, None), (9, [2.0]), (10, [0.0, 0.0])], "query_id long, qvec array<double>")
    got = sorted((r.query_id, r.vec_id, r.rank) for r in retrieval.dense_topk(vectors, asked, 2).collect())
    assert got == [(7, 1, 1), (7, 2, 2), (9, 4, 1), (10, 1, 1), (10, 2, 2)]
    assert retrieval.dense_topk(vectors.limit(0), asked).count() == 0 and retrieval.dense_topk(vectors, asked.limit(0)).count() == 0


def test_sources_and_stream(spark, tmp_path):
    from corvine.sources import files
    from corvine.streaming.ingest import ingest

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.TXT").write_bytes("café ".encode() + b"\xff end")
    (tmp_path / "in" / "deep" / "b.md").write_text("one two three")
    (tmp_path / "in" / "c.bin").write_text("no")
    found = files.plain_text(files.discover(spark, str(tmp_path / "in"))).orderBy("path").collect()
    assert [r.text for r in found] == ["café  end", "one two three"]
    from corvine import index

    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "ix"), str(tmp_path / "state")).awaitTermination(60)
    run()
    assert sorted(r.text for r in index.load(spark, str(tmp_path / "ix"))[1].collect()) == ["café end", "one two three"]
    (tmp_path / "in" / "deep" / "c.md").write_text("four")
    run()
    listed, chunks = index.load(spark, str(tmp_path / "ix"))
    assert sorted(r.text for r in chunks.collect()) == ["café end", "four", "one two three"]
    assert {r.source.rpartition("/")[2]: r.status for r in listed.collect()} == {"a.TXT": "pass", "b.md": "pass", "c.md": "pass", "c.bin": "hard_fail"}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_bm25_leaves_pairs_in_tasks(spark, duck, monkeypatch):
    """Scores are made where a document is: no pair of a query and a document is shuffled. Passes and blocks of any size give the same lists."""
    index, asked = retrieval.lexical_index(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/benchmark.parquet").selectExpr("item_id query_id", "text query")
    plan = retrieval.bm25_topk(index, asked, pad_zero=False)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange" in x and "query_id" in x and "doc_id" in x]
    whole = sorted(map(tuple, retrieval.bm25_topk(index, asked).select("query_id", "doc_id", "score", "rank").collect()))
    monkeypatch.setattr(retrieval, "PASS_TOKENS", 200)
    for block in (1, 64, 5000):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        words = pa.array(["a", "b", "c"])
        lists = pa.RecordBatch.from_pydict({"doc_id": [5, 4, 3, 2, 1], "dl": [2, 1, 0, 2, 2], "toks": pa.array([["a", "x"], ["b"], None, ["a", "x"], ["x", "x"]], pa.list_(pa.string()))})
        posted = list(retrieval._postings(iter([lists, lists.slice(0, 2)]), words))
        assert posted[0].to_pydict() == {"doc_id": [5, 4, 2], "dl": [2, 1, 2], "terms": [[0], [1], [0]], "tfs": [[1], [1], [1]]} and posted[1].num_rows == 2
        # Word a is asked by query 0 alone, b by 0 and 1, c by 1; the first k of equal scores are those of least ids.
        names, starts = pa.array([70, 71]), np.array([0, 1, 3, 4])
        out = pa.Table.from_batches(retrieval._scored(iter(posted[:1]), names, starts, np.array([0, 0, 1, 1]), np.array([1.0, 9.0, 2.0, 1.0]), 1.0, 2, 1.5, 0.75)).to_pydict()
        assert list(zip(out["query_id"], out["doc_id"])) == [(70, 4), (70, 2), (71, 4)]
    monkeypatch.setattr(retrieval, "BLOCK", 3000)
    assert sorted(map(tuple, retrieval.bm25_topk(index, asked).select("query_id", "doc_id", "score", "rank").collect())) == whole


def test_dense_keeps_k_of_a_task():
    """A task's batches give k rows a query together; copies are in the order of their ids, whatever batch they are in."""
    rng = np.random.default_rng(3)
    vectors, asked = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    vectors[200:260], vectors[5], asked[3], vectors[0] = vectors[40:100], asked[2], 0, asked[2] * 3
    ids = rng.permutation(300)
    frames = [pd.DataFrame({"vec_id": ids[k : k + 50], "embedding": list(vectors[ids[k : k + 50]])}) for k in range(0, 300, 50)]
    got = pd.concat(retrieval._nearest(iter(frames), np.arange(7), asked, 4))
    scores = np.round(asked @ vectors.T / np.maximum(np.sqrt((asked**2).sum(1))[:, None] * np.sqrt((vectors**2).sum(1)), 1e-12), 6)
    want = {(q, v) for q in range(7) for v in np.lexsort((np.arange(300), -scores[q]))[:4]}
    assert len(got) == 28 and set(zip(got["query_id"], got["vec_id"])) == want


def test_tokens_of_odd_texts(spark, duck):
    """Words are lowered with their text at once where that changes nothing."""
    for c in map(chr, range(0x110000)):
        low = c.lower()
        assert c in "İΣ" or "\ud800" <= c <= "\udfff" or (len(low) == 1 and bool(text._WORDS(c)) == bool(text._WORDS(low)))
    words = ["ΟΔΥΣΣΕΥΣ", "İstanbul", "-_Ёлка_-", "a1", "12ab3", "123a", "x", "THE", "и", "é-è", "_", "٣٤x", "ⅫⅢ", "été", "", None]
    texts = words + [" ".join(w or "" for w in words), "one\tTwo.THREE-four_five 2024 of"]
    got = [r.t for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").coalesce(1).select("k", text.tokens(F.col("t")).alias("t")).orderBy("k").collect()]
    assert got == [[t for w in text._WORDS(x or "") if (t := text.token(w))] for x in texts]
    assert got[2:6] == [["елка"], ["a1"], [], []]  # 12ab3 has 3 digits of 5
    assert got[-1] == ["one", "two", "three-four_five"]


def test_candidates_do_not_shuffle_texts(spark):
    """Searches are not run again by what reads their lists, and the texts of all documents are not shuffled for a few candidates."""
    from corvine.ask import candidates
    from corvine.plans import indexing, registry
    from corvine.plugins import embedded

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs, asked = spark.read.parquet(f"{SF}/documents.parquet"), registry._asked(spark, SF)
        chunks = docs.select(F.sha2(F.col("doc_id").cast("string"), 256).substr(1, 24).alias("chunk_id"), "source", F.lit(None).cast("int").alias("page"), F.lit("text").alias("kind"), "text", text.tokens(F.col("text")).alias("toks"), embedded(F.col("text")).alias("embedding")).withColumn("dl", F.size("toks"))
        for found in (registry._candidates(spark, SF), candidates(chunks, asked, indexing.SETTINGS, 5)):
            assert "SortMergeJoin" not in plan(found) and "ShuffledHashJoin" not in plan(found)
        assert "MapInPandas" not in plan(QUERIES["rehydrated_candidates"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hashed_embedding_counts_words():
    import xxhash

    from corvine.plugins import HashedEmbedder

    want = np.zeros(8)
    for w in ["a", "b", "b", "c"]:
        h = xxhash.xxh3_64_intdigest(w)
        want[h % 8] += 1 if h >> 63 else -1
    got = HashedEmbedder(8).embed(["A b B c", "", "  "])
    assert got[0] == (want / max(np.sqrt((want**2).sum()), 1e-12)).tolist() and got[1] == got[2] == [0.0] * 8
