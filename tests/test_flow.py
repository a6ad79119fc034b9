"""The extraction cascade, the index, questions, judges, settings and plug-ins, on small files."""

import json

import pytest
from pyspark.sql import functions as F

from corvine import index, plugins, settings
from corvine.ask import ask, judge
from corvine.cli import Preflight, main
from corvine.operators import flow
from corvine.sources import files

PROSE = "Solar panels turn light into power for homes and towns. " * 12


def book(*pages):
    return "\f".join(pages).encode()


@pytest.fixture
def s():
    return settings.load(environment={"EXTRACT_LOW_COVERAGE_RECOVERY_BATCH_PAGES": "2", "EXTRACT_LOW_COVERAGE_RECOVERY_MAX_PAGES": "4", "PAGE_WINDOW_SIZE": "2"})


def table(spark, rows):
    return spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "source string, content binary")


def test_window_tag(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,), (5,)], "p int").select(flow.window_tag(F.col("p"), F.lit(5), 2).alias("w"))
    assert [r.w for r in rows.collect()] == ["1-2", "1-2", "3-4", "5-5"]


def test_router_and_demo_fast(spark, s):
    good = [f"Page {k}. {PROSE}" for k in range(4)]
    rows = table(spark, [("/a.pdf", book(*good)), ("/b.PDF", book(good[0], "", "", "")), ("/c.txt", b"plain words"), ("/d.doc", b"x")])
    out, chunks = flow.extract(rows, s, "demo-fast")
    got = {r.source: r for r in out.collect()}
    assert {k: (r.extractor, r.status) for k, r in got.items()} == {
        "/a.pdf": ("pymupdf4llm", "pass"), "/b.PDF": ("pymupdf_window_fallback", "soft_fail"), "/c.txt": ("plain_text", "pass"), "/d.doc": ("n/a", "hard_fail"),
    }
    assert got["/b.PDF"].path == "pymupdf4llm->pymupdf_window_fallback" and got["/b.PDF"].coverage == 0.25 and got["/b.PDF"].reason.startswith("page_coverage<0.25")
    assert {(r.source, r.window) for r in chunks.collect()} == {("/a.pdf", None), ("/b.PDF", "1-2"), ("/c.txt", None)}


def test_full_quality(spark, s):
    """Readers that miss pages: a soft result is mended page by page, a poor one by recovery batches, a broken one has no chunks."""
    pages = [f"Part {k}. {PROSE}" for k in range(8)]
    rows = table(spark, [("/all.pdf", book(*pages)), ("/none.pdf", book("", "")), ("/few.pdf", book(*pages[:3], "short"))]).withColumn("total_pages", F.when(F.col("source") == "/none.pdf", 2).when(F.col("source") == "/few.pdf", 4).otherwise(8))
    poor = {"skip": (2, 3, 4, 5, 6, 7, 8)}
    out, chunks = flow.full_quality(rows, s, {"docling_easyocr": poor, "docling_rapidocr": poor, "pymupdf4llm": poor, "pymupdf_window_fallback": poor})
    got = {r.source: r for r in out.collect()}
    # Coverage 1/8 starts recovery; two batches of two pages bring it to 5/8, which is enough for a soft result.
    assert (got["/all.pdf"].status, got["/all.pdf"].extractor, got["/all.pdf"].coverage) == ("soft_fail", "pymupdf4llm+unstructured_hi_res_recovery", 0.625)
    assert "unstructured_hi_res_recovery_batch_2" in got["/all.pdf"].path and {r.page for r in chunks.where("source = '/all.pdf'").collect()} == {1, 2, 3, 4, 5}
    assert (got["/none.pdf"].status, got["/none.pdf"].n_chunks) == ("hard_fail", 0) and got["/few.pdf"].status in ("pass", "soft_fail")
    whole, _ = flow.full_quality(rows.where("source = '/all.pdf'"), s)
    assert [(r.extractor, r.status, r.path) for r in whole.collect()] == [("docling_easyocr", "pass", "docling_easyocr->docling_rapidocr->pymupdf4llm")[:2] + ("docling_easyocr",)]


def test_targeted_merge(spark):
    c = "source string, page int, ord long, kind string, text string, window string"
    base = spark.createDataFrame([("f", 1, 0, "text", "one", None), ("f", 2, 1, "text", "poor", None), ("f", None, 2, "text", "loose", None), ("g", 2, 0, "text", "g", None)], c)
    fresh = spark.createDataFrame([("f", 2, 0, "text", "better text", None), ("f", 2, 1, "text", "more", None)], c)
    got = flow.merge_targeted(base, fresh, spark.createDataFrame([("f", 2)], "source string, page int")).orderBy("source", "ord").collect()
    assert [(r.source, r.page, r.text) for r in got] == [("f", None, "loose"), ("f", 1, "one"), ("f", 2, "more"), ("f", 2, "better text"), ("g", 2, "g")]


def test_broken_and_late_files(spark):
    rows = spark.createDataFrame([("a", None, -1), ("b", bytearray(b"in time"), 20), ("c", bytearray(b"never"), 0)], "source string, content binary, seconds int")
    got = {r.source: r for r in flow.read_blocks(rows, "form_feed").collect()}
    assert got["a"].error.startswith("exception: ") and got["b"].text == "in time" and got["c"].error == "Timeout: deadline: no budget left"
    with pytest.raises(TimeoutError):
        plugins.limited(lambda: __import__("time").sleep(30), 0.3)
    with pytest.raises(RuntimeError, match="no pages"):
        plugins.limited(lambda: (_ for _ in ()).throw(ValueError("no pages")).__next__(), 5)
    assert plugins.page_count(plugins.FormFeedExtractor(), None) == 1 and plugins.page_count(plugins.FormFeedExtractor(), b"a\fb") == 2


def test_index_build(spark, s, tmp_path):
    path = str(tmp_path / "ix")
    rows = lambda **x: table(spark, [(f"/{k}.txt", v.encode()) for k, v in x.items()]).withColumn("file_hash", F.sha2("content", 256))
    extract = lambda todo: flow.extract(todo, s, "demo-fast")
    embed = lambda text: plugins.embedded(text, dim=8)
    assert index.version(spark, path) == 0

    def update(files_now):
        made = index.build(files_now, *index.load(spark, path), extract, embed)
        index.save(made[0], made[1], path)
        return index.counts(*index.load(spark, path), made[2]).first()

    first = update(rows(same="alpha beta", gone="gamma delta", changed="old words", empty=" ", twin="alpha beta"))
    assert (first.indexed_files, first.failed_files, first.duplicate_files, first.indexed_chunks) == (4, 1, 1, 4)
    before = {r.source: r for r in index.load(spark, path)[1].collect()}
    update(rows(same="alpha beta", changed="new words", empty="no more"))
    listed, chunks = index.load(spark, path)
    after = {r.source: r for r in chunks.collect()}
    assert set(after) == {"/same.txt", "/changed.txt", "/empty.txt"} and after["/same.txt"].chunk_id == before["/same.txt"].chunk_id and after["/changed.txt"].text == "new words"
    assert after["/changed.txt"].chunk_id != before["/changed.txt"].chunk_id and len(after["/empty.txt"].embedding) == 8
    assert {r.source: r.status for r in listed.collect()} == {"/same.txt": "pass", "/changed.txt": "pass", "/empty.txt": "pass"}
    # A version without its manifest, as of a job that was lost, is not seen.
    chunks.limit(0).write.parquet(f"{path}/chunks/version=3")
    assert index.version(spark, path) == 2 and index.load(spark, path)[1].count() == 3
    dangling = spark.createDataFrame([("/same.txt", [after["/same.txt"].chunk_id, "lost"])], "source string, chunk_ids array<string>")
    assert index.chunks_of(dangling, chunks).count() == 1


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "data").mkdir()
    for k in range(4):
        (tmp_path / "data" / f"note{k}.txt").write_text(f"Topic {k}. {PROSE} Number {k} speaks of energy source {k}.")
    (tmp_path / "data" / "book.pdf").write_bytes(book(*[f"Wind turbines page {k}. {PROSE}" for k in range(3)]))
    (tmp_path / "gold.jsonl").write_text(json.dumps({"query": "wind turbines", "relevant_patterns": ["book"]}) + "\n")
    monkeypatch.setenv("INDEX_DIR", str(tmp_path / "ix"))
    run = lambda *x: (main(list(x), spark), [json.loads(r) for r in capsys.readouterr().out.splitlines()])
    assert run("ask", "wind turbines") == (0, [{"query_id": 0, "answer": "The index is empty.", "refused": "no_context", "context": "", "sources": []}])
    code, rows = run("index", "--data-dir", str(tmp_path / "data"))
    assert code == 0 and rows[0]["indexed_files"] == 5 and rows[0]["failed_files"] == 0
    code, rows = run("ask", "wind turbines page", "--reranker", "jina")
    assert code == 0 and rows[0]["sources"][0].endswith("/book.pdf") and rows[0]["context"].startswith("[S1] source=")
    assert run("quality-gate", "--goldset", str(tmp_path / "gold.jsonl"), "--output", str(tmp_path / "gate"))[1][0]["ok"] is True
    assert len(run("benchmark-rerank", "--only", "amberoad")[1]) >= 1
    assert run("pdf-regression", "--data-dir", str(tmp_path / "data"), "--profile", "fast")[1][0]["status"] == "pass"
    assert run("selfcheck")[0] == 0 and len(run("prewarm")[1]) == 3 and run("prewarm", "--only", "nothing")[0] == 1


def test_judge_resumes(spark, s, tmp_path):
    queries = spark.createDataFrame([(1, "what is light"), (2, "what is power")], "query_id long, query string")
    answers = spark.createDataFrame([(1, "light is light", "light"), (2, "power", "power is power")], "query_id long, answer string, context string")
    log = str(tmp_path / "log")
    got = judge(answers, queries, ["overlap", "absent"], log, retries=0).collect()
    assert {(r.provider, r.query_id): r.status for r in got} == {("overlap", 1): "success", ("overlap", 2): "success", ("absent", 1): "failed", ("absent", 2): "failed"}
    again = judge(answers, queries, ["overlap", "absent"], log, retries=0)
    assert spark.read.parquet(log).count() == 6 and {r["at"] for r in again.where("provider = 'absent'").collect()} == {1}


def test_retry_and_embedding():
    slept, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 4:
            raise ConnectionError("connection reset by peer")
        return 7

    assert plugins.with_retry(flaky, 3, 2.0, 5.0, sleep=slept.append) == 7 and slept == [2.0, 4.0, 5.0]
    with pytest.raises(ValueError):
        plugins.with_retry(lambda: (_ for _ in ()).throw(ValueError("bad")), 3, sleep=slept.append)
    seen = []

    class Small(plugins.HashedEmbedder):
        def embed(self, texts):
            seen.append(list(texts))
            return super().embed(texts)

    out = plugins.Embedding(Small(4, 3), batch=3)(["a", "b c d e", "f", "g"])
    assert len(out) == 4 and seen[0] == ["a", "b c d e", "f"] and ["b c", "d e"] == [x[0] for x in seen if x[0] in ("b c", "d e")]
    whole = plugins.HashedEmbedder(4)
    assert out[1] == pytest.approx([(x + y) / 2 for x, y in zip(*whole.embed(["b c", "d e"]))])
    now = [0.0]
    check = Preflight(10, lambda: now[0])
    held = check()
    now[0] = 9.0
    assert check() is held
    now[0] = 10.0
    assert check() is not held


def test_settings(tmp_path):
    (tmp_path / "env").write_text("# comment\nRRF_K=7\nexport CHUNK_MODE='char'\nRETRIEVAL_YEAR_BOOST=-1\n")
    x = settings.load(str(tmp_path / "env"), {"RRF_K": "9", "EMBEDDING_BATCH_SIZE": "0", "DOCLING_OCR_BACKEND": "odd", "FINAL_TOP_K": "many", "PREWARM_RERANKERS": "yes", "EXTRACT_MIN_PAGE_COVERAGE": "0.4"})
    assert (x.rrf_k, x.chunk_mode, x.retrieval_year_boost, x.embedding_batch_size, x.docling_ocr_backend, x.final_top_k, x.prewarm_rerankers) == (9, "char", 0.0, 1, "easyocr", 8, True)
    assert x.extract_low_coverage_recovery_softfail_min_coverage == 0.4
    assert settings.profile("QUALITY") == "full-quality" and settings.profile(None, True) == "demo-fast"


def test_files(spark, tmp_path):
    paths = spark.createDataFrame([("file:///a/./b/../c.txt",), ("hdfs://host:9000/x//y",), ("/z/../../q",)], "p string")
    assert [r.s for r in paths.select(files.source_path(F.col("p")).alias("s")).collect()] == ["/a/c.txt", "/x/y", "/q"]
    (tmp_path / "q.txt").write_text(" one \n\ntwo\n")
    (tmp_path / "q.jsonl").write_text('{"query": "a"}\n\n{"other": 1}\n')
    assert {r.query for r in files.query_list(spark, str(tmp_path / "q.txt")).collect()} == {"one", "two"}
    assert [r.query for r in files.query_list(spark, str(tmp_path / "q.jsonl")).collect()] == ["a"] and files.query_list(spark).count() == 4
    log = str(tmp_path / "log")
    files.save_log(spark.createDataFrame([(1, "a")], "k int, v string"), log)
    files.save_log(files.checkpoint_log(spark, log, "k int, v string").union(spark.createDataFrame([(2, "b|c\td")], "k int, v string")), log)
    rows = files.checkpoint_log(spark, log, "k int, v string")
    assert sorted(map(tuple, rows.collect())) == [(1, "a"), (2, "b|c\td")]
    files.save_tsv(rows, str(tmp_path / "tsv"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "tsv")).collect()) == ["1\ta", "2\tb|c d"]
    assert sorted(r.line for r in files.markdown(rows).collect()) == ["| 1 | a |", "| 2 | b\\|c\td |"] and files.markdown_head(rows) == "| k | v |\n|---|---|"
    (tmp_path / "gold").write_text('{"query": " ", "relevant_patterns": []}\n')
    with pytest.raises(ValueError):
        files.gold_set(spark, str(tmp_path / "gold"), strict=True)
    one = spark.createDataFrame([("p",)], "path string")
    assert files.sources({"demo": one, "uploads": one.limit(0)}).count() == 1
    with pytest.raises(ValueError):
        files.sources({"demo": one.limit(0), "uploads": one.limit(0)})


def test_files_in_rows(spark, s, monkeypatch):
    """A file whose pages come in several rows has the results of the whole one; no row grows with the file, and a row that fails is a failed file."""
    pages = [f"Part {k}. {PROSE}" for k in range(8)]
    pages[5] = "short"
    whole = [("/a.pdf", 1, 8, bytearray(book(*pages))), ("/b.pdf", 1, 8, bytearray(book(*([""] * 6), *pages[6:]))), ("/c.pdf", 1, 2, bytearray(book(*pages[:2])))]
    cut = [(n, k, min(k + 2, last), bytearray(b"\f".join(bytes(c).split(b"\f")[k - 1 : k + 2]))) for n, _, last, c in whole for k in range(1, last + 1, 3)]
    schema = "source string, first int, last int, content binary"
    one, many = (spark.createDataFrame(rows, schema) for rows in (whole, cut))
    (a, b), (c, d) = flow.extract(one.drop("first", "last"), s, "full-quality"), flow.extract(many, s, "full-quality")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, c.collect()))
    line = lambda rows: sorted((r.source, r.page, r.text) for r in rows.collect())
    assert line(b) == line(d)
    some = many.withColumn("only", F.array(F.lit(2), F.lit(6)))
    assert sorted((r.source, r.page) for r in flow.read_blocks(some, "form_feed").collect()) == [("/a.pdf", 2), ("/a.pdf", 6), ("/c.pdf", 2)]
    broken = many.withColumn("content", F.when((F.col("source") == "/a.pdf") & (F.col("first") == 4), None).otherwise(F.col("content")))
    tried = flow.attempt(flow.counted(broken, "form_feed"), "form_feed", 0, settings=s)
    assert {r.source: r.status for r in tried.verdicts.collect()}["/a.pdf"] == "hard_fail" and tried.chunks.where("source = '/a.pdf'").count() == 0
    from corvine.plans import indexing

    monkeypatch.setattr(indexing, "PART_CHARS", 20_000)
    books = indexing._books(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("source is not null")
    want = {f"/{n}.pdf": "\f".join(t or "" for _, t in sorted(rows)) for n, rows in __import__("itertools").groupby(sorted((r.source, (r.doc_id, r.text)) for r in docs.collect()), lambda x: x[0]) for rows in [[x[1] for x in rows]]}
    got = {}
    for r in books.orderBy("source", "first").collect():
        held = got.setdefault(r.source, [])
        assert r.first == 1 + sum(x.count("\f") + 1 for x in held) and r.last == r.first + bytes(r.content).count(b"\f")
        held.append(bytes(r.content).decode())
    assert {k: "\f".join(v) for k, v in got.items()} == want
    assert books.agg(F.max(F.length("content"))).first()[0] < 20_000 + 4 * docs.agg(F.max(F.length("text"))).first()[0]
