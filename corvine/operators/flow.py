"""The extraction cascade: registered extractors as stages over a table of files. Each stage works on the files that none before it has passed.

files(source, content, total_pages, ...) become attempts: tables of chunks and of verdicts. Stages are plans of
their own, written to the shared folder; a file's bytes are read by the stages that need them and never shuffled.
A page file may have several rows, each with pages `first` to `last` as a content of its own: a task then holds a few
rows, whatever the file's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import chunk_long
from ..functions.text import adaptive_timeout, resolved_timeout
from ..plugins import create, limited, page_count
from ..settings import Settings, ocr_order
from ..sources.scratch import small_batches, written
from .cascade import low_pages, only_low_coverage, recovery
from .corpus import best_attempt, extraction_stats, routing

BLOCKS = "source string, ord long, page int, kind string, text string, error string"
CHUNKS = ["source", "page", "ord", "kind", "text", "window"]
#: Blocks, and characters of them, that go back to Spark at once.
FRAME_ROWS, FRAME_CHARS = 5000, 4 << 20


def window_tag(page: Column, pages: Column, size: int) -> Column:
    """`first-last` of the window of `size` pages that a page lies in; the last window ends with the file."""
    first = F.floor((page - 1) / size) * size
    return F.concat((first + 1).cast("string"), F.lit("-"), F.least(first + size, pages).cast("string"))


def counted(files: DataFrame, extractor: str, **options) -> DataFrame:
    """files(source, content) with total_pages; a file that cannot be read has 1."""

    @F.pandas_udf("int")
    def pages(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = create("extractor", extractor, **options)
        for part in parts:
            yield part.map(lambda c: page_count(reader, c))

    if "last" in files.columns:
        return files.join(files.groupBy("source").agg(F.max("last").alias("total_pages")), "source")
    small_batches(files.sparkSession)
    return files.withColumn("total_pages", pages("content"))


def named(files: DataFrame) -> DataFrame:
    """(source, total_pages), one row a file."""
    return files.select("source", "total_pages").distinct()


def read_blocks(files: DataFrame, extractor: str, **options) -> DataFrame:
    """BLOCKS of files(source, content, [first, last], [only: pages of the file], [seconds]); a row that fails has one row with its error.

    With seconds, a row is read in a process of its own that is killed after them; 0 seconds leave no budget.
    """
    given = files.columns
    only = F.col("only") if "only" in given else F.lit(None).cast("array<int>")
    first = F.col("first").cast("int") if "first" in given else F.lit(1)
    if "first" in given and "only" in given:
        only = F.filter(only, lambda p: p.between(F.col("first"), F.col("last")))
    rows = files.select("source", "content", only.alias("only"), (F.col("seconds") if "seconds" in given else F.lit(-1)).cast("int").alias("seconds"), first.alias("first"))
    small_batches(files.sparkSession)

    def framed(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["source", "ord", "page", "kind", "text", "error"]).astype({"page": "Int32"})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = create("extractor", extractor, **options)
        out, held = [], 0
        for frame in batches:
            for source, content, only, seconds, first in frame.itertuples(index=False):
                pages = None if only is None else {int(p) - first + 1 for p in only}
                call = lambda content=content, pages=pages: list(reader.pages(bytes(content), pages))
                base = (first - 1) * 1_000_000
                try:
                    if seconds == 0:
                        raise TimeoutError("deadline: no budget left")
                    found = call() if seconds < 0 else limited(call, seconds)
                except TimeoutError as e:
                    out.append((source, base, None, None, None, f"Timeout: {e}"))
                    continue
                except Exception as e:  # noqa: BLE001  a broken file is a verdict of its own
                    out.append((source, base, None, None, None, f"exception: {e}"))
                    continue
                for k, (page, kind, text) in enumerate(found):
                    out.append((source, base + k, page if page is None else page + first - 1, kind, text, None))
                    held += len(text or "")
                    if len(out) >= FRAME_ROWS or held >= FRAME_CHARS:
                        yield framed(out)
                        out, held = [], 0
        if out:
            yield framed(out)

    return rows.mapInPandas(read, BLOCKS)


@dataclass
class Attempt:
    """chunks: CHUNKS; verdicts: one row a file that the attempt was made on."""

    label: str
    chunks: DataFrame
    verdicts: DataFrame


def judged(label: str, number: int, chunks: DataFrame, files: DataFrame, errors: DataFrame | None = None) -> Attempt:
    """The attempt, with its verdict over the whole scope of each file, and the pages that are low."""
    marked = chunks.withColumn("is_table", F.col("kind") == "table")
    pages = written(low_pages(marked, files), "pages")
    stats = extraction_stats(marked, F.lit(1.0))
    low = pages.where("low").groupBy("source").agg(F.array_sort(F.collect_list("page")).alias("low"))
    rows = routing(stats, pages).join(stats.select("source", "n_chunks", "chars_per_page", "short_ratio", "empty_ratio"), "source", "left").join(low, "source", "left")
    rows = rows.fillna({"n_chunks": 0, "chars_per_page": 0.0, "short_ratio": 1.0, "empty_ratio": 1.0})
    if errors is not None:
        rows = rows.join(errors, "source", "left").withColumn("status", F.when(F.col("error").isNotNull(), "hard_fail").otherwise(F.col("status"))).withColumn("reason", F.coalesce("error", "reason")).drop("error")
    out = rows.select("source", F.lit(number).alias("attempt_no"), F.lit(label).alias("extractor"), "status", "reason", "coverage", "chars_per_page", "short_ratio", "empty_ratio", "n_chunks", "low")
    return Attempt(label, chunks, written(out, "verdicts"))


def attempt(files: DataFrame, extractor: str, number: int, label: str | None = None, window: int | None = None, settings: Settings | None = None, **options) -> Attempt:
    """One extractor over all given files: blocks, chunks, verdicts."""
    label = label or extractor
    blocks, names = written(read_blocks(files, extractor, **options), "blocks"), named(files)
    good, errors = blocks.where("error is null"), blocks.where("error is not null").select("source", "ord", "error")
    if "first" in files.columns:  # a file fails with any of its rows
        errors = errors.groupBy("source").agg(F.min_by("error", "ord").alias("error"))
        good = good.join(errors, "source", "left_anti")
    most, overlap = (settings.chunk_tokens_prose, settings.chunk_overlap_prose) if settings else (360, 60)
    rows = chunk_long(good.select("source", "page", "kind", F.col("ord").alias("block"), "text"), "text", "kind", most=most, overlap=overlap)
    chunks = rows.select("source", "page", (F.col("block") * 100_000 + F.col("chunk_ord")).alias("ord"), "kind", F.col("chunk").alias("text"))
    if window:
        tag = window_tag(F.col("page"), F.col("total_pages"), window)
        chunks = chunks.join(names, "source").withColumn("window", tag).drop("total_pages")
    else:
        chunks = chunks.withColumn("window", F.lit(None).cast("string"))
    return judged(label, number, written(chunks.select(*CHUNKS), "chunks"), names, errors.select("source", "error"))


def merge_targeted(base: DataFrame, fresh: DataFrame, pages: DataFrame) -> DataFrame:
    """base without the chunks of the targeted pages(source, page), and all chunks of fresh; chunks without a page stay.

    ord is set anew: by page (none: first), then by length, base before fresh.
    """
    kept = base.join(pages.select("source", "page"), ["source", "page"], "left_anti")
    both = kept.withColumn("turn", F.lit(0)).unionByName(fresh.withColumn("turn", F.lit(1)))
    place = Window.partitionBy("source").orderBy(F.coalesce("page", F.lit(0)), F.length("text"), "turn", "ord")
    return both.withColumn("ord", (F.row_number().over(place) - 1).cast("long")).select("source", "page", "ord", "kind", "text", "window")


def of(attempts: list[Attempt], chosen: DataFrame) -> DataFrame:
    """The chunks of the chosen (source, attempt_no) of each file."""
    parts = [a.chunks.withColumn("attempt_no", F.lit(k)) for k, a in enumerate(attempts)]
    return reduce(DataFrame.unionByName, parts).join(chosen.select("source", "attempt_no"), ["source", "attempt_no"], "left_semi").drop("attempt_no")


def open_files(files: DataFrame, attempts: list[Attempt]) -> DataFrame:
    """The files that no attempt has passed."""
    for a in attempts:
        files = files.join(a.verdicts.where("status = 'pass'").select("source"), "source", "left_anti")
    return files


def finished(files: DataFrame, attempts: list[Attempt], chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(outcomes, chunks): one row a file with rounded measures and the path of its attempts, and the chunks of the chosen ones."""
    tried = reduce(DataFrame.unionByName, [a.verdicts.select("source", "attempt_no", "extractor") for a in attempts])
    path = tried.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("attempt_no", "extractor"))), lambda x: x["extractor"]), "->").alias("path"))
    rounded = [F.round(c, n).alias(c) for c, n in (("coverage", 4), ("chars_per_page", 2), ("short_ratio", 4), ("empty_ratio", 4))]
    out = files.select("source").distinct().join(chosen, "source").join(path, "source").select("source", "extractor", "status", "reason", "path", *rounded, "n_chunks")
    return out, of(attempts, chosen)


def demo_fast(files: DataFrame, settings: Settings, first: str = "pymupdf4llm", window: str = "pymupdf_window_fallback", **options) -> tuple[DataFrame, DataFrame]:
    """Page text, then page windows for what has not passed; the second result is soft at worst, even without chunks."""
    one = attempt(files, first, 0, settings=settings, **options)
    two = attempt(open_files(files, [one]), window, 1, window=settings.page_window_size, settings=settings)
    soft = two.verdicts.withColumn("status", F.when(F.col("status") == "pass", "pass").otherwise("soft_fail"))
    return finished(files, [one, two], one.verdicts.where("status = 'pass'").unionByName(soft))


def full_quality(files: DataFrame, settings: Settings, options: dict[str, dict] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two layout readers, page text, low pages by the fine reader, recovery batches, page windows; a pass ends a file's way.

    Else its best usable attempt counts, or the last one. The fine reader takes the low pages of the page text's
    attempt, or of the first layout reader's, if that was soft. Recovery takes the low pages of a hard fail by
    coverage alone, batch by batch (settings bound their number), until the file passes or covers enough.
    """
    options, attempts = options or {}, []

    def run(rows: DataFrame, name: str, label: str | None = None, window: int | None = None) -> Attempt:
        attempts.append(attempt(rows, name, len(attempts), label, window, settings, **options.get(label or name, {})))
        return attempts[-1]

    def merged(base: DataFrame, rows: DataFrame, fresh: Attempt, label: str) -> Attempt:
        """base(source, attempt_no) with the targeted pages of rows(source, only) from fresh, where fresh has chunks."""
        some = rows.select("source", "total_pages", "only").distinct().join(fresh.chunks.select("source").distinct(), "source", "left_semi")
        old = of(attempts, base.join(some.select("source"), "source", "left_semi"))
        new = fresh.chunks.join(some.select("source"), "source", "left_semi")
        chunks = written(merge_targeted(old, new, some.select("source", F.explode("only").alias("page"))), "merged")
        attempts.append(judged(label, len(attempts), chunks, some.select("source", "total_pages")))
        return attempts[-1]

    layouts = [run(open_files(files, attempts), f"docling_{ocr}") for ocr in ocr_order(settings.docling_ocr_backend, settings.docling_ocr_fallbacks)[:2]]
    plain = run(open_files(files, attempts), "pymupdf4llm")
    # Low pages of the soft attempt; the page text's comes before the layout reader's.
    left = open_files(files, attempts)
    softs = [a.verdicts.where("status = 'soft_fail' and low is not null").select("source", "attempt_no", F.col("low").alias("only"), F.lit(k).alias("turn")) for k, a in enumerate((plain, layouts[0]))]
    soft = written(softs[0].unionByName(softs[1]).groupBy("source").agg(F.min_by(F.struct("attempt_no", "only"), "turn").alias("b")).select("source", "b.*"), "soft")
    targets = left.join(soft, "source")
    fine = run(targets, "unstructured_hi_res", "unstructured_hi_res_targeted")
    good = targets.join(fine.verdicts.select("source"), "source", "left_semi")
    tag = "pymupdf4llm+unstructured_hi_res_targeted"
    base = merged(soft, good, fine, tag)
    if settings.extract_low_coverage_recovery_enabled:
        size = settings.extract_low_coverage_recovery_batch_pages
        current = reduce(DataFrame.unionByName, [base.verdicts, plain.verdicts.join(base.verdicts.select("source"), "source", "left_anti")])
        for k in range(-(-settings.extract_low_coverage_recovery_max_pages // size)):
            marked = recovery(current, settings.extract_low_coverage_recovery_trigger_coverage) if k == 0 else current.withColumn("recover", (F.col("status") != "pass") & (F.col("coverage") < settings.extract_min_page_coverage))
            todo = marked.where("recover")
            if k == 0:
                queue = written(todo.select("source", F.slice("low", 1, settings.extract_low_coverage_recovery_max_pages).alias("queue")), "queue")
            batch = queue.join(todo.select("source", "attempt_no"), "source").withColumn("only", F.slice("queue", k * size + 1, size)).where("size(only) > 0")
            rows = open_files(files, attempts).join(written(batch.select("source", "attempt_no", "only"), "batch"), "source")
            if not rows.head(1):
                break
            fresh = run(rows, "unstructured_hi_res", f"unstructured_hi_res_recovery_batch_{k + 1}")
            names = rows.select("source", "attempt_no").distinct()
            step = merged(names, rows, fresh, "pymupdf4llm+unstructured_hi_res_recovery")
            step.verdicts = written(recovery(step.verdicts, soft=settings.extract_low_coverage_recovery_softfail_min_coverage).drop("recover", "downgraded"), "verdicts")
            current = step.verdicts.unionByName(names.select("source").join(step.verdicts.select("source"), "source", "left_anti").join(current, "source").select(*step.verdicts.columns))
    last = run(open_files(files, attempts), "pymupdf_window_fallback", window=settings.page_window_size)
    low = only_low_coverage(F.col("status"), F.col("n_chunks"), F.col("reason"))
    last.verdicts = written(last.verdicts.withColumn("status", F.when(low, "soft_fail").otherwise(F.col("status"))), "verdicts")
    every = reduce(DataFrame.unionByName, [a.verdicts for a in attempts])
    passed = every.where("status = 'pass'").groupBy("source").agg(F.min_by(F.struct(*every.columns), "attempt_no").alias("c")).select("c.*")
    rest = every.join(passed.select("source"), "source", "left_anti")
    usable = best_attempt(rest, settings.extract_best_usable_min_coverage_gap)
    none = rest.join(usable.select("source"), "source", "left_anti").groupBy("source").agg(F.max_by(F.struct(*every.columns), "attempt_no").alias("c")).select("c.*")
    return finished(files, attempts, written(passed.unionByName(usable).unionByName(none), "chosen"))


def plain_text(files: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Text files: chunks of the whole text, always a pass."""
    text = F.replace(F.expr("make_valid_utf8(cast(content as string))"), F.lit("�"), F.lit(""))
    rows = chunk_long(files.select("source", text.alias("t"), F.lit("text").alias("kind")), "t", "kind", most=settings.chunk_tokens_prose, overlap=settings.chunk_overlap_prose)
    chunks = rows.select("source", F.lit(None).cast("int").alias("page"), F.col("chunk_ord").cast("long").alias("ord"), "kind", F.col("chunk").alias("text"), F.lit(None).cast("string").alias("window"))
    stats = extraction_stats(chunks.withColumn("is_table", F.lit(False)), F.lit(1.0))
    rows = files.select("source").join(stats, "source", "left").fillna({"n_chunks": 0, "chars_per_page": 0.0, "short_ratio": 1.0, "empty_ratio": 1.0, "coverage": 0.0})
    measures = [F.round(c, n).alias(c) for c, n in (("coverage", 4), ("chars_per_page", 2), ("short_ratio", 4), ("empty_ratio", 4))]
    return rows.select("source", F.lit("plain_text").alias("extractor"), F.lit("pass").alias("status"), F.lit("").alias("reason"), F.lit("plain_text").alias("path"), *measures, "n_chunks"), chunks


def extract(files: DataFrame, settings: Settings, profile: str) -> tuple[DataFrame, DataFrame]:
    """(outcomes, chunks) of files(source, content), by the suffix of the source: text files are read, page files go through the profile's cascade, others are hard fails."""
    kind = F.lower(F.regexp_extract("source", r"(\.[^./\\]+)$", 1))
    parts = [plain_text(files.where(kind.isin(".txt", ".csv", ".md")), settings)]
    paged = files.where(kind == ".pdf")
    if paged.head(1):
        parts.append((demo_fast if profile == "demo-fast" else full_quality)(counted(paged, "pymupdf4llm"), settings))
    other = files.where(~kind.isin(".txt", ".csv", ".md", ".pdf")).select("source", F.lit("n/a").alias("extractor"), F.lit("hard_fail").alias("status"), F.concat(F.lit("exception: unsupported file type "), kind).alias("reason"), F.lit("").alias("path"), *[F.lit(0.0).alias(c) for c in ("coverage", "chars_per_page")], *[F.lit(1.0).alias(c) for c in ("short_ratio", "empty_ratio")], F.lit(0).cast("long").alias("n_chunks"))
    return reduce(DataFrame.unionByName, [p[0] for p in parts], other), reduce(DataFrame.unionByName, [p[1] for p in parts])


def budget(files: DataFrame, settings: Settings, cap: int, remaining: Column, reserve: int = 0) -> DataFrame:
    """files(total_pages, length) with the seconds of an attempt: by size, under the stage's cap, within what remains beside the reserve; 0 below the least start."""
    left = remaining - reserve
    seconds = resolved_timeout(adaptive_timeout(F.col("total_pages"), F.col("length") / 1e6, F.lit(True), settings.extract_timeout_base_sec, settings.extract_timeout_per_100_pages_sec, settings.extract_timeout_per_10mb_sec, settings.extract_timeout_max_sec), F.lit(cap), left)
    return files.withColumn("seconds", F.when(left < settings.extract_full_quality_min_stage_start_sec, 0).otherwise(seconds))
