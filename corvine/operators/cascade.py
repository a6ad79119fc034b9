"""The extraction cascade's page checks, fragment merging and recovery rules, and the verdicts over runs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_table, normalize_ws, poison_signals, text_key


def low_pages(chunks: DataFrame, files: DataFrame, least_chars: int = 450, most_short: float = 0.55, sample: int = 8) -> DataFrame:
    """chunks(source, page, ord, text, is_table), files(source, total_pages) -> one row for each page of the scope 1..total_pages.

    chars, n_chunks, short_ratio (no chunks: 1), table_like (of its first `sample` texts, 2000 characters each),
    has_table (a table element), poisoned, and low: too few characters, too many short chunks, a table that is no element, or poisoned. Chunks without a
    page or outside the scope do not count.
    """
    scope = files.select("source", F.explode(F.expr("sequence(1, cast(total_pages as int))")).alias("page"))
    clean = chunks.where("page is not null").withColumn("t", F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\r")))
    signals = poison_signals(F.col("text"))
    sums = clean.groupBy("source", "page").agg(
        F.sum(F.length("t")).alias("chars"), F.count(F.lit(1)).alias("n_chunks"), F.count_if(F.length("t") < 120).alias("n_short"), F.bool_or(F.coalesce("is_table", F.lit(False))).alias("has_table"),
        *[F.max(c).alias(n) for n, c in signals.items()],
    )
    # Only the first texts of a page are ranked: the limit is applied before the shuffle.
    firsts = clean.where("t <> ''").withColumn("rn", F.row_number().over(Window.partitionBy("source", "page").orderBy("ord"))).where(F.col("rn") <= sample)
    texts = firsts.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("rn", F.substring("t", 1, 2000).alias("t")))).alias("texts"))
    tables = texts.select("source", "page", looks_like_table(F.array_join(F.transform("texts", lambda x: x["t"]), "\n")).alias("table_like"))
    poisoned = (F.col("escaped_per_1k") >= 10) | (F.col("backslash_per_1k") >= 20) | (F.col("control_ratio") >= 0.01)
    joined = scope.join(sums, ["source", "page"], "left").join(tables, ["source", "page"], "left")
    out = joined.select(
        "source", "page", F.coalesce("chars", F.lit(0)).alias("chars"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"),
        F.round(F.coalesce(F.col("n_short") / F.col("n_chunks"), F.lit(1.0)), 6).alias("short_ratio"),
        F.coalesce("has_table", F.lit(False)).alias("has_table"), F.coalesce("table_like", F.lit(False)).alias("table_like"), F.coalesce(poisoned, F.lit(False)).alias("poisoned"),
    )
    return out.withColumn("low", (F.col("chars") < least_chars) | (F.col("short_ratio") > most_short) | (F.col("table_like") & ~F.col("has_table")) | F.col("poisoned"))


def _merge(batches: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """Rows in the order of (source, page, ord): runs of short texts are joined until they have `least` characters."""
    held, at = [], None
    for frame in batches:
        out = []
        for source, page, ord_, text in frame[["source", "page", "ord", "t"]].itertuples(index=False):
            if held and ((source, page) != at or len(text) >= least):
                out.append((*at, held[0][0], " ".join(t for _, t in held)))
                held = []
            at = (source, page)
            if len(text) >= least:
                out.append((source, page, ord_, text))
                continue
            held.append((ord_, text))
            if sum(len(t) for _, t in held) >= least:
                out.append((*at, held[0][0], " ".join(t for _, t in held)))
                held = []
        yield pd.DataFrame(out, columns=["source", "page", "ord", "text"])
    if held:
        yield pd.DataFrame([(*at, held[0][0], " ".join(t for _, t in held))], columns=["source", "page", "ord", "text"])


def merge_fragments(chunks: DataFrame, least: int = 120) -> DataFrame:
    """chunks(source string, page int, ord long, text) -> the same columns, short neighbours of a page joined by a space.

    White space is normalised; empty texts and later copies of a text on its page (case aside) go. A run of texts
    below max(80, least) characters is joined until it reaches them, the next long text comes or the page ends;
    it takes the ord of its first. Rows without a page pass unchanged. Sorted rows are streamed, so a page of any
    number of chunks is held one run at a time.
    """
    least = max(80, least)
    source = F.coalesce("source", F.lit(""))
    clean = chunks.where("page is not null").select(source.alias("source"), F.col("page").cast("int").alias("page"), F.col("ord").cast("long").alias("ord"), normalize_ws(F.col("text")).alias("t")).where("t <> ''")
    first = clean.groupBy("source", "page", F.sha2(text_key(F.col("t")), 256).alias("key")).agg(F.min_by("t", "ord").alias("t"), F.min("ord").alias("ord"))
    merged = first.repartition("source", "page").sortWithinPartitions("source", "page", "ord").select("source", "page", "ord", "t").mapInPandas(lambda it: _merge(it, least), "source string, page int, ord long, text string")
    return merged.unionByName(chunks.where("page is null").select("source", F.col("page").cast("int").alias("page"), F.col("ord").cast("long").alias("ord"), "text"))


def quality_poor(chars_per_page: Column, empty_ratio: Column, short_ratio: Column) -> Column:
    return F.coalesce((chars_per_page < 450) | (empty_ratio > 0.25) | (short_ratio > 0.55), F.lit(False))


def only_low_coverage(status: Column, chunks: Column, reason: Column) -> Column:
    """A hard fail with chunks, all of whose reasons are page coverage."""
    parts = F.filter(F.transform(F.split(F.coalesce(reason, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce((status == "hard_fail") & (chunks > 0) & (F.size(parts) > 0) & F.forall(parts, lambda x: x.startswith("page_coverage")), F.lit(False))


def recovery(attempts: DataFrame, trigger: float = 0.35, soft: float = 0.55) -> DataFrame:
    """attempts(..., status, n_chunks, reason, coverage) with recover (worth recovery batches), downgraded and the status after it."""
    low = only_low_coverage(F.col("status"), F.col("n_chunks"), F.col("reason"))
    coverage = F.coalesce("coverage", F.lit(0.0))
    marked = attempts.withColumns({"recover": low & (coverage < trigger), "downgraded": low & (coverage >= soft)})
    return marked.withColumn("status", F.when(F.col("downgraded"), "soft_fail").otherwise(F.col("status")))


def run_verdict(log: DataFrame, status: str = "status", again: str = "again") -> DataFrame:
    """One row: PASS if every run succeeded, FAIL if one failed for good, else INCONCLUSIVE; an empty log is INCONCLUSIVE."""
    done, dead = F.count_if(F.col(status) == "success"), F.count_if((F.col(status) != "success") & ~F.col(again))
    total = F.count(F.lit(1))
    return log.agg(total.alias("total"), done.alias("completed"), dead.alias("fatal")).withColumn(
        "verdict", F.when((F.col("total") > 0) & (F.col("completed") == F.col("total")), "PASS").when(F.col("fatal") > 0, "FAIL").otherwise("INCONCLUSIVE")
    )


def readiness(checks: DataFrame) -> DataFrame:
    """checks(name, ok, mandatory) -> failed (sorted names) and verdict; checks are a bounded table."""
    out = checks.agg(F.array_join(F.array_sort(F.collect_list(F.when(~F.coalesce("ok", F.lit(False)), F.col("name")))), ",").alias("failed"), F.count_if(F.col("mandatory") & ~F.coalesce("ok", F.lit(False))).alias("bad"))
    return out.select("failed", F.when(F.col("bad") > 0, "Not ready").when(F.col("failed") != "", "Conditionally ready").otherwise("Ready").alias("verdict"))
