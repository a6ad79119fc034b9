"""Extraction quality, incremental index, judge logs and corpus reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import poison_signals, tokens
from ..sources.scratch import shared_folder


def extraction_stats(chunks: DataFrame, total_pages: Column, short: int = 120) -> DataFrame:
    """chunks(source, page, text, is_table) -> one row a source: counts, ratios and page coverage.

    A file whose chunks have no page counts as one page if they have characters, else as none; its empty ratio
    is 0 or 1 by the same. A file without chunks has no row here.
    """
    text = F.coalesce("text", F.lit(""))
    pages = chunks.groupBy("source", "page").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length(text)).alias("chars"), F.count_if(F.length(F.btrim(text, F.lit(" \t\n\r"))) < short).alias("n_short"),
        F.bool_or(F.btrim(text, F.lit(" \t\n\r")) != "").alias("worded"), F.bool_or(F.coalesce("is_table", F.lit(False))).alias("table"),
    )
    sums = pages.groupBy("source").agg(
        F.sum("n").alias("n_chunks"), F.sum("chars").alias("n_chars"), F.count("page").alias("paged"), F.sum("n_short").alias("n_short"),
        F.count_if(F.col("page").isNotNull() & ~F.col("worded")).alias("n_empty"), F.bool_or("table").alias("has_table"),
    )
    some = F.col("n_chars") > 0
    seen = F.when(F.col("paged") > 0, F.col("paged")).otherwise(some.cast("long"))
    empty = F.when(F.col("paged") > 0, F.col("n_empty") / F.col("paged")).otherwise((~some).cast("double"))
    return sums.select(
        "source", "n_chunks", "n_chars", seen.alias("pages_seen"), "has_table", F.round(F.col("n_chars") / F.greatest(seen, F.lit(1)), 6).alias("chars_per_page"),
        F.round(F.col("n_short") / F.greatest("n_chunks", F.lit(1)), 6).alias("short_ratio"), F.round(empty, 6).alias("empty_ratio"),
        F.round(F.least(F.lit(1.0), seen / F.greatest(total_pages, F.lit(1.0))), 6).alias("coverage"),
    )


def poisoned_pages(chunks: DataFrame, escaped: float = 10, slashes: float = 20, control: float = 0.01) -> DataFrame:
    """chunks(source, page, text) -> source, pages, poisoned, ratio and the greatest of each signal."""
    signals = poison_signals(F.col("text"))
    pages = chunks.select("source", "page", *[c.alias(n) for n, c in signals.items()]).groupBy("source", "page").agg(*[F.max(n).alias(n) for n in signals])
    bad = (F.col("escaped_per_1k") >= escaped) | (F.col("backslash_per_1k") >= slashes) | (F.col("control_ratio") >= control)
    out = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.count_if(bad).alias("poisoned"), *[F.round(F.max(n), 4).alias(f"max_{n}") for n in signals])
    return out.withColumn("ratio", F.round(F.col("poisoned") / F.col("pages"), 4))


def told(value: Column, digits: int = 4) -> Column:
    return F.round(value, digits).cast("double").cast("string")


def routing(stats: DataFrame, pages: DataFrame) -> DataFrame:
    """Extraction verdict of each file: source, status (hard_fail, soft_fail, pass) and its reasons, with their values, in order.

    stats: extraction_stats(); pages: cascade.low_pages(), whose scope decides coverage, empty pages, tables that
    were lost and poisoned pages. A file without chunks is in pages only.
    """
    scope = pages.groupBy("source").agg(
        F.count(F.lit(1)).alias("scope"), F.count_if(F.col("n_chunks") > 0).alias("seen"), F.count_if(F.col("chars") == 0).alias("empty"),
        F.count_if("table_like").alias("tables"), F.count_if("poisoned").alias("poisoned"),
    )
    rows = scope.join(stats.select("source", F.col("n_chunks").alias("chunks"), "chars_per_page", "short_ratio", "has_table"), "source", "left")
    rows = rows.fillna({"chunks": 0, "chars_per_page": 0.0, "short_ratio": 1.0, "has_table": False})
    coverage, empty, poison = (F.col(c) / F.col("scope") for c in ("seen", "empty", "poisoned"))
    rule = lambda hit, *parts: F.when(hit, F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))
    hard = F.concat_ws("; ", rule(F.col("chunks") == 0, "chunks==0"), rule(coverage < 0.85, "page_coverage<", told(coverage), "<0.85"), rule(poison >= 0.35, "poisoned_text_ratio:", told(poison), ">=thr:0.35"))
    soft = F.concat_ws(
        "; ", rule(F.col("chars_per_page") < 450, "chars_per_page<", told(F.col("chars_per_page"), 2), "<450"), rule(empty > 0.25, "empty_page_ratio>", told(empty), ">0.25"),
        rule(F.col("short_ratio") > 0.55, "short_chunk_ratio>", told(F.col("short_ratio")), ">0.55"),
        rule((F.col("tables") >= F.greatest(F.lit(2), F.ceil(F.col("scope") * 0.12))) & ~F.col("has_table"), "table_loss"),
        rule(F.col("poisoned") > 0, "poisoned_text_detected:", F.col("poisoned").cast("string"), "/", F.col("scope").cast("string")),
    )
    named = rows.select("source", F.round(coverage, 6).alias("coverage"), hard.alias("hard"), soft.alias("soft"))
    status = F.when(F.col("hard") != "", "hard_fail").when(F.col("soft") != "", "soft_fail").otherwise("pass")
    return named.select("source", "coverage", status.alias("status"), F.when(F.col("hard") != "", F.col("hard")).otherwise(F.col("soft")).alias("reason"))


def best_attempt(attempts: DataFrame, gap: float = 0.15) -> DataFrame:
    """attempts(source, attempt_no, extractor, status, coverage, short_ratio, chars_per_page, n_chunks) -> the chosen row of each source.

    Only usable attempts count: of status pass or soft_fail, with chunks. A source without one has no row. Greatest coverage, least short ratio (0 and null count as 1), most characters and chunks, first attempt; a
    window fallback gives way to the best other attempt of at least its coverage plus gap. Aggregates alone, so
    a file of very many attempts is combined before the shuffle. Null measures are the worst. With a gap above 0
    the window rule has no effect, since the greatest coverage leads the order; a gap below 0 lets others win.
    """
    attempts = attempts.where(F.col("status").isin("pass", "soft_fail") & (F.col("n_chunks") > 0))
    last = lambda c: -F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
    ratio = F.when(F.coalesce("short_ratio", F.lit(0.0)) == 0, 1.0).otherwise(F.col("short_ratio"))
    key = F.struct(last("coverage").alias("k1"), ratio.alias("k2"), last("chars_per_page").alias("k3"), last("n_chunks").alias("k4"), F.col("attempt_no").alias("k5"))
    row, other = F.struct(*attempts.columns), ~F.coalesce(F.col("extractor").contains("window"), F.lit(False))
    best = attempts.groupBy("source").agg(
        F.min_by(row, key).alias("best"), F.min_by(F.when(other, row), F.when(other, key)).alias("other"), F.max(F.when(other, F.col("coverage"))).alias("other_cov"),
    )
    swap = F.coalesce(F.col("best.extractor").contains("window"), F.lit(False)) & (F.col("other_cov") >= F.col("best.coverage") + gap)
    chosen = best.select(F.when(F.coalesce(swap, F.lit(False)), F.col("other")).otherwise(F.col("best")).alias("c"))
    return chosen.select(*[F.col(f"c.{c}").alias(c) for c in attempts.columns])


def reusable(status: Column, chunks: Column, coverage: Column, least: float = 0.85) -> Column:
    return F.coalesce(status.isin("pass", "soft_fail") & (chunks > 0) & (coverage >= least), F.lit(False))


def incremental(files: DataFrame, previous: DataFrame) -> DataFrame:
    """files(source, file_hash) against previous(source, file_hash, status, chunks, coverage): reuse or extract."""
    old = previous.select("source", F.col("file_hash").alias("old_hash"), reusable(F.col("status"), F.col("chunks"), F.col("coverage")).alias("usable"))
    same = F.coalesce((F.col("file_hash") == F.col("old_hash")) & F.col("usable"), F.lit(False))
    return files.join(old, "source", "left").select("source", "file_hash", F.when(same, "reuse").otherwise("extract").alias("action"))


def chunk_id(path: Column, file_hash: Column, page: Column, kind: Column, content_hash: Column) -> Column:
    none = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.substring(F.sha2(F.concat_ws("|", path, file_hash, none(page), none(kind), content_hash), 256), 1, 24)


def dedup_within(chunks: DataFrame, by: str, content: str, order: list[str]) -> DataFrame:
    """First chunk of equal content within each file; equal content of other files stays. Combined before the shuffle."""
    first = chunks.groupBy(by, content).agg(F.min_by(F.struct(*chunks.columns), F.struct(*order)).alias("c"))
    return first.select("c.*")


def latest_by(log: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The row of greatest order of each key; rows with a null in the key are left out. Combined before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    last = log.dropna(subset=keys).groupBy(*keys).agg(F.max_by(F.struct(*log.columns), F.struct(*order)).alias("c"))
    return last.select("c.*")


def provider_summary(log: DataFrame, metrics: list[str], total: int | None = None) -> DataFrame:
    """log(provider, query_id, status, metrics ...), one row a query -> counts, mean of each metric over successes, verdict.

    A mean without values is null. complete: as many successes as there are queries (total, or the rows of the
    log). The ids behind the counts are rows of provider_runs(), since a log of any size may have as many.
    """
    ok = F.col("status") == "success"
    out = log.groupBy("provider").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("completed"), F.count_if(~ok).alias("failed"), F.count_if(F.col("status") == "timeout").alias("timed_out"),
        *[F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in metrics],
    )
    wanted = F.col("total") if total is None else F.lit(total)
    return out.withColumn("verdict", F.when(F.col("completed") == wanted, "complete").otherwise("incomplete"))


def provider_runs(log: DataFrame) -> DataFrame:
    """(provider, list, query_id): the members of the lists completed, failed and timed_out (which are failed, too)."""
    kinds = F.when(F.col("status") == "success", F.array(F.lit("completed"))).when(F.col("status") == "timeout", F.array(F.lit("failed"), F.lit("timed_out"))).otherwise(F.array(F.lit("failed")))
    return log.select("provider", F.explode(kinds).alias("list"), "query_id")


def provider_delta(summary: DataFrame, left: str, right: str, metrics: list[str]) -> DataFrame:
    """One row: left less right of each metric, rounded to 4 digits; null where either has none. No row unless both are there."""
    side = lambda p, m: F.max(F.when(F.col("provider") == p, F.col(m)))
    there = summary.agg(F.count_distinct(F.when(F.col("provider").isin(left, right), F.col("provider"))).alias("n"), *[F.round(side(left, m) - side(right, m), 4).alias(m) for m in metrics])
    return there.where("n = 2").drop("n")


def zero_warning(summary: DataFrame, left: str, right: str, metrics: list[str]) -> DataFrame:
    """One row: all_ragas_zero_both_judges if both providers have all these metrics, and all of them are 0; else null."""
    both = summary.where(F.col("provider").isin(left, right))
    zero = F.lit(True)
    for m in metrics:
        zero = zero & F.coalesce(F.abs(F.col(m)) <= 1e-12, F.lit(False))
    return both.agg(F.when((F.count(F.lit(1)) == 2) & F.bool_and(zero), "all_ragas_zero_both_judges").alias("warning"))


def top_disagreements(log: DataFrame, left: str, right: str, metrics: list[str], n: int = 5) -> DataFrame:
    """log, one row a provider and query -> the n queries of greatest sum of absolute differences (4 digits), ties by query_id; both sides have to succeed."""
    ok = log.where(F.col("status") == "success").dropna(subset=metrics)
    side = lambda p, m: F.max(F.when(F.col("provider") == p, F.col(m)))
    pairs = ok.where(F.col("provider").isin(left, right)).groupBy("query_id").agg(F.count_distinct("provider").alias("n"), *[(F.abs(side(left, m) - side(right, m))).alias(m) for m in metrics]).where("n = 2")
    total = sum((F.col(m) for m in metrics[1:]), F.col(metrics[0]))
    return pairs.select("query_id", F.round(total, 4).alias("abs_delta_sum")).orderBy(F.desc("abs_delta_sum"), "query_id").limit(n)


def report(rows: DataFrame, filters: list[Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """All rows that every filter keeps (null: not), sorted by the named columns (`-` in front: descending, nulls last)."""
    for f in filters or []:
        rows = rows.where(f)
    by = [F.col(c[1:]).desc_nulls_last() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order or []]
    return rows.orderBy(*by) if by else rows


def top_terms(docs: DataFrame, k: int = 12) -> DataFrame:
    """Most frequent tokens of at least four letters and nothing but letters."""
    toks = docs.select(F.explode(tokens(F.col("text"))).alias("term")).where(F.col("term").rlike(r"^\p{L}{4,}$"))
    return toks.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(k)


def running_sum(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of `value` over all rows up to each one in `order` (which must leave no ties), without a window over the whole table.

    Rows are cut into ranges, each range is summed in its own task and starts from the sums of the ranges before
    it (one number a range). The ranges are checkpointed: a lost task must not draw their borders anew.
    """
    shared_folder(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside")).drop("_range", "_before", "_inside")


def evict(entries: DataFrame, now: Column, ttl: float, cap: float) -> DataFrame:
    """entries(session, mtime, size) -> session, evicted: too old, or among the oldest while the rest exceeds cap."""
    aged = entries.withColumn("old", now - F.col("mtime") > ttl)
    # Newest first: a session stays while it and all newer ones fit.
    summed = running_sum(aged, [F.col("old").asc(), F.desc("mtime"), F.desc("session")], "size", "sum")
    return summed.select("session", (F.col("old") | (F.col("sum") > cap)).alias("evicted"))


def admit(uploads: DataFrame, capacity: int) -> DataFrame:
    """uploads(session, ord, hash) with admitted: first of each hash, in order, while capacity lasts. (session, ord) is a key.

    Only the first rows of hashes are ranked, at most `capacity` a task and session reach the shuffle.
    """
    first = uploads.groupBy("session", "hash").agg(F.min("ord").alias("ord"))
    ranked = first.withColumn("rn", F.row_number().over(Window.partitionBy("session").orderBy("ord"))).where(F.col("rn") <= capacity)
    let = ranked.select("session", "ord", F.lit(True).alias("admitted"))
    return uploads.join(let, ["session", "ord"], "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))
