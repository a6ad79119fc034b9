"""Mixing sources to target weights by subset-sum budget fitting.

A source's target T in words is fitted with whole documents: every document is taken floor(T / size of the
source) times, and the rest R of the budget takes a subset of the documents once more. For the subset,
documents are counted by exact length. Of every length, the share R / size is taken; what remains of the
budget is filled greedily, long lengths first, down to what a bounded knapsack takes: a dynamic programme
over all lengths that are left (with their counts) reaches the largest sum within that last remainder; the
greedy part before it is not searched for a better one. Which documents of a length are taken is a seeded draw.

Only (source, length, count) rows go to the programme. Documents of one length are ranked within salted
cells, whose counts give each cell its offset: no task sorts a whole source or a whole length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Words of budget that the last step's dynamic programme takes on.
KNAPSACK_WORDS = 1 << 16


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes(source, source_size), one row per source -> source, source_size, target.

    Sources in order of code point (null last) have the weights in turn. The targets share `share` times all
    words by weight; one above `most` times its source's size stops there and the others share its excess.
    With the sources in order of cap / weight, the level (words for each unit of weight) after the first k
    stop is (total - their caps) / (weights of the others); a source stops if its cap / weight is below its
    level. One row for each source is all that the unpartitioned windows see.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("weight", F.get(weight, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))))
    cap = F.col("source_size") * float(most)
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = ranked.withColumns({
        "total": F.sum("source_size").over(everything) * float(share),
        "level": (F.sum("source_size").over(everything) * float(share) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    })
    stopped = level.withColumn("stops", F.col("level") * F.col("weight") > cap)
    common = F.min(F.when(~F.col("stops"), F.struct(F.col("source_size") / F.col("weight"), F.col("level").alias("level")))).over(everything)
    return stopped.withColumn("common", common["level"]).select("source", "source_size", F.when(F.col("stops") | F.col("common").isNull(), cap).otherwise(F.least(cap, F.col("common") * F.col("weight"))).alias("target"))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length make the largest sum of at most `budget`; bounded knapsack over reachable sums as bits of an integer."""
    mask = (1 << (budget + 1)) - 1
    stages = [(1, 0, 0)]
    reach = 1
    for k, (length, count) in enumerate(zip(lengths, counts, strict=True)):
        left, step = min(count, budget // length), 1
        while left > 0:
            take = min(step, left)
            more = reach | (reach << (length * take)) & mask
            # Only steps that reach a new sum are kept; their number stays small, however many lengths there are.
            if more != reach:
                reach = more
                stages.append((reach, k, take))
            left -= take
            step *= 2
        if reach >> budget:
            break
    out, at = [0] * len(lengths), reach.bit_length() - 1
    for k in range(len(stages) - 1, 0, -1):
        before = stages[k - 1][0]
        if not before >> at & 1:
            _, which, take = stages[k]
            out[which] += take
            at -= lengths[which] * take
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length (ascending, above 0) to take for a sum near the budget."""
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    budget = int(round(budget))
    taken = np.minimum((counts * (budget / total if total else 0)).astype(np.int64), counts)
    left = budget - int((lengths * taken).sum())
    # One document more of a length after the other, long ones first, until the programme can take over.
    for k in range(len(lengths) - 1, -1, -1):
        if left <= KNAPSACK_WORDS // 2:
            break
        more = min(int(counts[k] - taken[k]), (left - KNAPSACK_WORDS // 4) // int(lengths[k]))
        if more > 0:
            taken[k] += more
            left -= more * int(lengths[k])
    free = np.flatnonzero((counts > taken) & (lengths <= left))
    # With more left than the programme takes, each free length is above three quarters of it: the longest that fits is the best sum.
    if left > KNAPSACK_WORDS or not len(free):
        for k in free[::-1]:
            more = min(int(counts[k] - taken[k]), left // int(lengths[k]))
            taken[k] += more
            left -= more * int(lengths[k])
        return nearer(lengths, counts, taken, budget)
    more = knapsack(lengths[free].tolist(), (counts - taken)[free].tolist(), left)
    taken[free] += np.array(more)
    return nearer(lengths, counts, taken, budget)


def nearer(lengths: np.ndarray, counts: np.ndarray, taken: np.ndarray, budget: int) -> np.ndarray:
    """With the shortest document that is left too, if that brings the sum nearer to the budget."""
    left, rest = budget - int((lengths * taken).sum()), np.flatnonzero(counts > taken)
    if left > 0 and len(rest) and lengths[rest[0]] < 2 * left:
        taken[rest[0]] += 1
    return taken


def _plan(frame: pd.DataFrame) -> pd.DataFrame:
    """Histogram of one source -> copies that all its documents have, and how many of each length have one more."""
    frame = frame.sort_values("size", kind="stable").reset_index(drop=True)
    size, target = float(frame["source_size"].iloc[0]), float(frame["target"].iloc[0])
    copies = int(target // size) if size else 0
    extra = fit(frame["size"].to_numpy(np.int64), frame["n"].to_numpy(np.int64), target - copies * size)
    return frame[["source_key", "size"]].assign(copies=copies, extra=extra)


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source, ...) -> doc_id, row_key, size, source, source_size, target, copies, taken.

    One row per input row; size: words [^\\x20\\x09-\\x0D]+ (null: 0); taken = copies * size. A document of no
    words is never taken. Null sources are one source, last in order; a null doc_id is drawn like any other.
    row_key is a hash of doc_id and text; rows that repeat share it and are drawn one by one. An empty table
    gives an empty result. Reruns give the same rows.
    """
    spark = docs.sparkSession
    salts = 4 * partitions(spark)
    sized = written(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source",
        F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("row_key"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source_key"),
    ), "sized")
    rows = sized.withColumn("draw", F.xxhash64(F.lit(seed), "row_key")).withColumn("salt", F.pmod("draw", F.lit(salts)))
    cells = rows.groupBy("source_key", "size", "salt").agg(F.count(F.lit(1)).alias("cell"))
    cells = written(cells, "cells")
    sources = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    aims = targets(sources.select("source", "source_size"), weights, share, most).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    lengths = cells.where("size > 0").groupBy("source_key", "size").agg(F.sum("cell").alias("n")).join(aims.drop("source"), "source_key")
    plan = lengths.groupBy("source_key").applyInPandas(_plan, "source_key string, size long, copies int, extra long")
    earlier = Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("offset", F.coalesce(F.sum("cell").over(earlier), F.lit(0))).join(plan, ["source_key", "size"])
    offsets = offsets.join(aims, "source_key").select("source_key", "size", "salt", "offset", "copies", "extra", "source_size", "target")
    in_cell = Window.partitionBy("source_key", "size", "salt").orderBy("draw", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(in_cell))
    empty = rows.where("size = 0").join(aims.drop("source"), "source_key")
    taken = ranked.where("size > 0").join(offsets, ["source_key", "size", "salt"]).withColumn("copies", F.col("copies") + F.when(F.col("rank") + F.col("offset") <= F.col("extra"), 1).otherwise(0))
    columns = ["doc_id", "row_key", "size", "source", "source_size", "target"]
    return taken.select(*columns, "copies").unionByName(empty.select(*columns, F.lit(0).alias("copies"))).withColumn("taken", F.col("copies") * F.col("size"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs with all columns, each row as often as the mix takes it (0, 1 or 2 times)."""
    plan = mix_plan(docs, **options).where("copies > 0")
    # Rows of equal id and text are alike: each gets the copies of one of them.
    number = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*by))
    keep = docs.columns
    names = [f"c{k}" for k in range(len(keep))]
    rows = docs.toDF(*names).withColumn("row_key", F.xxhash64(f"c{keep.index('doc_id')}", f"c{keep.index('text')}"))
    rows = rows.withColumn("tie", number("row_key"))
    counts = plan.select("row_key", "copies").withColumn("tie", number("row_key"))
    joined = rows.join(counts.hint("shuffle_hash"), ["row_key", "tie"])
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(n).alias(k) for n, k in zip(names, keep, strict=True)])
