"""Exact n-gram Jaccard join as a blocked sparse product, and the groups of near-duplicates it links.

Distinct sets of word n-grams are rows, n-grams are columns of a 0/1 matrix A; overlap counts are the entries
of A * A^T. Columns are ordered by a frequency sketch of fixed size, rare ones first, and dealt to blocks.

* A row of n entries takes part in the product with its first n - ceil(s * n) + 1 columns: a pair whose rows
  share none of these cannot reach similarity s.
* A shared column at places i and j of rows of n and m entries leaves an overlap of min(n - i, m - j) at most
  if it is their first one. Below what s asks of n and m the pair is not formed there; its first shared
  column decides.
* The counts of a pair are added up over all blocks; the count up to its last shared column of the product and
  what is left of both rows behind it bound the overlap again. Then parity signatures do, and the
  pairs that are left are the mask of the second product, of whole rows, which gives their exact overlap.

Groups need connectivity, not every pair. The first pass pairs each row only with one row (hub) of each of its
columns: of the rows of like size, the one with the fewest rarer columns, which is the middle of a group of
copies. The second pass pairs, within each column, only rows of different merged groups, and never two rows of
the column's largest group: a group of thousands of copies is settled by its hub, while no link between
different groups is lost. Of these pairs, the likeliest of each row are counted first; then all whose rows
are still in different groups.

Equal sets are one row of the matrix. A column that the sketch shows in very many rows is dealt to several
blocks by row, so that no block holds an unbounded column.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BASES, bounded, cleaned, free_name, groups, guarded, hashed_words, low, lower_words_of, mix, partitions, planes, small_batches, trim, unplanes, wide, window_hashes, window_starts, written,
)

SKETCH = 1 << 22
SLICES = 64
#: Entries of the product in a block, and of one column in a piece of it.
BLOCK, PIECE = 300_000, 500_000
#: Up to so many pairs of row ids (5 MB) are broadcast to the scan of the rows; beyond, that join shuffles.
BROADCAST_IDS = 300_000
ENTRY = "block int, cols binary, nodes binary, sizes binary, places binary"


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; a text of fewer words has its whole sequence as one."""
    words, lens = hashed_words(texts, lower_words_of)
    hashes = window_hashes(words, width)
    start, _ = window_starts(lens, width)
    hashes = hashes[start]
    count = np.maximum(lens - width + 1, 0)
    end = np.cumsum(count)
    ends = np.cumsum(lens)
    out = []
    for k, (a, b) in enumerate(zip(end - count, end, strict=True)):
        if a < b:
            out.append(np.unique(hashes[a:b]))
        elif lens[k]:
            short = window_hashes(words[ends[k] - lens[k] : ends[k]], int(lens[k]))
            out.append(mix(short + lens[k : k + 1].astype(np.uint64) * np.uint64(BASES[1])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _signature(shingles: np.ndarray) -> bytes:
    """Parity bits, a power of two from n on; two sets differ in at least as many shingles as their signatures differ in bits."""
    size = max(512, 1 << int(len(shingles) - 1).bit_length())
    bits = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1
    return np.packbits(bits).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """In how many bits two signatures differ; the longer one is folded to the length of the other."""
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(np.frombuffer(x, np.uint8).reshape(-1, len(y)), axis=0).tobytes()
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def _rows(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for frame in bounded(batches, "text", 1_000_000):
        sets = shingle_sets(list(frame["text"]), width)
        rows, seen = [], set()
        for none, s in zip(frame["no_id"].tolist(), sets, strict=True):
            data = s.tobytes()
            digest = xxhash.xxh3_128_digest(data) if len(s) else None
            # Of equal sets in a batch only one carries its shingles; the digest links the others.
            carries = len(s) > 0 and digest not in seen and not none
            if carries:
                seen.add(digest)
            rows.append((len(s), digest, carries, low(s >> np.uint64(16), 6) if carries else None, _signature(s) if carries else None))
        out = pd.DataFrame(rows, columns=["n_shingles", "digest", "carries", "shingles", "sign"])
        yield out.assign(doc_id=frame["doc_id"], no_id=frame["no_id"])


def _sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of hashed shingles by slice: a fixed number of counters whatever the input."""
    counts = np.zeros(SKETCH, np.uint32)
    some = False
    for frame in batches:
        for data in frame["shingles"]:
            counts[wide(data, 6) & np.uint64(SKETCH - 1)] += 1
            some = True
    for k, part in enumerate(counts.reshape(SLICES, -1) if some else ()):
        # Most counts of a task are small: three of the four planes are zeros, and the first has few values.
        yield pd.DataFrame({"slice": [k], "counts": [zlib.compress(planes(part, "<u4"), 1)]})
    del counts
    trim()


def _add_slices(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH // SLICES, np.int64)
    for counts in frame["counts"]:
        total += unplanes(zlib.decompress(counts), "<u4")
    # A logarithmic scale keeps the order and fits a byte for each counter.
    return pd.DataFrame({"slice": frame["slice"].iloc[:1], "levels": [np.minimum(np.log2(total + 1) * 6, 255).astype(np.uint8).tobytes()]})


class Levels:
    """What the sketch says of columns: their order, and over how many pieces a frequent one is dealt."""

    def __init__(self, data: bytes, entries: int, piece: int) -> None:
        self.level = np.frombuffer(data, np.uint8)
        # The mean count of a cell is noise of all the columns that share it.
        above = np.exp2(np.arange(256) / 6.0) - 2.0 * entries / SKETCH
        self.pieces = np.maximum(np.ceil(above / piece), 1).astype(np.int64)

    def rarity(self, columns: np.ndarray) -> np.ndarray:
        return self.level[columns & np.uint64(SKETCH - 1)]

    def spread(self, columns: np.ndarray) -> np.ndarray:
        return self.pieces[self.rarity(columns)]


def prefix(n: int, percent: int) -> int:
    """How many columns of a row of n take part in the product."""
    return n - (percent * n + 99) // 100 + 1


def _dealt(parts: list[tuple], levels: Levels, blocks: int) -> pd.DataFrame:
    col, node, n, place = (np.concatenate([p[k] for p in parts]) for k in range(4))
    piece = (mix(node.view(np.uint64)) >> np.uint64(8)).astype(np.int64) % levels.spread(col)
    block = ((col >> np.uint64(20)).astype(np.int64) + piece * 7919) % blocks
    order = np.argsort(block, kind="stable")
    rows = []
    for a, b in groups(block[order]):
        at = order[a:b]
        rows.append((int(block[at[0]]), low(col[at], 6), planes(np.diff(node[at], prepend=0), "<i8"), planes(n[at], "<u4"), planes(place[at], "<u4")))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])


def _entries(batches: Iterator[pd.DataFrame], levels: Levels, percent: int, blocks: int) -> Iterator[pd.DataFrame]:
    parts, held = [], 0
    for frame in batches:
        for node, data in zip(frame["row"], frame["shingles"], strict=True):
            s = wide(data, 6)
            n, keep = len(s), prefix(len(s), percent)
            # The order is (level, hash); s is sorted by hash already.
            s = s[np.argsort(levels.rarity(s), kind="stable")[:keep]]
            parts.append((s, np.full(keep, node), np.full(keep, n), np.arange(keep)))
            held += keep
            if held >= BLOCK:
                yield _dealt(parts, levels, blocks)
                parts, held = [], 0
    if parts:
        yield _dealt(parts, levels, blocks)
    parts.clear()
    trim()


def _block(frame: pd.DataFrame, levels: Levels, percent: int) -> pd.DataFrame:
    """One block of columns: its entries that can meet another row, and the hub of each (itself: none)."""
    col = np.concatenate([wide(x, 6) for x in frame["cols"]])
    node = np.concatenate([np.cumsum(unplanes(x, "<i8")) for x in frame["nodes"]])
    n = np.concatenate([unplanes(x, "<u4") for x in frame["sizes"]]).astype(np.int64)
    place = np.concatenate([unplanes(x, "<u4") for x in frame["places"]]).astype(np.int64)
    order = np.lexsort((node, n, col))
    col, node, n, place = col[order], node[order], n[order], place[order]
    # In the order of sizes, a row that fits any row of the column fits its neighbour.
    meets = (col[1:] == col[:-1]) & (n[:-1] * 100 >= n[1:] * percent)
    keep = np.r_[meets, False] | np.r_[False, meets] | (levels.spread(col) > 1)
    col, node, n, place = col[keep], node[keep], n[keep], place[keep]
    # Rows of sizes in one band fit each other.
    band = np.floor(np.log(n) / max(np.log(100 / percent), 1e-3))
    part = np.cumsum(np.r_[True, (col[1:] != col[:-1]) | (band[1:] != band[:-1])][: len(col)]) - 1
    hub = node.copy()
    if len(col):
        by = np.lexsort((node, place, part))
        first = by[np.flatnonzero(np.r_[True, part[by][1:] != part[by][:-1]])][part]
        small, large = np.minimum(n, n[first]), np.maximum(n, n[first])
        most = np.minimum(n - place, n[first] - place[first])
        hub = np.where((small * 100 >= large * percent) & (most * 100 >= percent * (n + n[first] - most)), node[first], node)
    return pd.DataFrame({"col": col.view(np.int64), "node": node, "n": n, "place": place, "hub": hub})


def _likely(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    """The pairs whose sizes and signatures allow the similarity."""
    for frame in batches:
        differ = np.array([_differ(a, b) for a, b in zip(frame.pop("a_sign"), frame.pop("b_sign"), strict=True)], np.int64)
        # Similarity p % allows a symmetric difference of (100 - p) / (100 + p) of both sizes.
        allowed = (frame.pop("a_n_shingles") + frame.pop("b_n_shingles")).to_numpy()
        yield frame[differ * (100 + percent) <= allowed * (100 - percent)]
    trim()


def _overlaps(batches: Iterator[pd.DataFrame], percent: int) -> Iterator[pd.DataFrame]:
    for frame in batches:
        good = []
        for a, b in zip(frame["sa"], frame["sb"], strict=True):
            x, y = np.unique(wide(a, 6)), np.unique(wide(b, 6))
            both = len(np.intersect1d(x, y, assume_unique=True))
            good.append(100 * both >= percent * (len(x) + len(y) - both))
        yield frame.loc[np.array(good, bool), ["a", "b"]]
    trim()


class Join:
    """The steps of the join over one table; rows are written once and read by each step.

    A node is a distinct set: the number of the first row that has it. members: (row, doc_id, n_shingles, node)
    of every input row; its node is null without words or without an id.
    """

    def __init__(self, docs: DataFrame, width: int, percent: int, piece: int = PIECE) -> None:
        self.spark, self.percent, self.piece = docs.sparkSession, percent, piece
        small_batches(self.spark)
        schema = "doc_id long, no_id boolean, n_shingles long, digest binary, carries boolean, shingles binary, sign binary"
        made = guarded(docs, "text").mapInPandas(lambda it: _rows(it, width), schema)
        self.rows = written(made.withColumn("row", F.monotonically_increasing_id()), "rows")
        sets = self.rows.where("carries").groupBy("digest").agg(F.min("row").alias("node"))
        # Rows without words have a digest of their own here, so that they do not meet in one task.
        known = self.rows.select("row", "doc_id", "no_id", "n_shingles", "carries", F.coalesce("digest", F.col("row").cast("string").cast("binary")).alias("digest")).join(sets, "digest", "left")
        own = [F.when(~F.col("no_id"), F.col(c)).alias(c) for c in ("doc_id", "node")]
        self.members = written(known.select("row", "n_shingles", "carries", *own), "members")

    def sets(self) -> DataFrame:
        """(row, n_shingles, shingles): each distinct set once."""
        again = self.members.where("carries and row <> node").select("row")
        return self.rows.where("carries").select("row", "n_shingles", "shingles").join(self.small(again), "row", "left_anti")

    @staticmethod
    def small(ids: DataFrame) -> DataFrame:
        """The rows of ids, to be broadcast if they are few enough."""
        return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def columns(self) -> DataFrame:
        """(col, node, n, place, hub) of the entries of the product that can meet another row."""
        percent = self.percent
        full = self.sets()
        sums = full.select("shingles").mapInPandas(_sketch, "slice int, counts binary").groupBy("slice").applyInPandas(_add_slices, "slice int, levels binary")
        data = bytearray(SKETCH)
        step = SKETCH // SLICES
        for row in sums.collect():  # SKETCH bytes at most
            data[row.slice * step : (row.slice + 1) * step] = row.levels
        taken = f"n_shingles - ceil({percent} * n_shingles / 100) + 1"
        count = self.members.where("row = node").agg(F.expr("coalesce(sum(n_shingles), 0) as all"), F.expr(f"coalesce(cast(sum({taken}) as long), 0) as taken")).first()
        blocks = max(partitions(self.spark), count["taken"] // BLOCK + 1)
        shared = self.spark.sparkContext.broadcast(bytes(data))
        of = (count["all"], self.piece)
        dealt = full.select("row", "shingles").mapInPandas(lambda it: _entries(it, Levels(shared.value, *of), percent, blocks), ENTRY)
        product = dealt.groupBy("block").applyInPandas(lambda f: _block(f, Levels(shared.value, *of), percent), "col long, node long, n int, place int, hub long")
        return written(product, "columns")

    def met(self, pairs: DataFrame, *values: str) -> DataFrame:
        """Written pairs (a, b, ...) with the values of both rows (a_..., b_...). Only rows of pairs are shuffled, each second row once."""
        rows = self.rows.select("row", *values)
        side = lambda x: [F.col(v).alias(f"{x}_{v}") for v in values]
        left = rows.join(self.small(pairs), F.col("row") == F.col("a")).select(*pairs.columns, *side("a"))
        right = rows.join(self.small(pairs.select("b").distinct()), F.col("row") == F.col("b")).select("b", *side("b"))
        return left.join(right, "b")

    def near_enough(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, ...), written, whose sizes and signatures allow the similarity."""
        pairs, percent = written(pairs, "pairs"), self.percent
        both = self.met(pairs, "n_shingles", "sign").drop("row")
        return written(both.mapInPandas(lambda it: _likely(it, percent), pairs.schema).select(*pairs.columns), "near")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The written pairs (a, b) whose overlap, counted in full, reaches the similarity."""
        percent = self.percent
        both = self.met(pairs.select("a", "b"), "shingles").select("a", "b", F.col("a_shingles").alias("sa"), F.col("b_shingles").alias("sb"))
        return both.mapInPandas(lambda it: _overlaps(it, percent), "a long, b long")

    def enough(self, overlap: F.Column, a: str, b: str) -> F.Column:
        return overlap * 100 >= (F.col(a) + F.col(b) - overlap) * self.percent

    def first_links(self, columns: DataFrame) -> DataFrame:
        """Links of rows to one hub each: of the hubs of their columns, the one met most often."""
        shared = columns.where("hub <> node").groupBy("node", "hub").agg(F.count(F.lit(1)).alias("shared"))
        best = shared.groupBy("node").agg(F.max_by("hub", F.struct("shared", -F.col("hub"))).alias("b"))
        return self.verified(self.near_enough(best.select(F.col("node").alias("a"), "b")))

    def other_pairs(self, columns: DataFrame, grouped: DataFrame) -> DataFrame:
        """(a, b, shared): all pairs of rows of different groups that can be near enough; grouped: (node, component)."""
        named = columns.select("col", "node", "n", "place").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = named.groupBy("col").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("col")
        named = written(named.join(mixed, "col"), "named")
        sizes = named.groupBy("col", "component").agg(F.count(F.lit(1)).alias("size"))
        largest = sizes.groupBy("col").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
        left = named.join(largest, "col").where("component <> largest").select("col", "largest", *[F.col(x).alias(f"a_{x}") for x in ("node", "n", "place", "component")])
        right = named.select("col", *[F.col(x).alias(f"b_{x}") for x in ("node", "n", "place", "component")])
        # If this is the first column that both share, so much overlap is left.
        most = F.least(F.col("a_n") - F.col("a_place"), F.col("b_n") - F.col("b_place"))
        apart = (F.col("a_component") != F.col("b_component")) & ((F.col("b_component") == F.col("largest")) | (F.col("a_node") < F.col("b_node")))
        pairs = left.join(right, "col").where(apart & self.enough(most, "a_n", "b_n"))
        # The largest group varies from column to column, and with it the side of a row: a pair is counted over both orders.
        turned = F.col("a_node") > F.col("b_node")
        counted = pairs.groupBy(F.least("a_node", "b_node").alias("x"), F.greatest("a_node", "b_node").alias("y")).agg(F.count(F.lit(1)).alias("shared"), F.count_if(turned).alias("turned"))
        # The order met more often stays, so that a row outside a large group has one likeliest pair with it.
        kept = F.col("turned") * 2 > F.col("shared")
        sides = [F.when(kept, F.col(p)).otherwise(F.col(q)).alias(side) for side, p, q in (("a", "y", "x"), ("b", "x", "y"))]
        return self.near_enough(counted.select(*sides, "shared"))

    @staticmethod
    def apart(pairs: DataFrame, grouped: DataFrame) -> DataFrame:
        """The pairs whose rows are in different groups."""
        for side in ("a", "b"):
            pairs = pairs.join(grouped.select(F.col("node").alias(side), F.col("component").alias(f"{side}_in")), side, "left")
        return pairs.where(F.coalesce("a_in", "a") != F.coalesce("b_in", "b")).drop("a_in", "b_in")

    @staticmethod
    def merged(grouped: DataFrame, links: DataFrame) -> DataFrame:
        links = written(links.select("a", "b"), "links")
        return connected(grouped.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b").union(links)) if links.head(1) else grouped

    def components(self) -> DataFrame:
        """(node, component) of every set that is linked with another one."""
        of_ids = self.members.where("node is not null")
        several = of_ids.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top").select("doc_id", "b")
        same = of_ids.select("doc_id", F.col("node").alias("a")).join(several, "doc_id").where("a <> b").select("a", "b")
        columns = self.columns()
        grouped = connected(written(same.union(self.first_links(columns)), "links"))
        # Each row's likeliest pair first: it settles most groups, and the other pairs within these need no count.
        pairs = self.other_pairs(columns, grouped)
        best = written(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", -F.col("b"))).alias("b")), "best")
        grouped = self.merged(grouped, self.verified(best))
        rest = self.apart(pairs, grouped).join(best, ["a", "b"], "left_anti")
        return self.merged(grouped, self.verified(written(rest.select("a", "b"), "rest")))

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every input row."""
        sets = self.members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("top"))
        linked = sets.join(self.components(), "node", "left").where("component is not null or least <> top").withColumn("component", F.coalesce("component", "node"))
        named = linked.join(linked.groupBy("component").agg(F.min("least").alias("id")), "component").select("node", "id")
        out = self.members.withColumn("node", F.coalesce("node", -1 - F.col("row"))).join(named, "node", "left")
        return out.select("doc_id", "n_shingles", F.coalesce("id", "doc_id").alias("component_id"))


def connected(links: DataFrame) -> DataFrame:
    """(node, component): component is the least node that links (a, b) reach. Nodes without links are left out.

    Alternating large-star and small-star steps (Kiveris et al., "Connected Components in MapReduce and
    Beyond", 2014): each step sends every neighbour of a node to the least node of its neighbourhood, until
    all links point to the least node of their component.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        sent = both.join(least, "a")
        if large:
            return sent.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return sent.select(F.col("b").alias("a"), F.col("m").alias("b")).union(sent.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    while True:
        edges = written(star(star(edges, True), False), "stars")
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups docs(doc_id, text, ...) by links of Jaccard similarity >= percent / 100 between word n-gram sets.

    Texts are lower-cased (A-Z) and split into words [^\\x20\\x09-\\x0D]+; a set holds the distinct runs of
    `width` words, or the whole sequence of a shorter text. Returns doc_id, n_shingles and component_id (least
    doc_id reachable by links, itself included), one row per input row. A null, empty or blank text has an
    empty set and links with nothing: its component_id is its doc_id. Equal sets are linked. Rows with words
    that share a doc_id are linked, whatever their texts. A null doc_id takes no part: its component_id is
    null. Further columns are ignored. An empty table gives an empty result. Sets are compared by hashes:
    64 bits of each n-gram tell those of one row apart, 48 bits those of a pair.
    """
    with cleaned(docs.sparkSession):
        return written(Join(docs, width, percent).documents(), "components", keep=True)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with all their columns, without each row whose group has a smaller doc_id.

    Rows with a null doc_id or an empty text are kept, unless a row of that id goes; rows that repeat with an
    equal doc_id are all kept or all gone.
    """
    grouped = jaccard_groups(docs.select("doc_id", "text"), width, percent)
    name = free_name(docs)
    gone = grouped.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(Join.small(gone), F.col("doc_id") == F.col(name), "left_anti")
