"""Benchmark decontamination by an FM-index for each training shard.

A shard is a batch of whole documents. Its text is the sequence of word ids; words that no benchmark item
has become separators, and runs between separators that are shorter than the shortest test phrase hold no
occurrence and are left out. Over the rest stand a suffix array (prefix doubling; every separator is unique),
its Burrows-Wheeler transform in a wavelet matrix, and sampled suffix positions. All test phrases are
searched backward at once through wavelet ranks, their rows are located by walking to a sampled row, and
the spans found are merged for each document.

Only the benchmark is sent to the executors, in blocks of at most BLOCK_WORDS words. A pass over the documents,
one narrow map, searches TURN blocks; for each further turn the documents and the spans found so far are
written and read again. Neither documents nor hits are ever shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import covered, groups, trim, utf8, written

#: Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
PHRASE = 10
BLOCK_WORDS = 1_000_000
TURN = 4
SHARD_CHARS = 3_000_000
SAMPLE = 8


def item_words(text: str) -> list[bytes]:
    return utf8(text).translate(TABLE).split()


class WaveletMatrix:
    """Rank and access over a sequence of small integers, vectorised over queries."""

    def __init__(self, seq: np.ndarray, sigma: int) -> None:
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        starts = np.zeros(sigma, np.int64)
        symbols = np.arange(sigma)
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            zeros = len(seq) - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            high = (symbols >> b) & 1 == 1
            before = ones[starts]
            starts = np.where(high, zeros + before, starts - before)
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.starts = starts

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place upto."""
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[upto]
            upto = np.where((symbol >> (self.bits - 1 - level)) & 1 == 1, zeros + before, upto - before)
        return upto - self.starts[symbol]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros, strict=True):
            before = ones[at].astype(np.int64)
            bit = ones[at + 1] - before
            at = np.where(bit == 1, zeros + before, at - before)
            symbol = 2 * symbol + bit
        return symbol, at - self.starts[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; each separator (0) is less than all words and unique, in order of place. text ends with one."""
    n = len(text)
    ends = text == 0
    rank = np.where(ends, np.cumsum(ends) - 1, text.astype(np.int64) + int(ends.sum()))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * np.int64(int(rank.max()) + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        rank[order] = new
        if new[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, sigma: int) -> None:
        sa = suffix_array(text)
        self.n = len(text)
        bwt = text[sa - 1]
        self.tree = WaveletMatrix(bwt, sigma)
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=sigma))][:-1]
        # Rows after a separator are sampled too, so that no walk crosses one.
        sampled = (sa % SAMPLE == 0) | (bwt == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled) - 1
        self.samples = sa[sampled]

    def search(self, phrases: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of each phrase (right-aligned, padded in front)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1]):
            live = np.flatnonzero((hi > lo) & (step < lens))
            if not len(live):
                break
            symbol = phrases[live, phrases.shape[1] - 1 - step]
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
        return lo, np.maximum(hi, lo)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text place of each row."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        walk = np.flatnonzero(~self.sampled[rows])
        while len(walk):
            symbol, before = self.tree.access(rows[walk])
            rows[walk] = self.first[symbol] + before
            steps[walk] += 1
            walk = walk[~self.sampled[rows[walk]]]
        return self.samples[self.sample_rank[rows]] + steps


class Phrases:
    """Test phrases of a benchmark block: 10 successive words of an item, or all words of a shorter one."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in item_words(text or "")]
            for k in range(max(1, len(ids) - PHRASE + 1)) if ids else ():
                owners.setdefault(tuple(ids[k : k + PHRASE]), set()).add(item)
        self.owners = [sorted(x) for x in owners.values()]
        self.lens = np.array([len(x) for x in owners], np.int64)
        self.table = np.zeros((len(owners), PHRASE), np.int64)
        for k, x in enumerate(owners):
            self.table[k, PHRASE - len(x) :] = x
        self.shortest = int(self.lens.min()) if len(owners) else 0

    def find(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word, phrase) of all occurrences in the texts of a shard, and the texts' numbers of words."""
        words, lens = [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                words += (own := item_words(text))
                lens[k] = len(own)
        none = np.zeros(0, np.int64)
        if not len(self.lens) or not words:
            return none, none, none, lens
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, len(words))
        # A separator after each document, then the runs of benchmark words that can hold a phrase.
        doc = np.repeat(np.arange(len(texts)), lens)
        line = np.zeros(len(ids) + len(texts) + 1, np.int32)
        line[1 + np.arange(len(ids)) + doc] = ids
        edge = np.diff((line != 0).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
        long = end - begin >= self.shortest
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return none, none, none, lens
        run = np.repeat(np.arange(len(begin)), size + 1)
        origin = np.arange(len(run)) - np.repeat(np.cumsum(size + 1) - size - 1, size + 1) + begin[run]
        text = line[origin]
        text[np.cumsum(size + 1) - 1] = 0
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.search(self.table, self.lens)
        phrase = np.repeat(np.arange(len(lo)), hi - lo)
        rows = np.arange(len(phrase)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[phrase]
        place = origin[index.locate(rows)] - 1
        border = np.cumsum(lens + 1)
        at = np.searchsorted(border, place, side="right")
        return at, place - (border - lens - 1)[at], phrase, lens


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows again, in batches of about SHARD_CHARS characters of text (or one longer text)."""

    def whole() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = np.array([len(t) if t else 0 for t in batch.column("text").to_pylist()]) + 64
        for a, b in groups(np.cumsum(sizes) // SHARD_CHARS):
            held.append(batch.slice(a, b - a))
            size += int(sizes[a:b].sum())
            if size >= SHARD_CHARS:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def _mark(batches: Iterator[pa.RecordBatch], blocks: list[Broadcast[Phrases]], names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Adds the blocks' spans (pairs of word numbers) and items to each row's."""
    for shard in _shards(batches):
        texts = shard.column("text").to_pylist()
        spans = [list(x) for x in shard.column(names[0]).to_pylist()]
        items = [set(x) for x in shard.column(names[1]).to_pylist()]
        for phrases in (b.value for b in blocks):
            at, word, phrase, lens = phrases.find(texts)
            order = np.lexsort((word, at))
            at, word, phrase = at[order], word[order], phrase[order]
            for a, b in groups(at):
                hit = covered(int(lens[at[a]]), np.zeros(0, np.int64), 1)
                for size in np.unique(phrases.lens[phrase[a:b]]):
                    hit |= covered(len(hit), word[a:b][phrases.lens[phrase[a:b]] == size], int(size))
                spans[at[a]] += np.flatnonzero(np.diff(np.r_[0, hit.astype(np.int8), 0])).tolist()
                items[at[a]].update(x for p in np.unique(phrase[a:b]).tolist() for x in phrases.owners[p])
        columns = dict(zip(shard.schema.names, shard.columns, strict=True))
        columns[names[0]] = pa.array(spans, pa.list_(pa.int32()))
        columns[names[1]] = pa.array([sorted(x) for x in items], pa.list_(pa.string()))
        columns[names[2]] = pa.array(lens, pa.int64())
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        del texts, spans, items, columns
        trim()


def merged(spans: list[int]) -> list[tuple[int, int]]:
    """Sorted disjoint [start, end) of a flat list of starts and ends."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[int]) -> str:
    """The text without the characters from the first to the last word of each span."""
    words = [m.span() for m in WORD.finditer(text)]
    out, done = [], 0
    for a, b in merged(spans):
        out.append(text[done : words[a][0]])
        done = words[b - 1][1]
    return "".join(out) + text[done:]


def _marked(docs: DataFrame, benchmark: DataFrame, finish: Callable[[Iterator[pa.RecordBatch], tuple[str, str, str]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """docs with spans, items and numbers of words in three columns more, after finish(batches, names of these columns)."""
    spark = docs.sparkSession
    names = ("_spans", "_items", "_words")
    while set(names) & {c.lower() for c in docs.columns}:
        names = tuple(f"_{n}" for n in names)
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = 1 + total // (2 * BLOCK_WORDS)  # a word and its border are two characters at least
    out = docs.withColumns({names[0]: F.array().cast("array<int>"), names[1]: F.array().cast("array<string>"), names[2]: F.lit(0).cast("long")})
    full = T.StructType([T.StructField(f.name, f.dataType) for f in out.schema])
    for turn in range(0, count, TURN):
        if turn:
            out = written(out.mapInArrow(lambda it, blocks=blocks: _mark(it, blocks, names), full), "marked")  # noqa: F821
        blocks = []
        for k in range(turn, min(turn + TURN, count)):
            block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else items
            blocks.append(spark.sparkContext.broadcast(Phrases([tuple(r) for r in block.collect()])))  # about BLOCK_WORDS words
    return out.mapInArrow(lambda it: finish(_mark(it, blocks, names), names), schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Occurrences of test phrases of benchmark(item_id, text) in docs(doc_id, text, ...), one row per input row.

    Returns doc_id, n_words, n_hit (words inside an occurrence), n_items, items_sha256 (hex digest of the
    items' ids, sorted as strings and comma-joined), contaminated and items. Words: A-Z lower-cased, runs
    outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]. A phrase is 10 successive words of an item, or all words of a
    shorter one; items that are null or without a word have none. A null or empty text has no words. Items
    that repeat count once by id; a null item_id is called "null". Rows that repeat get equal rows; a null
    doc_id stays null; further columns are ignored; an empty table or benchmark gives no hits.
    """

    def rows(batches: Iterator[pa.RecordBatch], names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = batch.column(names[0]).to_pylist(), batch.column(names[1]).to_pylist()
            hit = [sum(b - a for a, b in merged(x)) for x in spans]
            digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column(names[2]), pa.array(hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([h > 0 for h in hit], pa.bool_()), batch.column(names[1])],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"],
            )

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"
    return _marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, rows, schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with all columns, each text without its merged spans of test phrases; n_chars, if there, is set anew for changed texts.

    Nulls, repeated rows, empty tables: as contamination(). Texts without an occurrence stay as they are.
    """

    def rows(batches: Iterator[pa.RecordBatch], names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(names[0]).to_pylist()
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in names}
            columns["text"] = pa.array([without(t, s) if s else t for t, s in zip(columns["text"].to_pylist(), spans, strict=True)], pa.string())
            if "n_chars" in columns:
                sizes = [len(t) if s else n for t, s, n in zip(columns["text"].to_pylist(), spans, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return _marked(docs, benchmark, rows, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))
