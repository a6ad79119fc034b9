"""Substring dedup over a log-structured index of window hashes.

A window is `width` successive words. Every batch of documents becomes sorted immutable runs of window
hashes, one run per bucket. In a bucket, each run is merge-joined with the runs before it by the hash; what it
finds is verified by the check, bits of an independent hash, and noted; the run is then added and runs of similar
size are compacted into one, so that a bucket keeps a logarithmic number of runs. An index that is kept
on disk takes part as the oldest runs, which makes the operator incremental.

Windows are equal here if 48 bits of one hash and 24 of another are, and further bits of the second one, which
choose the bucket: 78 bits with 64 buckets, 92 with a million.

A window that repeats inside one batch is sent once, so a passage that a third of all documents share
costs a bucket one entry for each batch and never one for each document. What a bucket gets is sorted into runs
of many batches at a time, and a repeated window is noted once, however many runs met it: a bucket's work
follows its windows, not the number of batches. Buckets, and the tasks that hold them, follow the text.

A window's place is counted through its batch, as the step from the one before it in the bucket. A batch has the
hash of its documents' keys for a name and sends their list once, to the home that gathers its places: with many
buckets few windows of a document meet in one, so that keys beside them would cost almost as much as the hashes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import (
    HOMED, blocks_of, bounded, by_home, covered, groups, guarded, hashed_words, low, partitions, planes, removed, restored, small_batches, spread, trim, unpacked, unplanes, wide, window_hashes, window_starts, words_of,
)

#: A batch's windows in one bucket, by their places in the batch; or its documents and the places settled already.
RUN = "bucket int, batch binary, docs binary, lens binary, places binary, prints binary, checks binary"
#: Places of several batches (as of HOMED, with batches for keys), or the documents of one.
PLACED = f"{HOMED}, docs binary, lens binary"
INDEX = "bucket int, prints binary, checks binary"
#: Characters of text for each bucket.
BUCKET_CHARS = 16_000_000
#: Windows that a bucket sorts into one run.
RUN_WINDOWS = 1 << 17


class Run:
    """Hashes in order, each with its check. sorted() has the checks of an equal hash in order too."""

    def __init__(self, prints: np.ndarray, checks: np.ndarray) -> None:
        self.prints, self.checks = prints, checks

    def __len__(self) -> int:
        return len(self.prints)

    @classmethod
    def sorted(cls, prints: np.ndarray, checks: np.ndarray) -> Run:
        # One sort by 64 of the 72 bits; rarely, it leaves checks of an equal hash to be put in order.
        order = np.argsort(prints << np.uint64(16) | checks.astype(np.uint64) >> np.uint64(8))
        out = cls(prints[order], checks[order])
        if ((out.prints[1:] == out.prints[:-1]) & (out.checks[1:] < out.checks[:-1])).any():
            order = np.lexsort((checks, prints))
            out = cls(prints[order], checks[order])
        return out

    @classmethod
    def read(cls, prints: Iterable[bytes], checks: Iterable[bytes]) -> Run:
        return cls.sorted(wide(b"".join(prints), 6), wide(b"".join(checks), 3).astype(np.uint32))

    def bytes(self) -> tuple[bytes, bytes]:
        return low(self.prints, 6), low(self.checks.astype(np.uint64), 3)

    def part(self, which: np.ndarray) -> Run:
        return Run(self.prints[which], self.checks[which])

    def split(self) -> tuple[Run, Run]:
        """Each window of a sorted() run once, and the further copies."""
        first = np.ones(len(self), bool)
        first[1:] = (self.prints[1:] != self.prints[:-1]) | (self.checks[1:] != self.checks[:-1])
        return self.part(first), self.part(~first)

    def found(self, prints: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Which of some windows the run has: met by the hash, verified by the check of each entry with that hash."""
        out = np.zeros(len(prints), bool)
        at = np.searchsorted(self.prints, prints)
        live = np.flatnonzero(at < len(self))
        live = live[self.prints[at[live]] == prints[live]]
        while len(live):
            out[live] |= self.checks[at[live]] == checks[live]
            at[live] += 1
            live = live[at[live] < len(self)]
            live = live[self.prints[at[live]] == prints[live]]
        return out


class RunIndex:
    """Sorted immutable runs. add() merge-joins a new run with the held ones, then appends it."""

    def __init__(self) -> None:
        self.runs: list[Run] = []
        self.repeated: list[Run] = []

    def add(self, run: Run) -> None:
        known = np.zeros(len(run), bool)
        for held in self.runs:
            known |= held.found(run.prints, run.checks)
        if known.any():
            self.repeated.append(run.part(known))
        self.runs.append(run.part(~known))
        while len(self.runs) > 1 and 2 * len(self.runs[-1]) >= len(self.runs[-2]):
            self.compact(2)

    def compact(self, n: int) -> None:
        """The last n runs become one."""
        if n > 1:
            self.runs[-n:] = [joined(self.runs[-n:])]

    def fill(self, rows: Sequence) -> None:
        """The prints and checks of some rows become one run; what several of them have is repeated."""
        run, again = Run.read((r.prints for r in rows), (r.checks for r in rows)).split()
        if len(again):
            self.repeated.append(again)
        self.add(run)

    def repeats(self) -> Run:
        """Each repeated window once, however often it was met: found() goes over all entries of an equal hash."""
        met = joined(self.repeated)
        return Run.sorted(met.prints, met.checks).split()[0]


def joined(runs: list[Run]) -> Run:
    prints, checks = np.concatenate([np.zeros(0, np.uint64), *(r.prints for r in runs)]), np.concatenate([np.zeros(0, np.uint32), *(r.checks for r in runs)])
    order = np.argsort(prints, kind="stable")  # merges what is in order already
    return Run(prints[order], checks[order])


def _tables(rows: Iterable) -> Iterator[list]:
    """The rows again, in lists of about RUN_WINDOWS windows (or one larger row)."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.prints) // 6
        if size >= RUN_WINDOWS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _steps(places: np.ndarray) -> bytes | None:
    return planes(np.diff(places, prepend=0), "<u4") if len(places) else None


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(unplanes(steps, "<u4").astype(np.int64))


def _runs(batches: Iterator[pd.DataFrame], width: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Rows with prints go to their bucket. The one without lists the documents and what is settled already; it goes along for the ride."""
    for frame in bounded(batches, "text"):
        words, lens = hashed_words(frame["text"], words_of)
        start, _ = window_starts(lens, width)
        if not len(start):
            continue
        prints, second = window_hashes(words, width)[start] >> np.uint64(16), window_hashes(words, width, 1)[start]
        checks = second & np.uint64(0xFFFFFF)
        bucket = ((second >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
        # 72 bits in one order: the hash, then the check among windows of an equal hash (rarely more than one).
        order = np.argsort(prints << np.uint64(16) | checks >> np.uint64(8), kind="stable")
        same = np.zeros(len(prints), bool)
        same[1:] = (prints[order][1:] == prints[order][:-1]) & (checks[order][1:] == checks[order][:-1])
        first, twice = np.empty(len(prints), bool), np.empty(len(prints), bool)
        first[order] = ~same
        twice[order] = same | np.append(same[1:], False)
        # Windows met twice in this batch are settled here; others still have to know that they exist.
        keys = frame["key"].to_numpy(np.int64).tobytes()
        batch = xxhash.xxh3_64_digest(keys)
        sent = np.flatnonzero(first)
        sent = sent[np.argsort(bucket[sent], kind="stable")]
        rows = [(int(bucket[0]), batch, keys, planes(lens, "<u4"), _steps(start[twice]), None, None)]
        for a, b in groups(bucket[sent]):
            at = sent[a:b]
            rows.append((int(bucket[at[0]]), batch, None, None, _steps(start[at]), low(prints[at], 6), low(checks[at], 3)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in RUN.split(", ")])


def _probe(frame: pd.DataFrame, homes: int) -> pd.DataFrame:
    """All runs of one bucket -> places of the repeated windows, packed by the home of their batches, and the lists of documents."""
    index, batches, places = RunIndex(), [], []
    held, lists = [], []

    def note(row: tuple, found: np.ndarray) -> None:
        batches.append(np.repeat(np.frombuffer(row.batch, np.int64), len(found)))
        places.append(found)

    for row in frame.itertuples():
        if row.prints is None:
            lists.append((int(np.frombuffer(row.batch, np.int64)[0] % homes), row.batch, None, None, row.docs, row.lens))
            if row.places:
                note(row, _places(row.places))
        else:
            held.append(row)
    for rows in _tables(held):
        index.fill(rows)
    repeated = index.repeats()
    del index
    for rows in _tables(r for r in held if r.batch) if len(repeated) else ():  # not those of an index on disk
        hit = repeated.found(wide(b"".join(r.prints for r in rows), 6), wide(b"".join(r.checks for r in rows), 3).astype(np.uint32))
        for row, own in zip(rows, np.split(hit, np.cumsum([len(r.prints) // 6 for r in rows[:-1]])), strict=True):
            if own.any():
                note(row, _places(row.places)[own])
    marks = by_home(batches, places, homes)
    out = pd.DataFrame([*((*r, None, None) for r in marks.itertuples(index=False, name=None)), *lists], columns=[c.split()[0] for c in PLACED.split(", ")])
    trim()
    return out


def _placed(frame: pd.DataFrame) -> pd.DataFrame:
    """All PLACED rows of one home -> (key, places) of each document with marks; a key once for each of its rows, with equal places."""
    docs = {r.keys: r for r in frame.itertuples() if r.docs is not None}
    marks = [unpacked(r.keys, r.counts, r.places) for r in frame.itertuples() if r.docs is None]
    batch, place = (np.concatenate([m[k] for m in marks]) if marks else np.zeros(0, np.int64) for k in range(2))
    order = np.lexsort((place, batch))
    batch, place = batch[order], place[order]
    rows = []
    for a, b in groups(batch):
        if (of := docs.get(batch[a : a + 1].tobytes())) is None:
            raise RuntimeError("a batch of documents changed while it was read again: its list is missing")
        keys, end = np.frombuffer(of.docs, np.int64), np.cumsum(lens := unplanes(of.lens, "<u4").astype(np.int64))
        at = np.unique(place[a:b])
        text = np.searchsorted(end, at, "right")
        at -= (end - lens)[text]
        rows += [(int(keys[text[c]]), planes(at[c:d], "<u4")) for c, d in groups(text)]
    return pd.DataFrame(rows, columns=["key", "places"])


def _cut(batches: Iterator[pd.DataFrame], width: int, with_text: bool) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for text, places in zip(frame.pop("text"), frame.pop("places"), strict=True):
            words = words_of(text) if text else []
            kept = words
            if places is not None:
                gone = covered(len(words), unplanes(places, "<u4").astype(np.int64), width)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            rows.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if with_text else None))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
        frame = pd.concat([frame.reset_index(drop=True), out], axis=1)
        yield frame if with_text else frame.drop(columns="kept_text")


def _keyed(docs: DataFrame) -> DataFrame:
    return guarded(docs, "text", F.xxhash64("doc_id", "text").alias("key"))


def _dealt(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    return _keyed(docs).select("key", "text").mapInPandas(lambda it: _runs(it, width, buckets), RUN)


def repeated_windows(docs: DataFrame, width: int = 35, index: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(key, places) of all windows of docs(doc_id, text) that also start elsewhere, or that `index` holds.

    key is xxhash64(doc_id, text) and has one row; places are the window's starts, by byte planes of "<u4".
    index: read_index(); an empty one is as none. blocks: blocks_of(docs, BUCKET_CHARS), where it is known.
    """
    small_batches(docs.sparkSession)
    blocks = blocks or blocks_of(docs, BUCKET_CHARS)
    homes = max(partitions(docs.sparkSession), blocks // 2)
    held = index.first() if index is not None else None
    buckets = held.buckets if held else blocks
    runs = _dealt(docs, width, buckets)
    if held:
        runs = runs.unionByName(index.select("bucket", "prints", "checks"), allowMissingColumns=True)
    marks = spread(runs, buckets, "bucket").groupBy("bucket").applyInPandas(lambda f: _probe(f, homes), PLACED)
    places = spread(marks, homes, "home").groupBy("home").applyInPandas(_placed, "key long, places binary")
    # Rows that repeat lie in several batches; what repeats in one of them repeats in each.
    return spread(places, blocks, "key").groupBy("key").agg(F.max("places").alias("places"))


def _manifest(spark: SparkSession, path: str) -> tuple[int, int, list[str]]:
    """(version, buckets, folders of the live runs) of the index at path; version 0: there is none."""
    try:
        rows = spark.read.schema("buckets int, run string, version int").parquet(f"{path}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, 0, []
    last = rows.agg(F.max("version")).first()[0]
    live = rows.where(F.col("version") == F.lit(last)).collect()  # at most keep_runs + 1 names
    return (last, live[0].buckets, sorted(r.run for r in live)) if live else (0, 0, [])


def update_index(docs: DataFrame, path: str, width: int = 35, keep_runs: int = 8, buckets: int | None = None) -> None:
    """Adds the batch's runs to the index at path; with more than keep_runs batches, all are compacted into one.

    The first batch settles the number of buckets (given, or by its text); later ones keep to it, whatever the
    session's partitions. Runs are never changed: new ones are written beside the old ones, then a new version
    of the manifest names the live ones, then replaced runs are deleted. A job that is lost on the way leaves
    the last version as it was. One writer at a time.
    """
    spark = docs.sparkSession
    small_batches(spark)
    version, held, live = _manifest(spark, path)
    buckets = held or buckets or blocks_of(docs, BUCKET_CHARS)

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        index = RunIndex()
        for rows in _tables(frame.itertuples()):
            index.fill(rows)
        index.compact(len(index.runs))
        prints, checks = index.runs[0].bytes()
        return pd.DataFrame({"bucket": [int(frame["bucket"].iloc[0])], "prints": [prints], "checks": [checks]})

    def put(runs: DataFrame) -> str:
        name = uuid.uuid4().hex
        runs.select("bucket", "prints", "checks").groupBy("bucket").applyInPandas(merged, INDEX).write.parquet(f"{path}/runs/{name}")
        return name

    live, old = [*live, put(_dealt(docs, width, buckets).where("prints is not null"))], []
    if len(live) > keep_runs:
        live, old = [put(spark.read.schema(INDEX).parquet(*(f"{path}/runs/{x}" for x in live)))], live
    spark.createDataFrame([(buckets, x) for x in live], "buckets int, run string").coalesce(1).write.parquet(f"{path}/manifest/version={version + 1}")
    for name in old:
        removed(spark, f"{path}/runs/{name}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """(bucket, prints, checks, buckets, run) of the live runs; empty where there is no index."""
    _, buckets, live = _manifest(spark, path)
    if not live:
        return spark.createDataFrame([], f"{INDEX}, buckets int, run string")
    parts = [spark.read.schema(INDEX).parquet(f"{path}/runs/{x}").withColumns({"buckets": F.lit(buckets), "run": F.lit(x)}) for x in live]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def substring_dedup(docs: DataFrame, width: int = 35, index: DataFrame | None = None, with_text: bool = True) -> DataFrame:
    """Removes each word of docs(doc_id, text, ...) that lies in a window of `width` words found more than once.

    Returns doc_id, n_words, n_removed, kept_sha256 and, with with_text, kept_text; one row per input row.
    Windows are judged on the input. A null or empty text has no words; a text of fewer than `width` words
    has no window and stays whole. Rows that repeat (equal id and text) count as separate occurrences, so
    they lose their windows. A null doc_id is kept as it is. Further columns are ignored. An empty table
    gives an empty result.
    """
    blocks = blocks_of(docs, BUCKET_CHARS)
    marks = repeated_windows(docs, width, index, blocks)
    joined = spread(_keyed(docs), blocks, "key").join(marks.hint("shuffle_hash"), "key", "left").select("doc_id", "no_id", "text", "places")
    schema = "doc_id long, no_id boolean, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return restored(joined.mapInPandas(lambda it: _cut(it, width, with_text), schema))
