"""What the corpus operators share: word hashing in numpy, batches of bounded size, the shared scratch folder.

Texts are handled in Arrow batches by Python workers. A word is hashed once per worker (a bounded cache),
everything after that is numpy over flat arrays: one array of word hashes for a batch and the length of
each text in it.
"""

from __future__ import annotations

import contextlib
import ctypes
import itertools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd bases of the rolling hashes, with their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


class WordHasher(dict):
    """Word (bytes) -> 64-bit hash, remembered for at most `limit` words."""

    limit = 150_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHER = WordHasher()


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def words_of(text: str) -> list[bytes]:
    """Runs of characters outside [\\x20\\x09-\\x0D]; bytes.split() splits at exactly these."""
    return utf8(text).split()


def lower_words_of(text: str) -> list[bytes]:
    """The same with A-Z lower-cased; bytes.lower() leaves all other characters."""
    return utf8(text).lower().split()


def hashed_words(texts: Iterable[str | None], split: Callable[[str], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the number of words of each text (null: 0)."""
    words: list[bytes] = []
    lens = []
    for text in texts:
        before = len(words)
        if text:
            words += split(text)
        lens.append(len(words) - before)
    return np.fromiter(map(_HASHER.__getitem__, words), np.uint64, len(words)), np.array(lens, np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out)[:n]


def window_hashes(hashes: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hash of each run of `width` successive entries (across text borders too; the caller masks those)."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, np.uint64)
    if which:
        hashes = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * powers(BASES[which], n), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(INVERSES[which], n - width + 1))


def window_starts(lens: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, text) of each window of `width` words that lies within one text."""
    count = np.maximum(lens - width + 1, 0)
    text = np.repeat(np.arange(len(lens)), count)
    begin = np.cumsum(lens) - lens
    first = np.cumsum(count) - count
    return np.arange(len(text)) - first[text] + begin[text], text


def covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n places lie within `width` places from one of the starts."""
    edge = np.zeros(n + width + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge)[:n] > 0


def planes(values: np.ndarray, kind: str) -> bytes:
    """Integers by byte planes; planes of zeros vanish when the shuffle compresses them."""
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(len(values), -1)
    return raw.T.tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def planes_of(values: np.ndarray, kind: str, cuts: np.ndarray) -> list[bytes]:
    """planes() of each run of the values, all at once; cuts are the starts of the runs and the end of the last."""
    width, size = np.dtype(kind).itemsize, np.diff(cuts)
    raw = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, width)
    at = np.arange(len(values)) + np.repeat(cuts[:-1] * (width - 1), size)
    out, size = np.empty(raw.size, np.uint8), np.repeat(size, size)
    for k in range(width):
        out[at + k * size] = raw[:, k]
    return pieces(out.tobytes(), width, cuts)


def unplanes_of(parts: Iterable[bytes], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values that planes_of() took, and the number of each part."""
    parts, width = list(parts), np.dtype(kind).itemsize
    size = np.array([len(x) // width for x in parts], np.int64)
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.arange(len(data) // width) + np.repeat((np.cumsum(size) - size) * (width - 1), size)
    out, of = np.empty((len(at), width), np.uint8), np.repeat(size, size)
    for k in range(width):
        out[:, k] = data[at + k * of]
    return out.reshape(-1).view(kind), size


def pieces(data: bytes, width: int, cuts: np.ndarray) -> list[bytes]:
    """The bytes of each run of values of that width."""
    return [data[a:b] for a, b in itertools.pairwise((cuts * width).tolist())]


def low(values: np.ndarray, n: int) -> bytes:
    """The lower n bytes of each 64-bit value, one after the other."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    """The values that low(values, n) kept the lower bytes of."""
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.reshape(-1).view(np.uint64)


def groups(values: np.ndarray) -> Iterator[tuple[int, int]]:
    """[start, end) of each run of equal values."""
    cut = np.flatnonzero(np.r_[len(values) > 0, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return zip(cut.tolist(), [*cut[1:].tolist(), len(values)][: len(cut)], strict=True)


def packed(key: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Places by owner (both in order), with the owner's key: the keys, how many places each has, and the steps between its places."""
    begins = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    step = np.diff(place, prepend=0)
    step[begins] = place[begins]
    return key[begins].tobytes(), planes(np.diff(np.append(begins, len(owner))), "<u4"), planes(step, "<u4")


def unpacked(keys: bytes, counts: bytes, places: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(key, place) of each entry."""
    count = unplanes(counts, "<u4").astype(np.int64)
    sums = np.cumsum(unplanes(places, "<u4").astype(np.int64))
    first = np.cumsum(count) - count
    return np.repeat(np.frombuffer(keys, np.int64), count), sums - np.repeat(np.where(first > 0, sums[first - 1], 0), count)


HOMED = "home int, keys binary, counts binary, places binary"


def by_home(keys: list[np.ndarray], places: list[np.ndarray], homes: int) -> pd.DataFrame:
    """HOMED rows: the marks (key, place), packed by the home of their key."""
    key, place = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, places))
    order = np.lexsort((place, key, key % homes))
    key, place = key[order], place[order]
    return pd.DataFrame([(int(key[a] % homes), *packed(key[a:b], key[a:b], place[a:b])) for a, b in groups(key % homes)], columns=["home", "keys", "counts", "places"])


def trim() -> None:
    """Gives memory that a worker has freed back to the system: idle workers stay, and count, beside the executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries lack the call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def bounded(batches: Iterator[pd.DataFrame], column: str, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """The rows again, in frames whose texts have about `chars` characters (or one longer text)."""
    held: list[pd.DataFrame] = []
    size = 0
    for frame in batches:
        if not len(frame):
            continue
        lens = np.array([len(t) if t else 0 for t in frame[column]]) + 64
        part = np.cumsum(lens) // chars
        for k in np.unique(part):
            rows = part == k
            held.append(frame[rows])
            size += int(lens[rows].sum())
            if size >= chars:
                yield pd.concat(held, ignore_index=True)
                held, size = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)
    held.clear()
    trim()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir).

    Only where driver and executors are one process (tests) may the setting be missing: a temporary folder
    becomes the checkpoint folder then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvine-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Paths of the tables written in each open cleaned().
_OPEN: list[list[str]] = []


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The frame, written to the shared folder and read again: its lineage ends there. An open cleaned() deletes it, unless keep."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if _OPEN and not keep:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that are written within, at its end. What goes out has to be written with keep."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            removed(spark, path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lowers the session's rows and bytes of an Arrow batch: by default, batches of long texts fill an executor's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; operators size their buckets by it."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def blocks_of(docs: DataFrame, chars: int) -> int:
    """So many blocks that each gets about `chars` characters of the texts, and every shuffle partition one."""
    return max(partitions(docs.sparkSession), 1 + (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // chars)


def spread(df: DataFrame, n: int, column: str) -> DataFrame:
    """The rows dealt by the column to n partitions, if that is more than the session's shuffles have: a task's share stays the same however much there is."""
    return df.repartition(n, column) if n > partitions(df.sparkSession) else df


def free_name(*frames: DataFrame) -> str:
    """A column name that none of the frames has (Spark does not tell cases apart)."""
    taken = {c.lower() for df in frames for c in df.columns}
    return next(name for k in range(len(taken) + 1) if (name := f"_own_{k}") not in taken)


def guarded(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id and the columns, with null ids as 0 and marked in no_id: pandas would turn a column with nulls into floats."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), *columns)


def restored(df: DataFrame) -> DataFrame:
    """The null ids of guarded() again."""
    return df.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")
