"""Fuzzy line dedup by a deletion-neighbourhood join.

The edit bound is one unit: two lines are near when one unit inserted, deleted or replaced turns one into the
other. The units of a line of at least `min_words` words are its words (so every change inside one word is
within the bound). Those of a shorter one are its characters, its words joined by one space; below `min_chars`
of these a line must be equal, since there one character is much of it. Lines with different units are never
near.

Each line emits hashed keys for itself and for all its variants with one unit deleted. Two lines with an
equal variant are within the bound if

* both deleted the unit at the same place (one replacement), or
* one of them deleted nothing (one insertion);

equal variants with different places are two edits apart, unless another key shows them nearer. So the
edit distance is verified from the places, and the earliest line of a key settles all its other lines:
no pair of lines is ever formed. Keys are two independent hashes of 64 bits.

Two passes keep most lines from emitting variants; no near or equal line is lost by them.

The first joins hashes of whole lines and of their halves. Of equal lines all but the earliest go at once: what
is near to one of them is near to the earliest. One edit leaves the first or the last half of the shorter line as
it is, so of the lines left only those that share a half (four a line: first and last, by the line's length and
by one less) with another line emit variants, in the second pass. The first pass reads every word, so its words
are hashed in numpy, for all of a batch at once.

Each batch sends only its earliest copy of an equal line, so a frequent line costs a bucket one entry a batch.
What a batch sends to all its buckets is packed at once: there are about as many buckets as tasks, and few lines
of a batch in each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BASES, INVERSES, blocks_of, bounded, guarded, hashed_words, low, mix, partitions, pieces, planes_of, powers, restored, small_batches, trim, unplanes, unplanes_of, utf8, wide, words_of, written,
)

#: Lines, as packed_lines() has them.
LINES = "docs binary, keys binary, counts binary, lines binary"
FOUND = f"bucket int, kind int, {LINES}, prints binary, checks binary"
#: Kinds of FOUND: lines by halves or whole, and what is known within a batch: lines with a half in common, and later copies.
HALF, WHOLE, NEAR, COPY = range(4)
HOMED = f"home int, copies boolean, {LINES}"
SENT = f"bucket int, {LINES}, entries binary, places binary, prints binary, checks binary"
GONE = f"home int, {LINES}"
#: Place of an entry that is a whole line.
FULL = 0xFFFFFFFF
LAST = np.iinfo(np.int64).max
#: Characters of text for each bucket of the first pass.
BUCKET_CHARS = 16_000_000
CHARS, SUFFIX = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA5A5A5A5F0F0F0F1)


#: Bytes that end a word, and the masks of the first 0 to 8 bytes of eight.
SPACE = np.isin(np.arange(256), [*b" \t\n\v\f\r"])
HEAD = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words (bytes) are hashed one by one.
WORD_BYTES = 64


def spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each word, as bytes.split() finds them."""
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(SPACE[np.frombuffer(data, np.uint8)], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def span_hashes(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time; not the one that hashed_words() gives."""
    size = end - start
    out = mix(size.astype(np.uint64) + CHARS)
    eight = np.ndarray((len(data),), "<u8", data + bytes(8), strides=(1,))
    live = np.flatnonzero(size <= WORD_BYTES)
    done = 0
    while len(live):
        part = eight[start[live] + done] & HEAD[np.minimum(size[live] - done, 8)]
        out[live] = mix(out[live] * np.uint64(BASES[0]) ^ part)
        done += 8
        live = live[size[live] > done]
    for k in np.flatnonzero(size > WORD_BYTES).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]])
    return out


class Lines:
    """The lines with a word of some texts: doc and number of each, its units' hashes and how many these are."""

    def __init__(self, texts: list[str | None], wanted: list[np.ndarray] | None, min_words: int, min_chars: int) -> None:
        units, doc, number, kind = [], [], [], []
        for d, text in enumerate(texts):
            lines = (text or "").split("\n")
            for k in range(len(lines)) if wanted is None else wanted[d].tolist():
                if not (own := words_of(lines[k])):
                    continue
                short = len(own) < min_words
                if short:
                    own = [utf8(c) for c in b" ".join(own).decode("utf-8", "surrogatepass")]
                units.append(own)
                doc.append(d)
                number.append(k)
                kind.append(short + (short and len(own) < min_chars))
        self.doc, self.number = np.array(doc, np.int64), np.array(number, np.int64)
        self.hashes, self.lens = hashed_words(units, list)
        kind = np.array(kind, np.int64)
        self.fuzzy = kind < 2
        self.salt = np.where(kind > 0, CHARS, np.uint64(0))

    @classmethod
    def scanned(cls, texts: list[str | None], min_words: int, min_chars: int) -> Lines:
        """All lines of the texts, as from Lines(texts, None, ...) but for other hashes of words; only characters of short lines are taken one by one."""
        out = cls([], None, min_words, min_chars)
        parts = [utf8(t) if t else b"" for t in texts]
        data = b"\n".join(parts)
        start, end = spans(data)
        if not len(start):
            return out
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        begin = np.cumsum([0, *(len(p) + 1 for p in parts[:-1])])
        row = np.searchsorted(breaks, start)
        at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        words = np.diff(np.append(at, len(row)))
        out.doc = np.searchsorted(begin, start[at], "right") - 1
        out.number = row[at] - np.searchsorted(breaks, begin)[out.doc]
        out.hashes, out.lens = span_hashes(data, start, end), words
        short = words < min_words
        out.fuzzy, out.salt = np.ones(len(at), bool), np.where(short, CHARS, np.uint64(0))
        if short.any():
            last = at + words - 1
            units = [[utf8(c) for c in b" ".join(data[a:b].split()).decode("utf-8", "surrogatepass")] for a, b in zip(start[at[short]].tolist(), end[last[short]].tolist(), strict=True)]
            chars, count = hashed_words(units, list)
            out.fuzzy[short] = count >= min_chars
            out.lens = words.copy()
            out.lens[short] = count
            hashes = np.empty(out.lens.sum(), np.uint64)
            of_short = np.repeat(short, out.lens)
            hashes[of_short] = chars
            hashes[~of_short] = out.hashes[~np.repeat(short, words)]
            out.hashes = hashes
        return out

    def sums(self, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the hashes by powers of a base, and the inverse powers: the hash of any run of units is a difference of the first times one of the second."""
        n = len(self.hashes)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hashes * powers(BASES[which], n), out=sums[1:])
        return sums, powers(INVERSES[which], n + 1)

    def wholes(self, sums: np.ndarray, down: np.ndarray) -> np.ndarray:
        """A hash of each line, from one of the two sums()."""
        end = np.cumsum(self.lens)
        begin = end - self.lens
        return mix((sums[end] - sums[begin]) * down[begin] + self.lens.astype(np.uint64) * np.uint64(BASES[1]) + self.salt)

    def halves(self, sums: np.ndarray, down: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(line, hash): the four halves of some of the lines, from sums(0)."""
        lens, salt, end = self.lens[some], self.salt[some], np.cumsum(self.lens)[some]
        begin = end - lens
        prints = []
        for shorter in (lens - 1, lens):
            half = np.maximum(shorter - 1, 0) // 2
            size = shorter.astype(np.uint64) * np.uint64(BASES[1]) + salt
            prints.append(mix((sums[begin + half] - sums[begin]) * down[begin] + size))
            prints.append(mix((sums[end] - sums[end - half]) * down[end - half] + size + SUFFIX))
        return np.tile(some, 4), np.concatenate(prints)


def variants(hashes: np.ndarray, lens: np.ndarray, which: int, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each line, and of each line without the unit at each of its places (in order of the units)."""
    n = len(hashes)
    if which:
        hashes = mix(hashes ^ np.uint64(0xA0761D6478BD642F))
    up, down = powers(BASES[which], n + 1), powers(INVERSES[which], n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=sums[1:])
    end = np.cumsum(lens)
    begin = end - lens
    size = lens.astype(np.uint64)
    full = mix((sums[end] - sums[begin]) * down[begin] + size * np.uint64(BASES[1 - which]) + salt)
    line = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(n)
    left = (sums[at] - sums[begin[line]]) * down[begin[line]]
    right = (sums[end[line]] - sums[at + 1]) * down[begin[line] + 1]
    return full, mix(left + right + (size[line] - np.uint64(1)) * np.uint64(BASES[1 - which]) + salt[line])


def changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the columns; the first does."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def cuts_of(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of rows that are equal in all columns, and the end."""
    return np.append(np.flatnonzero(changes(*columns)), len(columns[0]))


def packed_lines(order: np.ndarray, key: np.ndarray, number: np.ndarray, cuts: np.ndarray) -> list[list[bytes]]:
    """LINES of each run of lines: steps between its documents' orders, their keys, how many lines each has, and the numbers of these."""
    fresh = changes(order, key)
    fresh[cuts[:-1]] = True
    begins = np.flatnonzero(fresh)
    docs = np.searchsorted(begins, cuts)
    step = np.diff(order[begins], prepend=0)
    step[docs[:-1]] = order[cuts[:-1]]
    count = np.diff(np.append(begins, len(order)))
    return [planes_of(step, "<i8", docs), pieces(key[begins].tobytes(), 8, docs), planes_of(count, "<u4", docs), planes_of(number, "<u4", cuts)]


def unpacked_lines(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, key, number) of all lines of LINES rows."""
    step, size = unplanes_of(frame["docs"], "<i8")
    sums = np.cumsum(step)
    order = sums - np.repeat(np.append(0, sums)[np.cumsum(size) - size], size)
    count = unplanes_of(frame["counts"], "<u4")[0]
    number = unplanes_of(frame["lines"], "<u4")[0].astype(np.int64)
    return np.repeat(order, count), np.repeat(np.frombuffer(b"".join(frame["keys"]), np.int64), count), number


def homed(lines: list[tuple[np.ndarray, np.ndarray, np.ndarray]], homes: int) -> tuple[list[int], list[list[bytes]]]:
    """Lines (order, key, number), by the home of their document: the homes and LINES of each."""
    order, key, number = (np.concatenate(x) for x in zip(*lines, strict=True))
    by = np.lexsort((number, key, order, key % homes))
    order, key, number = order[by], key[by], number[by]
    cuts = cuts_of(key % homes)
    return (key[cuts[:-1]] % homes).tolist(), packed_lines(order, key, number, cuts)


def table_of(schema: str, *columns: list) -> pd.DataFrame:
    return pd.DataFrame(dict(zip((c.split()[0] for c in schema.split(", ")), columns, strict=True)))


def _found(batches: Iterator[pd.DataFrame], min_words: int, min_chars: int, buckets: int) -> Iterator[pd.DataFrame]:
    """The earliest copy of each line of a batch goes to the buckets of its hashes, whole and by halves. What is known within the batch goes along for the ride."""
    for frame in bounded(batches, "text", 1_000_000):
        frame = frame.sort_values(["order", "key"], kind="stable").drop_duplicates(["order", "key"])
        lines = Lines.scanned(list(frame["text"]), min_words, min_chars)
        if not len(lines.lens):
            continue
        orders, keys = frame["order"].to_numpy(np.int64), frame["key"].to_numpy(np.int64)
        sums, down = lines.sums(0)
        whole, check = lines.wholes(sums, down), lines.wholes(*lines.sums(1))
        # The frame is in order, so the first of equal lines is the earliest.
        by = np.lexsort((check, whole))
        once = np.zeros(len(whole), bool)
        once[by[changes(whole[by], check[by])]] = True
        own = np.flatnonzero(once)
        line, prints = lines.halves(sums, down, np.flatnonzero(once & lines.fuzzy))
        by = np.lexsort((line, prints))
        line, prints = line[by], prints[by]
        fresh = changes(prints)
        other = ~fresh[1:] & (line[1:] != line[:-1])
        near = np.unique(np.r_[line[1:][other], line[:-1][other]])
        line, prints = line[fresh], prints[fresh]

        def rows(kind: int, bucket: np.ndarray, line: np.ndarray, prints: bytes | None = None, checks: bytes | None = None) -> pd.DataFrame:
            cuts = cuts_of(bucket)
            n = len(cuts) - 1
            of = lines.doc[line]  # noqa: B023
            packed = packed_lines(orders[of], keys[of], lines.number[line], cuts)  # noqa: B023
            parts = [[None] * n if x is None else pieces(x, len(x) // len(line), cuts) for x in (prints, checks)]
            return table_of(FOUND, bucket[cuts[:-1]], [kind] * n, *packed, *parts)

        place = (prints >> np.uint64(40)) % np.uint64(buckets)
        by = np.lexsort((line, place))
        out = [rows(HALF, place[by].astype(np.int64), line[by], low(prints[by], 5))] if len(line) else []
        place = (check[own] >> np.uint64(20)) % np.uint64(buckets)
        by = np.lexsort((own, place))
        place, own = place[by].astype(np.int64), own[by]
        out.append(rows(WHOLE, place, own, whole[own].tobytes(), check[own].tobytes()))
        out += [rows(kind, np.full(len(x), place[0]), x) for kind, x in ((NEAR, near), (COPY, np.flatnonzero(~once))) if len(x)]
        yield pd.concat(out, ignore_index=True)
    trim()


def _shared(frame: pd.DataFrame, homes: int) -> pd.DataFrame:
    """All hashes of a bucket -> the lines that share a half with others, and those that have an earlier copy, by home.

    Halves are compared by 40 bits and the bucket; a chance match only sends a line to the second pass.
    """
    parts = dict(list(frame.groupby("kind")))
    near, copies = ([unpacked_lines(parts[k])] if k in parts else [] for k in (NEAR, COPY))
    if (part := parts.get(HALF)) is not None:
        prints = wide(b"".join(part["prints"]), 5)
        by = np.argsort(prints)
        same = ~changes(prints[by])[1:]
        some = by[np.r_[same, False] | np.r_[False, same]]
        near.append(tuple(x[some] for x in unpacked_lines(part)))
    if (part := parts.get(WHOLE)) is not None:
        prints, checks = (np.frombuffer(b"".join(part[c]), np.uint64) for c in ("prints", "checks"))
        by = np.argsort(prints)
        same = ~changes(prints[by])[1:]
        some = by[np.r_[same, False] | np.r_[False, same]]
        order, key, number = (x[some] for x in unpacked_lines(part))
        by = np.lexsort((number, key, order, checks[some], prints[some]))
        order, key, number, some = order[by], key[by], number[by], some[by]
        fresh = changes(prints[some], checks[some])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        # A document that repeats has each of its lines once.
        later = (order != order[first]) | (key != key[first]) | (number != number[first])
        copies.append((order[later], key[later], number[later]))
    out = [(flag, *homed(x, homes)) for flag, x in ((False, near), (True, copies)) if x]
    return pd.concat([table_of(HOMED, at, [flag] * len(at), *packed) for flag, at, packed in out], ignore_index=True)


def _gathered(frame: pd.DataFrame) -> pd.DataFrame:
    """All HOMED rows of one home -> each of its documents with the numbers of its lines that may be near others, and of its copies."""
    parts = [(flag, *unpacked_lines(rows)) for flag, rows in frame.groupby("copies")]
    copy = np.concatenate([np.full(len(p[1]), p[0]) for p in parts])
    order, key, number = (np.concatenate([p[k] for p in parts]) for k in (1, 2, 3))
    by = np.lexsort((~copy, number, key, order))
    by = by[changes(order[by], key[by], number[by])]  # a copy is gone, whatever its halves are
    order, key, number, copy = order[by], key[by], number[by], copy[by]
    cuts = cuts_of(order, key)
    kinds = [planes_of(number[x], "<u4", np.append(0, np.cumsum(x))[cuts]) for x in (~copy, copy)]
    return pd.DataFrame({"order": order[cuts[:-1]], "key": key[cuts[:-1]], "places": kinds[0], "copies": kinds[1]})


def _send(batches: Iterator[pd.DataFrame], min_words: int, min_chars: int, buckets: int) -> Iterator[pd.DataFrame]:
    """Lines and their variants go to their buckets. Rows without prints are copies, which go along for the ride."""
    for frame in bounded(batches, "text", 1_000_000):
        frame = frame.sort_values(["order", "key"], kind="stable").drop_duplicates(["order", "key"])
        keys, orders = frame["key"].to_numpy(np.int64), frame["order"].to_numpy(np.int64)
        number, count = unplanes_of(frame["copies"], "<u4")
        if len(number):
            packed = packed_lines(np.repeat(orders, count), np.repeat(keys, count), number, np.array([0, len(number)]))
            yield table_of(SENT, [int(keys[0] % buckets)], *packed, *[[None]] * 4)
        lines = Lines(list(frame["text"]), [unplanes(x, "<u4") for x in frame["places"]], min_words, min_chars)
        lens = lines.lens
        if not len(lens):
            continue
        full, cut = variants(lines.hashes, lens, 0, lines.salt)
        full2, cut2 = variants(lines.hashes, lens, 1, lines.salt)
        line = np.repeat(np.arange(len(lens)), lens)
        place = np.arange(len(line)) - (np.cumsum(lens) - lens)[line]
        line = np.concatenate([np.arange(len(lens)), line])
        place = np.concatenate([np.full(len(lens), FULL), place])
        prints, checks = np.concatenate([full, cut]), np.concatenate([full2, cut2])
        bucket = ((checks >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        sent = np.lexsort((line, bucket))
        line, place, bucket = line[sent], place[sent], bucket[sent]
        cuts = cuts_of(bucket)
        begins = np.flatnonzero(changes(bucket, line))
        of = np.searchsorted(begins, cuts)
        own = line[begins]
        packed = packed_lines(orders[lines.doc[own]], keys[lines.doc[own]], lines.number[own], of)
        entries = planes_of(np.diff(np.append(begins, len(line))), "<u4", of)
        hashes = [pieces(x[sent].tobytes(), 8, cuts) for x in (prints, checks)]
        yield table_of(SENT, bucket[cuts[:-1]], *packed, entries, planes_of(place, "<u4", cuts), *hashes)
    trim()


def _settle(frame: pd.DataFrame, homes: int) -> pd.DataFrame:
    """All entries of a bucket -> the lines to remove, packed by the home of their document."""
    found = []
    rides = frame["prints"].isna()
    if rides.any():
        found.append(unpacked_lines(frame[rides]))
    if not rides.all():
        rows = frame[~rides]
        doc, key, number = unpacked_lines(rows)
        line = np.repeat(np.arange(len(doc)), unplanes_of(rows["entries"], "<u4")[0])
        place = unplanes_of(rows["places"], "<u4")[0]
        prints, checks = (np.frombuffer(b"".join(rows[c]), np.uint64) for c in ("prints", "checks"))
        # Rank of each line in the order (document, its key, line): equal documents that repeat have equal ranks.
        order = np.lexsort((number, key, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(changes(doc[order], key[order], number[order]))
        gone = np.zeros(len(doc), bool)
        by = np.lexsort((place, checks, prints))
        line, place, prints, checks = line[by], place[by], prints[by], checks[by]
        ranks = rank[line]
        fresh = changes(prints, checks)
        group = np.cumsum(fresh) - 1
        again = fresh | changes(place)
        earliest = np.minimum.reduceat(ranks, np.flatnonzero(again))
        gone[line[ranks > earliest[np.cumsum(again) - 1]]] = True  # one unit replaced
        whole = place == FULL
        n = group[-1] + 1
        first_whole, first_cut = np.full(n, LAST), np.full(n, LAST)
        np.minimum.at(first_whole, group[whole], ranks[whole])
        np.minimum.at(first_cut, group[~whole], ranks[~whole])
        gone[line[~whole & (ranks > first_whole[group])]] = True  # one unit inserted
        gone[line[whole & (ranks > first_cut[group])]] = True  # one unit deleted
        found.append((doc[gone], key[gone], number[gone]))
    at, packed = homed(found, homes)
    return table_of(GONE, at, *packed)


def _collected(frame: pd.DataFrame) -> pd.DataFrame:
    """All lines to remove of one home -> one row for each document."""
    order, key, number = unpacked_lines(frame)
    by = np.lexsort((number, key, order))
    by = by[changes(order[by], key[by], number[by])]
    order, key, number = order[by], key[by], number[by]
    cuts = cuts_of(order, key)
    return pd.DataFrame({"order": order[cuts[:-1]], "key": key[cuts[:-1]], "lines": planes_of(number, "<u4", cuts)})


def _keyed(docs: DataFrame) -> DataFrame:
    """guarded(docs) with order, doc_id (null: the greatest long), and key, a hash of id and text; both name a document."""
    return guarded(docs, "text", F.xxhash64("doc_id", "text").alias("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("order"))


def removed_lines(keyed: DataFrame, min_words: int = 8, min_chars: int = 16) -> DataFrame:
    """(order, key, lines): for each document of _keyed() that loses lines, their numbers from 0 as planes of "<u4"."""
    small_batches(keyed.sparkSession)
    homes, buckets = partitions(keyed.sparkSession), blocks_of(keyed, BUCKET_CHARS)
    found = keyed.select("key", "order", "text").mapInPandas(lambda it: _found(it, min_words, min_chars, buckets), FOUND)
    shared = found.groupBy("bucket").applyInPandas(lambda f: _shared(f, homes), HOMED)
    lines = shared.groupBy("home").applyInPandas(_gathered, "order long, key long, places binary, copies binary")
    joined = keyed.select("key", "order", "text").join(lines.hint("shuffle_hash"), ["order", "key"])
    some = joined.withColumn("text", F.when(F.length("places") > 0, F.col("text")))
    sent = some.mapInPandas(lambda it: _send(it, min_words, min_chars, 4 * buckets), SENT)
    settled = sent.groupBy("bucket").applyInPandas(lambda f: _settle(f, homes), GONE)
    return written(settled.groupBy("home").applyInPandas(_collected, "order long, key long, lines binary"), "lines")


def _strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        texts = []
        for text, lines in zip(frame.pop("text"), frame.pop("lines"), strict=True):
            gone = set(() if lines is None else unplanes(lines, "<u4").tolist())
            texts.append(text if not gone else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone))
        yield frame.assign(text=texts)


def line_dedup(docs: DataFrame, min_words: int = 8, min_chars: int = 16) -> DataFrame:
    """docs(doc_id, text) without each line that has an earlier near line.

    Lines are \\n-split; a line without a word ([^\\x20\\x09-\\x0D]+) always stays. The order is doc_id (null
    last), then the document's hash, then the line number. A line goes if any earlier line of the table has the
    same words, or is within one word of it (both of at least min_words words) or within one character (both
    of fewer words, and of at least min_chars characters when their words are joined by one space). A null
    text stays null. Rows that repeat (equal id and text) count as one document and lose the same lines.
    Further columns are ignored; an empty table gives an empty result.
    """
    keyed = _keyed(docs)
    joined = keyed.join(removed_lines(keyed, min_words, min_chars).hint("shuffle_hash"), ["order", "key"], "left").select("doc_id", "no_id", "text", "lines")
    return restored(joined.mapInPandas(_strip, "doc_id long, no_id boolean, text string"))


def _tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        numbers = [np.zeros(0, np.int64) if x is None else unplanes(x, "<u4") for x in frame["lines"]]
        yield pd.DataFrame({
            "doc_id": frame["doc_id"], "no_id": frame["no_id"], "n_lines": frame["n_lines"], "n_removed": [len(x) for x in numbers],
            "removed_sha256": [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in numbers],
        })


def line_dedup_report(docs: DataFrame, min_words: int = 8, min_chars: int = 16) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and removed_sha256 (of the comma-joined numbers of the removed lines)."""
    lines = F.expr(r"size(filter(split(coalesce(text, ''), '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]'))").cast("long")
    keyed = _keyed(docs)
    counted = keyed.select("doc_id", "no_id", "order", "key", lines.alias("n_lines"))
    joined = counted.join(removed_lines(keyed, min_words, min_chars).hint("shuffle_hash"), ["order", "key"], "left").select("doc_id", "no_id", "n_lines", "lines")
    return restored(joined.mapInPandas(_tally, "doc_id long, no_id boolean, n_lines long, n_removed long, removed_sha256 string"))
