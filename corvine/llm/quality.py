"""Quality rules: base counts, and divergence from language references.

The verdict compares two histograms of a document with those of each language: classes of characters, and
the common words of the language (all other words as one class). A language's reference is the sum over all
its documents. The distance is that of Jensen-Shannon (the root of the divergence to base 2, from 0 to 1);
the nearest language by both together counts, and either histogram above its limit rejects. Documents too short for a
histogram to mean anything are not judged by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, covered, guarded, hashed_words, mix, restored, small_batches, trim, utf8, window_hashes, window_starts, words_of

# Common words of four languages, lower case.
COMMON = {
    "en": "the of and to in a is that for it was on with as be by at are this from or an not have he his but they which you were all one we can has had their will would there been if more when who so no said out up into than them only some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux cette d'une mais comme on tout nous sa fait été aussi leur bien peut ces y elle très avoir même entre",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está",
}
CLASSES = ("lower", "upper", "digit", "space", "newline", "stop", "mark", "symbol", "beyond")
CONTINUED = len(CLASSES)
_SYMBOLS, _STOPS = b"#*$%&|<>", b".,;:!?'\"()-"


def _class_of(byte: int) -> int:
    char = bytes([byte])
    for k, found in enumerate((
        97 <= byte <= 122, 65 <= byte <= 90, 48 <= byte <= 57, byte in (32, 9, 11, 12, 13), byte == 10,
        char in [b".", b","], char in [bytes([x]) for x in _STOPS[2:]], byte in _SYMBOLS,
    )):
        if found:
            return k
    return CONTINUED if 128 <= byte < 192 else CLASSES.index("beyond")


TABLE = np.array([_class_of(b) for b in range(256)], np.uint8)
WORDS = sorted({w for words in COMMON.values() for w in words.split()})
_PLACE = {w.encode(): k for k, w in enumerate(WORDS)}
_STRIP = b".,;:!?'\"()-#*$%&|<>"
OTHER = len(WORDS)

MIN_WORDS = 10
MAX_REPEATED = 20
#: Characters and words that a document needs for its histograms to be judged.
GUARD_CHARS, GUARD_WORDS = 200, 60
#: A distance d over n characters or words is above its limit if d > limit + spread / sqrt(n): that of short texts scatters more.
LIMIT_CLASSES, SPREAD_CLASSES = 0.26, 1.0
LIMIT_WORDS, SPREAD_WORDS = 0.19, 1.5


def class_counts(text: str) -> np.ndarray:
    return np.bincount(TABLE[np.frombuffer(utf8(text), np.uint8)], minlength=CONTINUED + 1)


def word_places(words: list[bytes]) -> list[int]:
    """Number of each word among the common ones, or OTHER; case and punctuation around a word do not count."""
    return [_PLACE.get(w.lower().strip(_STRIP), OTHER) for w in words]


def repeated_words(words: np.ndarray, lens: np.ndarray, width: int = 5) -> np.ndarray:
    """Of each text, the number of words in windows of `width` words that the text has twice or more."""
    start, text = window_starts(lens, width)
    hashes = window_hashes(words, width)[start] if len(start) else np.zeros(0, np.uint64)
    keys = mix(hashes + mix(text.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order] = same | np.append(same[1:], False)[: len(same)]
    hit = covered(len(words), start[twice], width)
    return np.bincount(np.repeat(np.arange(len(lens)), lens)[hit], minlength=len(lens))


def repeated_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if utf8(line).split():
            n += line in seen
            seen.add(line)
    return n


def jensen_shannon(counts: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Distance of one histogram to each row of references (all of them of sum above 0)."""
    p = counts / counts.sum()
    q = references / references.sum(axis=1, keepdims=True)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        b = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum((a + b) / 2, 0))


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(lang, kind, place, n): summed histograms of a batch."""
    for frame in bounded(batches, "text"):
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for lang, text in zip(frame["lang"], frame["text"], strict=True):
            if text:
                classes, words = sums.setdefault(lang, (np.zeros(CONTINUED + 1, np.int64), np.zeros(OTHER + 1, np.int64)))
                classes += class_counts(text)
                words += np.bincount(np.array(word_places(words_of(text)), np.int64), minlength=OTHER + 1)
        rows = [(lang, kind, k, int(n)) for lang, pair in sums.items() for kind, v in enumerate(pair) for k, n in enumerate(v) if n]
        yield pd.DataFrame(rows, columns=["lang", "kind", "place", "n"])


class References:
    """Histograms of each language: classes of characters, and its most common words."""

    def __init__(self, rows: list[tuple[str, int, int, int]], top: int = 40) -> None:
        self.langs = sorted({r[0] for r in rows})
        at = {x: k for k, x in enumerate(self.langs)}
        self.classes, words = np.zeros((len(at), CONTINUED + 1)), np.zeros((len(at), OTHER + 1))
        for lang, kind, place, n in rows:
            (words if kind else self.classes)[at[lang], place] += n
        self.classes[:, CONTINUED] = 0
        self.words = []
        for row in words:
            best = np.argsort(-row[:OTHER], kind="stable")[:top]
            best = np.sort(best[row[best] > 0])
            self.words.append((best, np.r_[row[best], row.sum() - row[best].sum()]))

    def distances(self, classes: np.ndarray, words: np.ndarray) -> tuple[float, float]:
        """To the language that is nearest by the sum of both (ties: the first by name); 0 where the document is too short, or no language is known."""
        classes = classes.copy()
        classes[CONTINUED] = 0
        far, near = np.zeros(max(1, len(self.langs))), np.zeros(max(1, len(self.langs)))
        if self.langs and classes.sum() >= GUARD_CHARS:
            far = jensen_shannon(classes, self.classes)
        if self.langs and words.sum() >= GUARD_WORDS:
            near = np.array([jensen_shannon(np.r_[words[best], words.sum() - words[best].sum()], row[None])[0] for best, row in self.words])
        best = int(np.argmin(far + near))
        return float(far[best]), float(near[best])


def references(docs: DataFrame) -> References:
    """Summed over all rows of docs(text, lang): at most languages * (classes + common words) rows reach the driver."""
    small_batches(docs.sparkSession)
    sums = docs.select("lang", "text").where("lang is not null and text is not null").mapInPandas(_profile, "lang string, kind int, place int, n long")
    rows = sums.groupBy("lang", "kind", "place").agg(F.sum("n").alias("n"))
    return References([tuple(r) for r in rows.collect()])


def diverges(far: float, near: float, chars: int, words: int) -> bool:
    return far > LIMIT_CLASSES + SPREAD_CLASSES / chars**0.5 or near > LIMIT_WORDS + SPREAD_WORDS / words**0.5


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double, base_failed boolean, kept boolean"


def measured(texts: list[str | None], known: References) -> pd.DataFrame:
    hashes, lens = hashed_words(texts, words_of)
    repeats = repeated_words(hashes, lens)
    rows = []
    for text, n, r in zip(texts, lens.tolist(), repeats.tolist(), strict=True):
        text = text or ""
        classes = class_counts(text)
        words = np.bincount(np.array(word_places(words_of(text)), np.int64), minlength=OTHER + 1)
        blank = classes[CLASSES.index("space")] + classes[CLASSES.index("newline")]
        far, near = known.distances(classes, words)
        failed = n < MIN_WORDS or 100 * r > MAX_REPEATED * n
        chars = int(classes[:CONTINUED].sum() - blank)
        rows.append((n, chars, int(classes[CLASSES.index("symbol")]), repeated_lines(text), r, far, near, failed, not failed and not diverges(far, near, max(1, chars + int(blank)), max(1, n))))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in MEASURES.split(", ")])


def quality(docs: DataFrame, known: References | None = None) -> DataFrame:
    """Counts and verdict for docs(doc_id, text, lang, ...), one row per input row.

    n_words: words [^\\x20\\x09-\\x0D]+; word_chars: code points in them; n_symbols: characters of [#*$%&|<>];
    n_dup_lines: lines with a word, equal to an earlier line of the text; n_repeat_words: words in 5-word
    windows that the text has twice or more; class_distance and word_distance to one language, the nearest: 0 where the text is too short;
    base_failed: n_words < 10, or 100 * n_repeat_words > 20 * n_words; kept: neither that nor a distance above
    its limit. A null text counts as empty (and fails). Rows with a null lang or text add nothing to the
    references; without any reference only the base rules hold. Repeated rows and null ids are judged like
    others; further columns are ignored; an empty table gives an empty result.
    """
    known = known or references(docs)
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(batches, "text"):
            yield pd.concat([frame[["doc_id", "no_id"]], measured(list(frame["text"]), shared.value)], axis=1)

    return restored(guarded(docs, "text").mapInPandas(judge, f"doc_id long, no_id boolean, {MEASURES}"))


def kept_rows(docs: DataFrame) -> DataFrame:
    """docs with all columns, without the rows that quality() does not keep."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(references(docs))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(measured(batch.column("text").to_pylist(), shared.value)["kept"].tolist(), pa.bool_()))
        trim()

    return docs.mapInArrow(keep, docs.schema)
