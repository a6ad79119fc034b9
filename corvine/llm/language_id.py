"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is lower-cased, everything but letters becomes a word border, and the byte n-grams within words
(borders included) are hashed into BUCKETS embeddings. Their average goes through a linear layer and a
softmax. Embeddings and layer are trained together by stochastic gradient descent in numpy, on at most
PER_LANGUAGE labelled documents of each language (those of least seeded hash). A fifth of them is held back
to fit the softmax's temperature and the score below which a prediction counts as rejected.

Because the model is linear in the average, a trained model is one table of a row of logits for each bucket:
prediction sums rows of that table over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, guarded, restored, small_batches, utf8

BUCKETS, DIM = 1 << 13, 16
SIZES = (2, 3, 4)
PER_LANGUAGE = 500
#: Steps of the descent, whatever the number of documents; documents of a step; first rate.
STEPS, BATCH, RATE = 1200, 32, 4.0
#: Share of the right held-back predictions that the rejection score lets pass.
ACCEPTED = 0.99
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
TABLE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def subwords(text: str) -> np.ndarray:
    """Bucket of every byte n-gram of the text's words, borders included."""
    data = b" " + b" ".join(utf8(text.lower()).translate(TABLE).split()) + b" "
    raw = np.frombuffer(data, np.uint8)
    blank = raw == 32
    out = []
    for size in SIZES:
        n = len(raw) - size + 1
        if n <= 0:
            continue
        key = np.full(n, size, np.uint64)
        inner = np.zeros(n, bool)
        for k in range(size):
            key = key << np.uint64(8) | raw[k : k + n]
            if 0 < k < size - 1:
                inner |= blank[k : k + n]
        key = key[~inner] * np.uint64(0x9E3779B97F4A7C15)
        out.append((key >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """langs, a table of logits by bucket, a bias, the temperature and the rejection score."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray) -> None:
        self.langs, self.table, self.bias = langs, table, bias
        self.temperature, self.reject = 1.0, 0.0

    def logits(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); a text that is null or has no letter is UNKNOWN."""
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        ids = subwords(text)
        p = softmax(self.logits(self.table[ids].sum(axis=0)[None], np.array([len(ids)])) / self.temperature)[0]
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.reject)


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 5) -> Model:
    """features: (buckets, counts) of each document."""
    langs = sorted(set(labels))
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(y))
    held, fitted = order[: len(y) // 5], order[len(y) // 5 :]
    embed = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    layer = rng.normal(0, 0.3, (DIM, len(langs))).astype(np.float32)
    bias = np.zeros(len(langs), np.float32)
    queue: list[int] = []
    for done in range(STEPS):
        if len(queue) < BATCH:
            queue += rng.permutation(fitted).tolist()
        rows, queue = np.array(queue[:BATCH]), queue[BATCH:]
        ids = np.concatenate([features[r][0] for r in rows])
        share = np.concatenate([features[r][1] / max(1, features[r][1].sum()) for r in rows]).astype(np.float32)
        owner = np.repeat(np.arange(len(rows)), [len(features[r][0]) for r in rows])
        mean = np.zeros((len(rows), DIM), np.float32)
        np.add.at(mean, owner, embed[ids] * share[:, None])
        grad = softmax(mean @ layer + bias)
        grad[np.arange(len(rows)), y[rows]] -= 1
        grad /= len(rows)
        rate = RATE * (1 - done / STEPS)
        np.add.at(embed, ids, -rate * share[:, None] * (grad @ layer.T)[owner])
        layer -= rate * 0.1 * mean.T @ grad
        bias -= rate * 0.1 * grad.sum(axis=0)
    model = Model(langs, (embed @ layer).astype(np.float64), bias.astype(np.float64))
    if len(held):
        sums = np.array([(model.table[features[r][0]] * features[r][1][:, None]).sum(axis=0) for r in held])
        logits = model.logits(sums, np.array([features[r][1].sum() for r in held]))
        grid = np.geomspace(0.05, 10, 60)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(logits / t)[np.arange(len(held)), y[held]] + 1e-12).sum()))
        p = softmax(logits / model.temperature)
        right = p.max(axis=1)[p.argmax(axis=1) == y[held]]
        model.reject = float(np.quantile(right, 1 - ACCEPTED)) if len(right) else 0.0
    return model


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        pairs = [np.unique(subwords(t), return_counts=True) for t in frame["text"]]
        yield frame[["doc_id", "lang"]].assign(ids=[a.astype("<i4").tobytes() for a, _ in pairs], counts=[b.astype("<i8").tobytes() for _, b in pairs])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def learned(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """A model of docs(doc_id, text, lang) with all three non-null and a letter in the text.

    At most per_language documents of each language reach the driver, as bucket counts of their whole texts.
    """
    small_batches(docs.sparkSession)
    usable = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    # Ids are drawn first, so that texts of the drawn rows alone are shuffled: the ids have per_language rows a language.
    keyed = usable.withColumn("tie", F.xxhash64("text"))
    drawn = keyed.select("doc_id", "lang", "tie").withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "tie"))).where(F.col("n") <= per_language)
    sample = keyed.join(F.broadcast(drawn.select("doc_id", "lang", "tie")), ["doc_id", "lang", "tie"], "left_semi").select("doc_id", "lang", "text")
    rows = sorted(sample.mapInPandas(_count, "doc_id long, lang string, ids binary, counts binary").collect())
    return train([(np.frombuffer(r.ids, "<i4").astype(np.int64), np.frombuffer(r.counts, "<i8")) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, lang_pred, score (0 to 1), rejected; one row per input row.

    lang_pred is `und` (score 0, rejected) if the text is null, empty or without a letter, or if the model
    knows no language. rejected: the score is below the calibrated one. The text alone decides; repeated rows
    get equal rows, a null doc_id stays null, further columns are ignored, an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in bounded(batches, "text"):
            found = [shared.value.predict(t) for t in frame["text"]]
            yield frame[["doc_id", "no_id"]].assign(lang_pred=[x[0] for x in found], score=[x[1] for x in found], rejected=[x[2] for x in found])

    return restored(guarded(docs, "text").mapInPandas(rows, "doc_id long, no_id boolean, lang_pred string, score double, rejected boolean"))
