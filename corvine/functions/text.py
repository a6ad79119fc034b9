"""Scalar text functions as column expressions; null texts count as empty unless stated."""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import small_batches

# Stop words of the tokenizer.
STOPWORDS = (
    "и в во на с со к ко о об по за из для как что это при или а не но от до год "
    "the and or for with from this that are is to of in on by as"
).split()
RAW_TOKEN = r"[\p{L}\p{N}_\-]+"
UNIT = r"[\p{L}\p{N}_\-]+[^\p{L}\p{N}_\-]*"
# What marks an error as worth another try.
RETRY_MARKS = (
    "429", "too many requests", "rate limit", "timed out", "timeout", "temporarily", "connection", "connecterror", "disconnected",
    "remoteprotocolerror", "remote protocol", "server disconnected", "unexpected eof", "unavailable", "reset by peer", "service unavailable",
)
# Failure codes by pattern, first match wins.
FATAL = (("No relevant sources matched goldset patterns", "goldset_validation"), ("Unsupported judge provider", "judge_validation"), ("Invalid RAGAS score", "ragas_validation"))
TRANSIENT = (
    ("LLMDidNotFinish", "llm_did_not_finish"), (r"rate\s*limit|too\s+many\s+requests|\b429\b", "rate_limit"),
    (r"service\s+unavailable|internal\s+server\s+error|bad\s+gateway|gateway\s+timeout|\b5\d\d\b", "server_5xx"),
    (r"connection\s+(error|reset|aborted)|read\s+timeout|connect\s+timeout|temporarily\s+unavailable|network", "network"),
)


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def token_units(text: Column) -> Column:
    """Raw tokens, each with the non-token text after it."""
    return _all(text, UNIT)


def raw_tokens(text: Column) -> Column:
    return _all(text, RAW_TOKEN)


_STOP = frozenset(STOPWORDS)
_WORDS = re.compile(r"[\w\-]+").findall  # \w has just the letters, the numbers and _


@lru_cache(200_000)
def token(word: str) -> str | None:
    """The token of a raw one: lower case, trimmed; none if it is a stop word, short, mostly of digits or without a letter."""
    t = word.lower().replace("ё", "е").strip("-_")
    digits = sum(c.isdecimal() for c in t)
    return t if len(t) >= 2 and t not in _STOP and not (digits > 0 and digits >= len(t) * 0.6) and any(c.isalpha() for c in t) else None


def text_tokens(text: str) -> list[str]:
    # These two alone have a lower case that depends on their place or is more than one character.
    if "İ" not in text and "Σ" not in text:
        text = text.lower().replace("ё", "е")
        return [t for w in _WORDS(text) if w not in _STOP and (t := w if len(w) > 1 and w.isalpha() else token(w))]
    return [t for w in _WORDS(text) if (t := token(w))]


def _tokens(texts: pa.Array) -> pa.Array:
    flat, ends = [], [0]
    for text in texts.to_pylist():
        if text:
            flat += text_tokens(text)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()))


def tokens(text: Column) -> Column:
    """Tokens of the index: lower case, trimmed, without stop words, short ones and those mostly of digits; order kept.

    Python does this many times faster than expressions over each word, since the words of a corpus repeat.
    """
    if spark := SparkSession.getActiveSession():
        small_batches(spark)

    @F.arrow_udf("array<string>")
    def found(texts: pa.Array) -> pa.Array:
        return _tokens(texts)

    return found(text)


def normalize_ws(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def years(text: Column) -> Column:
    """Distinct maximal digit runs that are years from 1900 to 2099, in order of the first one."""
    return F.array_distinct(_all(text, r"(?<!\d)(?:19|20)\d{2}(?!\d)"))


def poison_signals(text: Column) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    size = F.greatest(F.lit(1), F.length(text))
    escapes = F.regexp_count(text, F.lit(r"\\[nrt]|\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}"))
    slashes = F.length(text) - F.length(F.replace(text, F.lit("\\"), F.lit("")))
    control = F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))
    return {"escaped_per_1k": escapes * 1000.0 / size, "backslash_per_1k": slashes * 1000.0 / size, "control_ratio": control / size}


def looks_like_table(text: Column) -> Column:
    """At least five non-blank lines, and of the first 60 at least four with a pipe, a tab, or three parts set apart by two spaces."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    hit = lambda x: x.contains("|") | x.contains("\t") | (F.size(F.filter(F.split(F.trim(x), r" {2,}"), lambda p: p != "")) >= 3)
    return (F.size(lines) >= 5) & (F.size(F.filter(F.slice(lines, 1, 60), hit)) >= 4)


def text_key(text: Column) -> Column:
    return F.lower(normalize_ws(text))


def slug(text: Column, limit: int = 60) -> Column:
    """Letters, digits, dots and dashes; other runs become underscores; `file` if nothing is left."""
    kept = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), F.lit("._-"))
    return F.coalesce(F.nullif(F.substring(kept, 1, limit), F.lit("")), F.lit("file"))


def clamp_score(x: Column) -> Column:
    """Null, not-a-number and infinite scores are 0; others are kept within 0 and 1."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, 0.0).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def is_retryable(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    found = F.lit(False)
    for mark in RETRY_MARKS:
        found = found | text.contains(mark)
    return found


def failure_class(status: Column, message: Column) -> tuple[Column, Column]:
    """(code, worth another try): timeouts, then fatal, then transient patterns, else `failed`."""
    code, again = F.when(status == "timeout", "timeout"), F.when(status == "timeout", True)
    for patterns, retry in ((FATAL, False), (TRANSIENT, True)):
        for pattern, name in patterns:
            hit = F.coalesce(message, F.lit("")).rlike(f"(?i){pattern}")
            code, again = code.when(hit, name), again.when(hit, retry)
    return code.otherwise("failed"), again.otherwise(False)


def adaptive_timeout(pages: Column, megabytes: Column, full: Column, base: int = 45, per_100: int = 30, per_10mb: int = 20, most: int = 600) -> Column:
    seconds = F.lit(base) + F.ceil(pages / 100) * per_100 + F.ceil(megabytes / 10) * per_10mb
    return F.least(F.greatest(F.when(full, F.floor(seconds * 1.8)).otherwise(seconds), F.lit(15)), F.lit(most)).cast("int")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


def looks_like_pdf_table(text: Column) -> Column:
    """Of the first 80 lines, at least three with a pipe or six with three parts set apart by two white space characters."""
    lines = F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, 80)
    parts = lambda x: F.size(F.filter(F.split(F.btrim(x, F.lit(" \t\r")), r"[ \t]{2,}"), lambda p: p != ""))
    return (F.size(F.filter(lines, lambda x: x.contains("|"))) >= 3) | (F.size(F.filter(lines, lambda x: parts(x) >= 3)) >= 6)


def json_list(text: Column) -> Column:
    """Non-blank items of a text that is a JSON array, or of the array from its first bracket to its last; else none."""
    text = F.coalesce(text, F.lit(""))
    block = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    parsed = F.coalesce(F.from_json(F.trim(text), "array<string>"), F.from_json(block, "array<string>"))
    return F.coalesce(F.filter(parsed, lambda x: F.trim(x) != ""), F.array().cast("array<string>"))


def token_limit(message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return text.contains("tokens limit exceeded") | text.contains("requestentitytoolargeerror")


def offending_index(message: Column, batch: Column) -> Column:
    """The item that a backend names as too long, or null if it names none of the batch."""
    index = F.regexp_extract(F.coalesce(message, F.lit("")), r"(?i)index\s+(\d+)\s*:", 1).try_cast("int")
    return F.when((index >= 0) & (index < batch), index)


def halves(text: Column) -> tuple[Column, Column]:
    """A text in two at the white space nearest its middle: back first, then forward, within a tenth of it (40 to 400); else at the middle."""
    space = " \t\n\r\f"
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(space))
    n = F.length(whole)
    mid = F.floor(n / 2).cast("int")
    window = F.least(F.lit(400), F.greatest(F.lit(40), F.floor(n / 10))).cast("int")
    low, high = F.greatest(F.lit(1), mid - window), F.least(n - 1, mid + window)
    back = F.substring(whole, low + 1, mid - low + 1)
    ahead = F.substring(whole, mid + 2, high - mid)
    cut = F.when(back.rlike(r"\s"), mid - F.length(F.regexp_extract(back, r"\s(\S*)\z", 1))).when(ahead.rlike(r"\s"), mid + 1 + F.length(F.regexp_extract(ahead, r"^\S*", 0))).otherwise(mid)
    short = n <= 2
    left = F.when(short, whole).otherwise(F.btrim(F.substring(whole, F.lit(1), cut), F.lit(space)))
    return left, F.when(short, "").otherwise(F.btrim(F.substring(whole, cut + 1, n), F.lit(space)))


def resolved_timeout(adaptive: Column, cap: Column, remaining: Column) -> Column:
    """Seconds of an attempt: the least of its own limit, the stage's cap and what remains; 0 if nothing remains."""
    return F.when(F.coalesce(remaining <= 0, F.lit(False)), 0).otherwise(F.least(adaptive, cap, F.ceil(remaining))).cast("int")


def attempt_flags(status: Column, reason: Column, chunks: Column) -> dict[str, Column]:
    """success, timed out, and timed out without chunks; null reasons name nothing."""
    late = F.lower(F.coalesce(reason, F.lit(""))).startswith("timeout:")
    return {"success": F.coalesce(status.isin("pass", "soft_fail"), F.lit(False)), "timed_out": late, "timed_out_empty": late & (F.coalesce(chunks, F.lit(0)) == 0)}


def first_distinct(items: Column, most: int) -> Column:
    """Distinct non-blank items in order, at most max(1, most) of them."""
    return F.slice(F.array_distinct(F.filter(items, lambda x: F.trim(x) != "")), 1, max(1, most))
