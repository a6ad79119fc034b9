"""Chunkers: a text column becomes rows of (chunk_ord, chunk)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import normalize_ws, raw_tokens, token_units

STRIP = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), STRIP, "")


def char_chunks(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of stripped, non-empty pieces of `size` characters, each `overlap` back from the end of the one before."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be above 0 and overlap below size")
    text, step = strip(text), size - overlap
    last = F.when(F.length(text) <= size, 0).otherwise(F.ceil((F.length(text) - size) / step)).cast("int")
    return F.filter(F.transform(F.sequence(F.lit(0), last), lambda k: strip(F.substr(text, k * step + 1, F.lit(size)))), lambda x: x != "")


def let(value: Column, use) -> Column:
    """use(value), with the value computed once: an expression that a lambda mentions is evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def token_chunks(text: Column, most: int, overlap: int) -> Column:
    """Windows of `most` raw tokens; short texts whole, texts without tokens by characters; white space normalised."""
    step = most - overlap

    def pieces(found: Column) -> Column:
        units, raw = found["units"], found["raw"]
        n = F.size(raw)

        def window(k: Column) -> Column:
            end = F.least(k * step + most, n)
            return normalize_ws(F.concat(F.array_join(F.slice(units, k * step + 1, end - k * step - 1), ""), F.element_at(raw, end)))

        last = F.greatest(F.ceil((n - most) / step).cast("int"), F.lit(0))
        whole = F.filter(F.array(normalize_ws(text)), lambda x: x != "")
        return F.when(n == 0, char_chunks(text, max(600, 6 * most), 6 * overlap)).when(n <= most, whole).otherwise(F.transform(F.sequence(F.lit(0), last), window))

    return let(F.struct(token_units(text).alias("units"), raw_tokens(text).alias("raw")), pieces)


def chunked(df: DataFrame, chunks: Column) -> DataFrame:
    """df with chunk_ord (from 0) and chunk, a row for each piece."""
    return df.select("*", F.posexplode(chunks).alias("chunk_ord", "chunk"))


def section_chunks(df: DataFrame, text: str, most: int, overlap: int) -> DataFrame:
    """token_chunks of every section (set apart by blank lines); chunk_ord runs through the text."""
    sections = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\n\s*\n+"), lambda x: strip(x) != "")
    pieces = F.flatten(F.transform(sections, lambda s: token_chunks(s, most, overlap)))
    return chunked(df, pieces)


def table_chunks(df: DataFrame, text: str, most: int, overlap: int) -> DataFrame:
    """Whole lines packed up to `most` tokens (a line of more stands alone), with whole lines of overlap; a sequential fold."""
    import re

    token = re.compile(r"[\w\-]+")

    def pack(s: str | None) -> list[str]:
        lines = [x for x in (s or "").split("\n") if x.strip()]
        sizes = [max(1, len(token.findall(x))) for x in lines]
        out, at = [], 0
        while at < len(lines):
            end, total = at, 0
            while end < len(lines) and (end == at or total + sizes[end] <= most):
                total += sizes[end]
                end += 1
            out.append("\n".join(lines[at:end]))
            if end == len(lines):
                break
            back, held = end, 0
            while back > at and held < overlap:
                back -= 1
                held += sizes[back]
            at = back if back > at else end
        return out

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(pack)

    return chunked(df, packed(F.col(text)))


def chunk_long(docs: DataFrame, text: str, kind: str, mode: str = "token", most: int = 200, overlap: int = 20) -> DataFrame:
    """docs with chunk_ord and chunk by element type: rows of kind `table` by lines, all others by tokens or characters.

    Token mode takes at least 64 tokens and at most one less in overlap. Character mode takes at least 200
    characters, a fifth of the size in overlap if that is not below the size, and normalises white space first.
    """
    if mode not in ("token", "char"):
        raise ValueError("mode must be token or char")
    table = F.coalesce(F.lower(kind) == "table", F.lit(False))
    if mode == "char":
        most = max(200, most)
        overlap = most // 5 if overlap >= most else max(0, overlap)
        return chunked(docs, char_chunks(F.when(table, F.col(text)).otherwise(normalize_ws(F.col(text))), most, overlap))
    most = max(64, most)
    overlap = min(max(0, overlap), most - 1)
    return chunked(docs.where(~table), token_chunks(F.col(text), most, overlap)).unionByName(table_chunks(docs.where(table), text, most, overlap))
