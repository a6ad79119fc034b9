"""Settings from the environment and an optional file of NAME=value lines, with clamps and fallbacks."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any


def _words(text: str) -> tuple[str, ...]:
    return tuple(part.strip().lower() for part in text.split(",") if part.strip())


def _flag(text: str) -> bool:
    return {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}[text.strip().lower()]


@dataclass(frozen=True)
class Rule:
    """How one setting is read: a blank or malformed value leaves the default; numbers are kept within bounds, names within choices."""

    default: Any
    low: float | None = None
    high: float | None = None
    choices: tuple[str, ...] = ()

    def read(self, text: str | None) -> Any:
        value = self.default
        if text is not None and text.strip():
            kinds: dict[type, Callable[[str], Any]] = {bool: _flag, int: int, float: float, tuple: _words, str: str}
            try:
                value = kinds[type(self.default)](text)
            except (ValueError, KeyError):
                value = self.default
        if self.choices:
            value = value.strip().lower()
            return value if value in self.choices else self.default
        if isinstance(value, tuple):
            return value or self.default
        if not isinstance(value, (bool, str)):
            value = value if self.low is None else max(type(value)(self.low), value)
            value = value if self.high is None else min(type(value)(self.high), value)
        return value


OCR = ("easyocr", "rapidocr", "tesseract", "none")
# Names, defaults and bounds.
RULES = {
    "DATA_DIR": Rule("data"),
    "INDEX_DIR": Rule(".rag_index"),
    "INGEST_PROFILE": Rule("demo-fast"),
    "DEFAULT_EXTRACTOR": Rule("pymupdf4llm"),
    "DEFAULT_RERANKER": Rule("amberoad"),
    "RETRIEVE_TOP_K": Rule(50),
    "RERANK_TOP_N": Rule(10),
    "FINAL_TOP_K": Rule(8),
    "RETRIEVAL_SOURCE_DIVERSITY_ENABLED": Rule(True),
    "RETRIEVAL_SOURCE_MAX_CHUNKS_PER_SOURCE": Rule(2, 1),
    "RETRIEVAL_YEAR_BOOST_ENABLED": Rule(True),
    "RETRIEVAL_YEAR_BOOST": Rule(0.12, 0),
    "REWRITE_N": Rule(3),
    "RRF_K": Rule(60),
    "EXTRACT_TIMEOUT_SEC": Rule(180),
    "EXTRACT_TIMEOUT_BASE_SEC": Rule(45),
    "EXTRACT_TIMEOUT_PER_100_PAGES_SEC": Rule(30),
    "EXTRACT_TIMEOUT_PER_10MB_SEC": Rule(20),
    "EXTRACT_TIMEOUT_MAX_SEC": Rule(600),
    "EXTRACT_FULL_QUALITY_DOCLING_PRIMARY_MAX_SEC": Rule(300, 0),
    "EXTRACT_FULL_QUALITY_DOCLING_SECONDARY_MAX_SEC": Rule(240, 0),
    "EXTRACT_FULL_QUALITY_PYMUPDF_MAX_SEC": Rule(180, 0),
    "EXTRACT_FULL_QUALITY_RESERVE_WINDOW_FALLBACK_SEC": Rule(180, 0),
    "EXTRACT_FULL_QUALITY_MIN_STAGE_START_SEC": Rule(15, 1),
    "EXTRACT_FULL_QUALITY_UNSTRUCTURED_MIN_REMAINING_SEC": Rule(90, 0),
    "EXTRACT_PREFER_BEST_USABLE": Rule(True),
    "EXTRACT_BEST_USABLE_MIN_COVERAGE_GAP": Rule(0.15, 0),
    "UNSTRUCTURED_MIN_MERGED_CHUNK_CHARS": Rule(220, 80),
    "EXTRACT_LOW_COVERAGE_RECOVERY_ENABLED": Rule(True),
    "EXTRACT_LOW_COVERAGE_RECOVERY_TRIGGER_COVERAGE": Rule(0.35, 0, 1),
    "EXTRACT_LOW_COVERAGE_RECOVERY_BATCH_PAGES": Rule(120, 1),
    "EXTRACT_LOW_COVERAGE_RECOVERY_MAX_PAGES": Rule(360, 1),
    "EXTRACT_LOW_COVERAGE_RECOVERY_SOFTFAIL_MIN_COVERAGE": Rule(0.55, 0, 1),
    "PAGE_WINDOW_SIZE": Rule(40),
    "EXTRACT_MIN_PAGE_COVERAGE": Rule(0.85),
    "EXTRACT_MIN_CHARS_PER_PAGE": Rule(450.0),
    "EXTRACT_MAX_EMPTY_PAGE_RATIO": Rule(0.25),
    "EXTRACT_MAX_SHORT_CHUNK_RATIO": Rule(0.55),
    "EXTRACT_MAX_ESCAPED_SEQ_PER_1K": Rule(18.0, 0),
    "EXTRACT_MAX_BACKSLASH_PER_1K": Rule(30.0, 0),
    "EXTRACT_MAX_CONTROL_CHAR_RATIO": Rule(0.003, 0, 1),
    "EXTRACT_POISONED_PAGE_RATIO_HARD": Rule(0.35, 0, 1),
    "UNSTRUCTURED_TARGETED_ONLY": Rule(True),
    "DOCLING_OCR_BACKEND": Rule("easyocr", choices=OCR),
    "DOCLING_OCR_FALLBACKS": Rule(("easyocr", "tesseract", "rapidocr", "none")),
    "DOCLING_OCR_LANGS_EASYOCR": Rule(("ru", "en")),
    "DOCLING_OCR_LANGS_TESSERACT": Rule(("rus", "eng")),
    "CHUNK_MODE": Rule("token", choices=("token", "char")),
    "CHUNK_TOKENS_PROSE": Rule(360, 64),
    "CHUNK_TOKENS_TABLE": Rule(220, 64),
    "CHUNK_OVERLAP_PROSE": Rule(60, 0),
    "CHUNK_OVERLAP_TABLE": Rule(30, 0),
    "CHUNK_CHARS_PROSE": Rule(1600, 600),
    "CHUNK_CHARS_TABLE": Rule(1500, 600),
    "CHUNK_OVERLAP_CHARS_PROSE": Rule(160, 0),
    "CHUNK_OVERLAP_CHARS_TABLE": Rule(120, 0),
    "EMBEDDING_BATCH_SIZE": Rule(32, 1),
    "GROUNDED_MIN_TOP_RERANK_SCORE": Rule(4.5),
    "GROUNDED_MIN_TOTAL_CONTEXT_CHARS": Rule(800),
    "GROUNDED_MIN_CHUNKS": Rule(3, 1),
    "RERANK_YEAR_RETENTION_ENABLED": Rule(True),
    "RERANK_YEAR_RETENTION_MAX_SCORE_GAP": Rule(0.35, 0),
    "PREFLIGHT_TTL_SEC": Rule(300, 0),
    "API_MAX_RETRIES": Rule(3, 0),
    "API_RETRY_BACKOFF_SEC": Rule(1.25, 0.1),
    "PREWARM_RERANKERS": Rule(False),
    "PDF_REGRESSION_WALLCLOCK_CAP_SEC": Rule(900, 0),
}


class Settings(dict):
    """Values by lower-case name, as items and as attributes."""

    def __getattr__(self, name: str) -> Any:
        try:
            return self[name]
        except KeyError:
            raise AttributeError(name) from None


def env_file(path: str) -> dict[str, str]:
    """NAME=value lines; blank lines and those that begin with # are skipped, quotes around a value go."""
    out = {}
    with open(path, encoding="utf-8") as f:
        for line in f:
            name, found, value = line.strip().partition("=")
            if found and not name.startswith("#"):
                out[name.removeprefix("export ").strip()] = value.strip().strip("'\"")
    return out


def load(path: str | None = None, environment: Mapping[str, str] | None = None) -> Settings:
    """Settings of the file, under those of the environment."""
    given = {**(env_file(path) if path else {}), **(os.environ if environment is None else environment)}
    out = Settings({name.lower(): rule.read(given.get(name)) for name, rule in RULES.items()})
    most = "extract_low_coverage_recovery_max_pages"
    out[most] = max(out[most], out.extract_low_coverage_recovery_batch_pages)
    soft = "extract_low_coverage_recovery_softfail_min_coverage"
    out[soft] = min(out[soft], out.extract_min_page_coverage)
    return out


def profile(name: str | None, fast: bool = False, extractor: str = "") -> str:
    """demo-fast or full-quality, by name or else by what was asked for."""
    named = {"demo-fast": "demo-fast", "demo_fast": "demo-fast", "fast": "demo-fast", "full-quality": "full-quality", "full_quality": "full-quality", "quality": "full-quality"}
    return named.get((name or "").strip().lower()) or ("demo-fast" if fast or extractor == "pymupdf4llm" else "full-quality")


def ocr_order(first: str, fallbacks: tuple[str, ...]) -> list[str]:
    """Back ends in the order in which they are tried: the first, its usual second, the fallbacks, none; each known one once."""
    first = first.strip().lower()
    first = first if first in OCR else OCR[0]
    wanted = [first, "easyocr" if first == "rapidocr" else "rapidocr", *(x.strip().lower() for x in fallbacks), "none"]
    return [x for x in dict.fromkeys(wanted) if x in OCR]
