"""Text scalars as column expressions; classes are spelled out so that engines agree on them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cleaning rules in order, personal-data patterns in order, screens.
CLEANING_RULES = (
    (r"[ \t]+", " "),
    (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""),
    (r"\n{3,}", "\n\n"),
)
PII_PATTERNS = (
    ("email", r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.]+"),
    ("phone_in", r"\b[6-9][0-9]{9}\b"),
    ("street_address", r"\b[0-9]{1,4}\s+[A-Z][a-z]+\s+(?:Road|Street|Marg|Lane|Nagar)\b"),
)
SHINGLE_WORDS, NEAR_DUPLICATE, CONTAINMENT_WORDS, REGISTRY_OVERLAP = 5, 0.55, 13, 0.12
REPEAT_LARGEST, REPEAT_RUN = 13, 32

URL = r"https?://[^\s<>]+"
PHONE = r"\+?[0-9][0-9 ().-]{7,}[0-9]"


def clean_text(text: Column | str) -> Column:
    out = F.col(text) if isinstance(text, str) else text
    for pattern, repl in CLEANING_RULES:
        out = F.regexp_replace(out, pattern, repl)
    return F.trim(out, F.lit(" \t\n\r"))


def pii_kinds(text: Column) -> Column:
    """Kinds present, sorted by name."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in sorted(PII_PATTERNS))))


def redact_pii(text: Column) -> Column:
    for kind, pattern in PII_PATTERNS:
        text = F.regexp_replace(text, pattern, f"<redacted:{kind}>")
    return text


def typed_redaction(text: Column) -> Column:
    text = F.regexp_replace(text, URL, "[URL]")
    text = F.regexp_replace(text, PII_PATTERNS[0][1], "[EMAIL]")
    return F.regexp_replace(text, PHONE, "[PHONE]")


def words(text: Column | str) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once per row; a plain alias would be computed anew at every use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def shingles(words_: Column, n: int = SHINGLE_WORDS, short_whole: bool = True) -> Column:
    """Distinct word n-grams of a word array; a shorter text is one shingle, or none."""
    whole = F.array(F.array_join(words_, " ")) if short_whole else F.array().cast("array<string>")
    short = F.when(F.size(words_) == 0, F.array().cast("array<string>")).otherwise(whole)
    grams = F.transform(F.sequence(F.lit(1), F.size(words_) - (n - 1)), lambda i: F.array_join(F.slice(words_, i, n), " "))
    return F.when(F.size(words_) < n, short).otherwise(F.array_distinct(grams))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def newline_normalised(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def tag_stripped(html: Column) -> Column:
    html = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def unified_markers(text: Column) -> Column:
    """Chat markers of several conventions as ``<|role|>``."""
    text = F.regexp_replace(text, r"<\|im_start\|>\s*(user|assistant|system)\s*", r"<|$1|> ")
    text = F.regexp_replace(text, r"\s*<\|im_end\|>", "")
    text = F.regexp_replace(text, r"\[(USER|INST)\]\s*", "<|user|> ")
    return F.regexp_replace(text, r"\[(ASSISTANT|/INST)\]\s*", "<|assistant|> ")


def visible(text: Column) -> Column:
    """Without control, zero-width, direction and byte-order marks; joiners stay."""
    return F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F​‎‏‪-‮⁦-⁩﻿]", "")


def multibyte_share(text: Column) -> Column:
    return F.when(F.octet_length(text) == 0, 0.0).otherwise(
        (F.octet_length(text) - F.length(F.regexp_replace(text, "[^\\x00-\\x7F]", ""))) / F.octet_length(text)
    )


def trimmed_word(word: Column) -> Column:
    """Without leading and trailing punctuation and symbols."""
    return F.regexp_replace(word, r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$", "")


def between_markers(text: Column, start: str, end: str) -> Column:
    """What stands after the start marker's line and before the end marker; all of it where one is missing."""
    after = F.regexp_replace(text, rf"(?s)^.*?{start}[^\n]*\n", "")
    return F.regexp_replace(after, rf"(?s){end}.*$", "")
