"""Splitting texts into words and sentences. Sizes are bytes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space in the Unicode sense.
SPACE = r"\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Punctuation cut from both ends of a word.
PUNCTUATION = r"""[.,!?;:()\[\]{}"'`]"""
TOKEN_PUNCTUATION = r"""[.,!?;:()\[\]{}"'`\-]"""


def trim_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def words(text: Column) -> Column:
    # the plain class is several times faster, and the same on ASCII text
    parts = F.when(is_ascii(text), F.split(text, r"\s+", -1)).otherwise(F.split(text, f"[{SPACE}]+", -1))
    return F.filter(parts, lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.when(is_ascii(text), F.regexp_count(text, F.lit(r"\S+"))).otherwise(F.regexp_count(text, F.lit(f"[^{SPACE}]+")))


def strip_punctuation(word: Column, cut: str = PUNCTUATION) -> Column:
    return F.regexp_replace(word, f"^{cut}+|{cut}+\\z", "")


def content_words(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words without outer punctuation, longer than two bytes and not on the stop list."""
    found = F.transform(words(F.lower(text)), lambda w: strip_punctuation(w))
    if stop:
        return F.filter(found, lambda w: (F.octet_length(w) > 2) & ~w.isin(stop))
    return F.filter(found, lambda w: F.octet_length(w) > 2)


def sentences(text: Column, separator: str) -> Column:
    return F.filter(F.transform(F.split(text, separator, -1), trim_space), lambda s: s != "")


def byte_prefix(text: Column, limit: int) -> Column:
    """The first ``limit`` bytes, moved back to a character boundary."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, limit)
    # drop a trailing lead byte with too few continuation bytes
    tail = F.hex(F.substring(F.encode(text, "UTF-8"), limit + 1, 1))
    split_char = tail.rlike("^[89AB]")
    clean = F.regexp_replace(F.hex(raw), "(?:C[2-9A-F]|D[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-4](?:[89AB][0-9A-F]){0,2})$", "")
    return F.when(F.octet_length(text) <= limit, text).when(split_char, F.decode(F.unhex(clean), "UTF-8")).otherwise(F.decode(raw, "UTF-8"))
