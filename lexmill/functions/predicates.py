"""Row predicates over labels and fact texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import collapse, contains_any, strip, words


def any_pattern(x: Column, patterns: list[str], any_case: bool = True) -> Column:
    return x.rlike(("(?i)" if any_case else "") + "|".join(f"(?:{p})" for p in patterns))


def is_noise_fact(content: Column) -> Column:
    """Blank, or with a trace of quizzes and answer keys."""
    text = F.coalesce(content, F.lit(""))
    return (strip(text) == "") | any_pattern(text, vocab.NOISE_PATTERNS)


def _bare(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, "[.,!?;:]+$", ""))


def is_internal_label(x: Column) -> Column:
    low = collapse(F.lower(F.coalesce(x, F.lit(""))))
    return (low == "") | low.isin(vocab.INTERNAL_LABELS) | (low.contains("canonicalize") & low.contains("concept"))


def is_valid_concept(name: Column, whole_words: bool = False) -> Column:
    """Whether a label can name a concept.  whole_words: countries only count as words, not inside others."""
    x = strip(F.coalesce(name, F.lit("")))
    low, w = F.lower(x), words(x)
    first, last = _bare(F.get(w, F.lit(0))), _bare(F.try_element_at(w, F.lit(-1)))
    if whole_words:
        country = any_pattern(low, [rf"\b{c.lower()}\b" for c in vocab.COUNTRIES_REGIONS])
    else:
        country = contains_any(low, [c.lower() for c in vocab.COUNTRIES_REGIONS])
    verb = F.exists(w, lambda t: _bare(t).endswith("ing") & ~_bare(t).isin(vocab.ING_NOUNS))
    vague = x.rlike("^(?:" + "|".join(vocab.VAGUE_STARTS) + ")")
    rejected = [
        x == "", low.isin(vocab.RESERVED_VALUES), x.rlike(r"\b(19|20)\d{2}\b"), F.size(w) > 6, x.rlike(r"'s\b"),
        x.rlike(r"\b[A-Z]\s+[A-Z]\b"), country, verb, vague, first.isin(vocab.IMPERATIVES),
        (F.size(w) == 1) & low.isin(vocab.GENERIC_WORDS), first.isin(vocab.ADJECTIVES),
        last.isin(vocab.RESOURCE_SUFFIXES), is_internal_label(x),
    ]
    return ~reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), rejected)


def is_question(x: Column) -> Column:
    return strip(x).endswith("?")


def looks_like_uuid(x: Column) -> Column:
    return F.lower(strip(x)).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")


def all_sources_are_uuids(sources: Column) -> Column:
    """Of an array of sources: none that is known is anything but a UUID."""
    return ~F.exists(sources, lambda s: ~s.isin("", "unknown") & ~looks_like_uuid(s))


def needs_canonicalization(x: Column) -> Column:
    """Signs of a label that was put together badly."""
    signs = [r"\b[A-Za-z]\b", r"^\s|\s$|\s{2,}", r"[^\w\s]{2,}", r"(?i)\b(\w+)\s+\1\b", r"\b[a-z]+[A-Z]\w*\b"]
    return any_pattern(x, signs, any_case=False)
