"""Predicates over two token arrays of match_tokens; all but antonyms are symmetric equalities Catalyst can hash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab


def _prefix(w: Column) -> Column:
    return F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))


def _last(w: Column) -> Column:
    return F.try_element_at(w, F.lit(-1))


def is_duplicate(a: Column, b: Column) -> Column:
    """Equal, or of one length with one token that differs by one edit."""
    differ = F.filter(F.zip_with(a, b, lambda x, y: F.when(~x.eqNullSafe(y), F.levenshtein(x, y))), lambda d: d.isNotNull())
    return (F.size(a) == F.size(b)) & ((a == b) | ((F.size(differ) == 1) & (F.get(differ, F.lit(0)) == 1)))


def is_sibling(a: Column, b: Column) -> Column:
    """Same head, other modifiers."""
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (_last(a) == _last(b)) & (_prefix(a) != _prefix(b))


def is_cousin(a: Column, b: Column) -> Column:
    """Same modifiers, another head."""
    return (F.size(a) >= 2) & (F.size(a) == F.size(b)) & (_last(a) != _last(b)) & (_prefix(a) == _prefix(b))


def bigrams(w: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.slice(w, i, 2)))
    return F.when(F.size(w) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def has_strong_overlap(a: Column, b: Column) -> Column:
    """Two tokens in a row in common."""
    return F.arrays_overlap(bigrams(a), bigrams(b))


def has_antonyms(a: Column, b: Column, antonyms: list[tuple[str, str]] | None = None) -> Column:
    """A pair of opposites split between both."""
    has = F.array_contains
    tests = [(has(a, x) & has(b, y)) | (has(a, y) & has(b, x)) for x, y in antonyms or vocab.ANTONYMS]
    return reduce(lambda p, q: p | q, tests)


def are_similar(a: Column, b: Column, antonyms: list[tuple[str, str]] | None = None) -> Column:
    shared = F.size(F.array_intersect(a, b))
    least = F.greatest(F.lit(2.0), 0.5 * F.least(F.size(a), F.size(b)))
    close = ~is_sibling(a, b) & ~is_cousin(a, b) & has_strong_overlap(a, b) & (shared >= least)
    return ~has_antonyms(a, b, antonyms) & (is_duplicate(a, b) | close)


def is_clusterable(a: Column, b: Column, antonyms: list[tuple[str, str]] | None = None) -> Column:
    return (F.size(a) >= 2) & (a == b) & ~has_antonyms(a, b, antonyms)


def contains_run(a: Column, b: Column) -> Column:
    """The shorter of both, two tokens at least, is a run of the longer."""
    framed = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    return (F.least(F.size(a), F.size(b)) >= 2) & F.when(F.size(a) <= F.size(b), framed(b).contains(framed(a))).otherwise(framed(a).contains(framed(b)))


def differs_by_one_word(a: Column, b: Column) -> Column:
    longer = F.when(F.size(a) > F.size(b), a).otherwise(b)
    shorter = F.when(F.size(a) > F.size(b), b).otherwise(a)
    mismatches = F.size(F.filter(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), lambda d: d))
    one_more = (F.abs(F.size(a) - F.size(b)) == 1) & F.forall(shorter, lambda t: F.array_contains(longer, t))
    return (F.least(F.size(a), F.size(b)) >= 2) & (one_more | ((F.size(a) == F.size(b)) & (mismatches == 1)))


def near_duplicates(a: Column, b: Column, antonyms: list[tuple[str, str]] | None = None) -> Column:
    return ~has_antonyms(a, b, antonyms) & ~is_sibling(a, b) & ~is_cousin(a, b) & (contains_run(a, b) | differs_by_one_word(a, b))


def fuzzy_titles(a: Column, b: Column, least: float = 0.6) -> Column:
    """Of two word arrays: equal, or so large a share of the smaller's words in common."""
    smaller = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return (a == b) | ((smaller > 0) & (F.size(F.array_intersect(a, b)) / smaller >= least))
