"""Classes of facts, definition scores and concept types, as CASE expressions.

low is lower(x) and worked looks_like_worked_example(x), where they are columns at hand: a filter or an aggregate
works an expression out anew for each term that looks at it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .predicates import any_pattern
from .text import contains_any, numeric_density, strip

UNBOUNDED = 1 << 30


def has_template_markers(x: Column, low: Column | None = None) -> Column:
    low = F.lower(x) if low is None else low
    return contains_any(low, vocab.TEMPLATE_LITERALS) & any_pattern(x, vocab.TEMPLATE_PATTERNS)


def looks_like_worked_example(x: Column, low: Column | None = None) -> Column:
    low = F.lower(x) if low is None else low
    years = F.array_distinct(F.regexp_extract_all(low, F.lit(r"\b(year\s*\d+)\b"), 1))
    study = x.contains("%") & x.contains("'s") & low.rlike(r"\b19\d{2}\b|\b20\d{2}\b") & low.rlike(r"\b\d+(?:\.\d+)?\s*%") & x.rlike(r"\b[A-Z][a-zA-Z]+'s\b")
    numeric = (
        contains_any(low, vocab.EXAMPLE_NUMERIC)
        | study
        | (low.contains("year") & (F.size(years) >= 2))
        | (contains_any(low, vocab.EXAMPLE_DENSE) & (numeric_density(x) >= 0.18))
    )
    # All but the first test need a digit.
    return contains_any(low, vocab.EXAMPLE_STRONG) | (x.rlike("[0-9]") & numeric)


def looks_like_formula(x: Column, low: Column | None = None) -> Column:
    low = F.lower(x) if low is None else low
    numbers = F.regexp_count(x, F.lit(r"\b\d+(?:[.,]\d+)?\b"))
    return (
        (x.contains("=") & x.rlike(r"\S\s*=\s*\S"))
        | contains_any(low, vocab.FORMULA_WORDS)
        | (low.contains("ratio") & contains_any(low, vocab.COMPUTE_CUES))
        | (x.rlike(r"[+\-/*=÷×]") & (numbers >= 2))
    )


def is_low_signal(x: Column, low: Column | None = None, worked: Column | None = None) -> Column:
    low = F.lower(x) if low is None else low
    return (
        (strip(x) == "")
        | contains_any(low, vocab.NOISE_MARKERS)
        | contains_any(low, vocab.INSTRUCTION_MARKERS)
        | (looks_like_worked_example(x, low) if worked is None else worked)
        | (numeric_density(x) >= 0.22)
        | ~x.rlike(r"^\s*+(?:\S++\s++){5}\S")
        | has_template_markers(x, low)
    )


def classify_fact(x: Column, low: Column | None = None, worked: Column | None = None) -> Column:
    """definition, key_point, example or instruction."""
    text = strip(x)
    low = F.lower(text) if low is None else strip(low)
    numbers = F.regexp_count(low, F.lit(r"\b\d+(?:[.,]\d+)?\b"))
    tokens = F.greatest(F.regexp_count(low, F.lit("[a-z0-9]+")), F.lit(1))
    many = x.rlike("[0-9]") & (numbers / tokens >= 0.25)
    start = r"^(" + "|".join(vocab.INSTRUCTION_STARTS) + r")\b"
    return (
        F.when(low == "", "key_point")
        .when(low.startswith("there") & low.rlike(r"^there\s+(is|are)\b"), "example")
        .when(looks_like_worked_example(text, low) if worked is None else worked, "example")
        .when(contains_any(low, vocab.INSTRUCTION_PHRASES) | low.rlike(start), "instruction")
        .when(contains_any(low, vocab.EXAMPLE_MARKERS) | many, "example")
        .when(contains_any(low, vocab.DEFINITION_MARKERS), "definition")
        .otherwise("key_point")
    )


def classify_semantic(x: Column, base: Column | None = None, low: Column | None = None) -> Column:
    """The finer class; base is classify_fact(x) where it is at hand."""
    low = F.lower(x) if low is None else low
    base = classify_fact(x, low) if base is None else base
    return (
        F.when(base == "instruction", "instruction")
        .when(looks_like_formula(x, low), "formula")
        .when(contains_any(low, vocab.CAUTION_MARKERS), "caution")
        .when(contains_any(low, vocab.INTERPRETATION_MARKERS), "interpretation")
        .otherwise(base)
    )


def definition_score(concept: Column, x: Column, low: Column | None = None) -> Column:
    """How well a fact would define a concept."""
    c, low = strip(F.lower(concept)), strip(F.lower(x) if low is None else low)
    tokens = F.filter(F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), 1), lambda t: ~t.isin(vocab.TOKEN_STOPWORDS) & (F.length(t) > 1))
    points = lambda test, n: F.when(F.coalesce(test, F.lit(False)), n).otherwise(0)
    starts = reduce(lambda a, b: a | b, [low.startswith(F.concat(F.lit(article), c, F.lit(verb))) for article in ("", "the ") for verb in (" is ", " refers to ")])
    first8 = F.array_join(F.slice(F.filter(F.split(low, r"\s+", 10), lambda w: w != ""), 1, 8), " ")
    named = F.array_contains(tokens, F.regexp_extract(low, r"^(?:a|an|the)\s+(\w+)", 1))
    score = (
        points(low.contains(c) & starts, 3)
        + points(contains_any(low, vocab.DEFINITION_TERMS), 2)
        + points(low.rlike(r"^(a|an|the)\s+[a-z]"), 1)
        + points(low.contains(F.split_part(c, F.lit(" "), F.lit(1))) & first8.contains(c), 2)
        + points(named, 1)
        + points(low.contains(c) | F.exists(tokens, lambda t: low.contains(t)), 1)
        - points(x.rlike(r"[\d$%]") & ~contains_any(low, vocab.STATISTIC_TERMS), 2)
        - points(contains_any(low, vocab.TASK_TERMS), 2)
        - points(x.rlike(r"^\s*+(?:\S++\s++){55}\S"), 1)
        - points(contains_any(low, vocab.VAGUE_TERMS), 3)
        - points(low.startswith("there are"), 3)
        - points(contains_any(low, vocab.COMPARATIVE_LITERALS) & any_pattern(low, vocab.COMPARATIVES, any_case=False), 3)
    )
    return score.cast("int")


def type_from_facts(bag: Column) -> Column:
    """ratio, system or method by the joined texts of a concept's facts; null if none has two points."""
    low, out = F.lower(bag), None
    for name, signals in vocab.TYPE_SIGNALS:
        total = sum((F.when(contains_any(low, terms), n).otherwise(0) for n, terms in signals), F.lit(0))
        if name == "ratio":
            total = total + F.when(low.rlike(r"\S\s*[=/÷]\s*\S"), 2).otherwise(0)
        out = F.when(total >= 2, name) if out is None else out.when(total >= 2, name)
    return out


def concept_type(concept: Column, bag: Column) -> Column:
    tokens = F.regexp_extract_all(strip(F.lower(concept)), F.lit("([a-z]+)"), 1)
    has = lambda terms: F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))
    return F.when(has(vocab.RATIO_WORDS), "ratio").when(has(vocab.METHOD_WORDS), "method").when(has(vocab.SYSTEM_WORDS), "system").otherwise(F.coalesce(type_from_facts(bag), F.lit("general")))
