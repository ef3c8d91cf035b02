"""Evaluation of concepts and quality of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab
from ..functions.text import key_terms, match_tokens
from .related import near_duplicate_pairs

# Fixed values of the quality report.
TERM_STOPWORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "is", "are", "was", "were", "be",
    "been", "by", "this", "that", "it", "as", "from", "with", "have", "has", "can", "will", "may",
]
CONTRADICTIONS = [("increases", "decreases"), ("higher", "lower"), ("positive", "negative"), ("always", "never"), ("required", "optional")]
VAGUE_SOURCES = "some research|many studies|experts agree"
FIGURES = r"(\d{4}|\d+%)"


def is_suspicious(concept: Column) -> Column:
    """A filler word among the tokens, or a single one that still ends in s."""
    m = match_tokens(concept)
    only = F.get(m, F.lit(0))
    return F.arrays_overlap(m, F.array(*[F.lit(w) for w in vocab.SUSPICIOUS_WORDS])) | ((F.size(m) == 1) & F.coalesce(only.endswith("s") & (F.length(only) > 3), F.lit(False)))


def evaluate(concepts: DataFrame, antonyms=None) -> DataFrame:
    """One row: total_concepts, avg_facts, singleton_ratio, suspicious (sorted), near_duplicates (sorted)."""
    own = concepts.agg(
        F.count("*").alias("total_concepts"),
        F.coalesce(F.avg("n_facts"), F.lit(0.0)).alias("avg_facts"),
        F.coalesce(F.avg((F.col("n_facts") == 1).cast("int")), F.lit(0.0)).alias("singleton_ratio"),
        F.array_sort(F.collect_list(F.when(is_suspicious(F.col("concept")), F.col("concept")))).alias("suspicious"),
    )
    near = near_duplicate_pairs(concepts, antonyms).agg(F.array_sort(F.collect_list(F.struct("left", "right"))).alias("near_duplicates"))
    return own.crossJoin(near)


def regressions(now: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """check, failed: singletons at 80 % or more; no fewer suspicious ones; total under 70 % of before."""
    x = now.select("total_concepts", "singleton_ratio", F.size("suspicious").alias("n"))
    if before is None:
        checks = x.select(F.array(F.struct(F.lit("singletons").alias("check"), (F.col("singleton_ratio") >= 0.8).alias("failed"))).alias("c"))
    else:
        y = before.select(F.col("total_concepts").alias("total_before"), F.size("suspicious").alias("n_before"))
        tests = [("singletons", F.col("singleton_ratio") >= 0.8), ("suspicious", (F.col("n_before") > 0) & (F.col("n") >= F.col("n_before"))), ("total", F.col("total_concepts") < 0.7 * F.col("total_before"))]
        checks = x.crossJoin(y).select(F.array(*[F.struct(F.lit(n).alias("check"), t.alias("failed")) for n, t in tests]).alias("c"))
    return checks.select(F.explode("c").alias("c")).select("c.*")


def structure_metrics(x: Column) -> Column:
    """struct of counts in a Markdown page."""
    count = lambda p: F.regexp_count(x, F.lit(p)).cast("long")
    lines, sections, n_words = F.size(F.split(x, "\n")).cast("long"), count(r"(?m)^##\s+"), F.size(F.regexp_extract_all(x, F.lit(r"(\S+)"), 1)).cast("long")
    listed = count(r"(?m)^\s*[-*]\s+")
    return F.struct(
        sections.alias("sections"), count(r"\[\[.+?\]\]").alias("links"), F.floor(count("```") / 2).cast("long").alias("code_blocks"), listed.alias("list_lines"),
        F.round(listed / lines, 6).alias("list_ratio"), F.length(x).cast("long").alias("chars"), n_words.alias("words"), F.round(n_words / F.greatest(sections, F.lit(1)), 6).alias("words_per_section"),
    )


def coverage(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """concept, coverage: share of a concept's facts of whose key terms half or more are in its page (concept, markdown)."""
    page_terms = pages.select("concept", key_terms(F.col("markdown"), TERM_STOPWORDS).alias("w"))
    rows = facts.select("concept", key_terms(F.col("content"), TERM_STOPWORDS).alias("t")).join(page_terms, "concept")
    covered = (F.size("t") > 0) & (F.size(F.array_intersect("w", "t")) >= 0.5 * F.size("t"))
    return rows.groupBy("concept").agg(F.avg(covered.cast("double")).alias("coverage"))


def hallucination_risk(markdown: Column, facts: Column, covered: Column) -> Column:
    """LOW, MEDIUM or HIGH by coverage and red flags; facts is the joined text of the page's facts."""
    known = F.lower(facts)
    return risk_by_evidence(markdown, {w: known.contains(w) for p in CONTRADICTIONS for w in p}, F.regexp_count(known, F.lit(FIGURES)), covered)


def evidence(facts: DataFrame) -> DataFrame:
    """concept, a column for each word of CONTRADICTIONS that says whether a fact has it, and the number of figures:
    what hallucination_risk takes from the joined facts, as neither a word nor a figure goes over a blank."""
    low = F.lower("content")
    return facts.groupBy("concept").agg(*[F.coalesce(F.bool_or(low.contains(w)), F.lit(False)).alias(w) for p in CONTRADICTIONS for w in p], F.coalesce(F.sum(F.regexp_count(low, F.lit(FIGURES))), F.lit(0)).alias("figures"))


def risk_by_evidence(markdown: Column, has: dict[str, Column], n_figures: Column, covered: Column) -> Column:
    """hallucination_risk where the words and the number of figures of the facts are known."""
    page = F.lower(markdown)
    flags = F.lit(0)
    for x, y in CONTRADICTIONS:
        for a, b in ((x, y), (y, x)):
            flags = flags + (has[a] & page.contains(b) & ~has[b]).cast("int")
    flags = flags + (page.rlike(VAGUE_SOURCES) & (covered < 0.7)).cast("int")
    flags = flags + ((covered < 0.6) & (F.regexp_count(markdown, F.lit(FIGURES)) > 2 * n_figures)).cast("int")
    base = F.when(covered > 0.8, "LOW").when(covered > 0.6, "MEDIUM").otherwise("HIGH")
    return F.when((flags >= 2) | ((flags >= 1) & (base == "HIGH")), "HIGH").when(flags >= 1, "MEDIUM").otherwise(base)


def backend_report(pages: DataFrame) -> DataFrame:
    """backend, pages, and the means of coverage and structure (pages: backend, markdown, coverage, risk)."""
    m = pages.withColumn("m", structure_metrics(F.col("markdown")))
    risk = [F.count_if(F.col("risk") == r).alias(f"risk_{r.lower()}") for r in ("LOW", "MEDIUM", "HIGH")]
    return m.groupBy("backend").agg(F.count("*").alias("pages"), F.avg("coverage").alias("coverage"), F.avg("m.sections").alias("sections"), F.avg("m.links").alias("links"), F.avg("m.words").alias("words"), *risk)


#: (measure, how far apart, as a difference or a factor, what the larger one is called): fixed values of the report.
THRESHOLDS = [("coverage", 0.02, "difference", "better"), ("low_risk", 0.1, "difference", "better"), ("chars", 1.2, "factor", "longer"), ("sections", 1.0, "difference", "more detailed"), ("links", 1.1, "factor", "more connected"), ("code_blocks", 0.0, "difference", "more technical")]


def compared_backends(pages: DataFrame, first: str, second: str) -> DataFrame:
    """measure, first, second, verdict: means of two backends' pages (backend, markdown, coverage, risk), one
    of which is better, or both comparable, by THRESHOLDS."""
    m = pages.filter(F.col("backend").isin(first, second)).withColumn("m", structure_metrics(F.col("markdown")))
    values = {"coverage": F.col("coverage"), "low_risk": (F.col("risk") == "LOW").cast("double"), **{c: F.col(f"m.{c}").cast("double") for c in ("chars", "sections", "links", "code_blocks")}}
    long = m.select("backend", F.explode(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])).alias("measure", "value"))
    wide = long.groupBy("measure").pivot("backend", [first, second]).agg(F.avg("value"))
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    out = F.lit("comparable")
    for name, by, kind, word in THRESHOLDS:
        over = lambda x, y, by=by, kind=kind: x > y * by if kind == "factor" else x - y > by
        own = F.when(over(a, b), F.lit(f"{first} {word}")).when(over(b, a), F.lit(f"{second} {word}")).otherwise("comparable")
        out = F.when(F.col("measure") == name, own).otherwise(out)
    return wide.select("measure", a.alias("first"), b.alias("second"), out.alias("verdict"))


def group_report(concepts: DataFrame) -> DataFrame:
    """concept, n_facts, most facts first."""
    return concepts.select("concept", "n_facts").orderBy(F.desc("n_facts"), "concept")
