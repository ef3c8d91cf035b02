"""The facts relation: hygiene, filters, groups, and what is gathered from a concept's facts.

facts: fact_id, fact_seq, concept, content, source_chunk_id.  fact_seq gives every rule its order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.predicates import is_noise_fact, is_question, is_valid_concept
from ..functions.text import compare_text, concept_tokens, group_key, number_marked, strip
from .chunks import explode_sentences

VARIANTS = 4


def facts_from_sentences(docs: DataFrame, labels: DataFrame, least: int = 10) -> DataFrame:
    """Facts without a model: each sentence over so many characters, with one of the labels by its number.

    labels: label, in any order; four spellings alternate, so that normal forms and merges have work.
    """
    names = labels.select("label").distinct().groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list("label")).alias("names")).select("names")
    rows = explode_sentences(docs.select("doc_id", "source", "text"), least=least).crossJoin(F.broadcast(names))
    label = F.element_at("names", (F.pmod(F.col("doc_id") * 31 + F.col("sent_idx"), F.size("names")) + 1).cast("int"))
    kind = F.col("sent_idx") % VARIANTS
    spelled = F.when(kind == 0, label).when(kind == 1, F.upper(label)).when(kind == 2, F.concat(label, F.lit("s"))).otherwise(F.concat(F.lit("type of "), label))
    seq = F.col("doc_id") * F.lit(1 << 20) + F.col("sent_idx")
    source = F.concat_ws("::", "source", "doc_id")
    return rows.select(F.sha2(F.concat_ws("|", source, "sent_idx", "sentence"), 256).alias("fact_id"), seq.alias("fact_seq"), spelled.alias("concept"), F.col("sentence").alias("content"), source.alias("source_chunk_id"))


def judged(facts: DataFrame, **columns) -> DataFrame:
    """facts with _low, _worked and the given columns, which may look at those two, each worked out once a row: filters and
    aggregates above look at the columns, as no filter goes below a projection that isn't deterministic."""
    x = F.col("content")
    rows = facts.withColumn("_low", F.lower(x)).withColumn("_worked", classify.looks_like_worked_example(x, F.col("_low")))
    return rows.select("*", *[c.alias(n) for n, c in columns.items()], F.spark_partition_id().alias("_at")).filter("_at >= 0")


def _class() -> Column:
    return classify.classify_fact(F.col("content"), F.col("_low"), F.col("_worked"))


def semantic_class() -> Column:
    """The finer class, in a column of judged."""
    return classify.classify_semantic(F.col("content"), _class(), F.col("_low"))


def clean_facts(facts: DataFrame) -> DataFrame:
    return facts.filter(~is_noise_fact(F.col("content")))


def valid_facts(facts: DataFrame, whole_words: bool = False) -> DataFrame:
    """Facts of valid labels; each distinct label is judged once."""
    good = facts.select("concept").distinct().filter(is_valid_concept(F.col("concept"), whole_words))
    return facts.join(good, "concept", "left_semi").select(facts.columns)


def group_facts(facts: DataFrame) -> DataFrame:
    return facts.withColumn("concept", group_key(F.col("concept")))


def concepts_of(facts: DataFrame) -> DataFrame:
    """concept, concept_seq (of its first fact), n_facts."""
    return facts.groupBy("concept").agg(F.min("fact_seq").alias("concept_seq"), F.count("*").alias("n_facts"))


def with_least_facts(facts: DataFrame, least: int) -> DataFrame:
    """Only facts of concepts with so many."""
    if least <= 1:
        return facts
    return facts.join(concepts_of(facts).filter(F.col("n_facts") >= least).select("concept"), "concept", "left_semi").select(facts.columns)


def split_ready(facts: DataFrame, threshold: int = 6) -> tuple[DataFrame, DataFrame]:
    """(facts of concepts with so many, the others)."""
    ready = concepts_of(facts).filter(F.col("n_facts") >= threshold).select("concept")
    return facts.join(ready, "concept", "left_semi").select(facts.columns), facts.join(ready, "concept", "left_anti").select(facts.columns)


def without_examples(facts: DataFrame) -> DataFrame:
    """Drops example-like facts, and so the concepts that have nothing else."""
    x = F.col("content")
    return facts.filter((classify.classify_fact(x) != "example") & ~classify.is_low_signal(x) & ~classify.looks_like_worked_example(x))


def first_by(facts: DataFrame, key) -> DataFrame:
    """The first row of each concept and key."""
    keyed = facts.withColumn("_key", key)
    # The key comes first, as the sorts look at the first eight bytes of the first column before anything else.
    firsts = keyed.groupBy("_key", "concept").agg(F.min_by(F.struct(*facts.columns), "fact_seq").alias("f"))
    return firsts.select("f.*")


def unique_contents(facts: DataFrame) -> DataFrame:
    """Each concept's contents, trimmed and not blank, once for each lower-case form; the first stays."""
    trimmed = facts.withColumn("content", strip(F.col("content"))).filter(F.col("content") != "")
    return first_by(trimmed, F.lower("content"))


def comparable_contents(facts: DataFrame, limit: int = 0) -> DataFrame:
    """Once for each comparison form; with a limit the first so many of each concept."""
    out = first_by(facts.filter(compare_text(F.col("content")) != ""), compare_text(F.col("content")))
    if limit > 0:
        out = out.withColumn("_n", F.row_number().over(Window.partitionBy("concept").orderBy("fact_seq"))).filter(F.col("_n") <= limit).drop("_n")
    return out


def unique_counts(facts: DataFrame) -> DataFrame:
    """concept, contents, comparable: how many rows unique_contents and comparable_contents have, 0 for none, in one pass."""
    text = strip(F.col("content"))
    keys = F.array(F.struct(F.lit(0).alias("kind"), F.lower(text).alias("key")), F.struct(F.lit(1).alias("kind"), compare_text(F.col("content")).alias("key")))
    rows = facts.select(F.inline(keys), "concept").groupBy("key", "kind", "concept").agg(F.count("*").alias("n"))
    counted = lambda kind: F.count_if((F.col("kind") == kind) & (F.col("key") != ""))
    return rows.groupBy("concept").agg(counted(0).alias("contents"), counted(1).alias("comparable"))


def sources_by_text(facts: DataFrame) -> DataFrame:
    """concept, content, sources: distinct, in order of their first fact; a blank source is "unknown"."""
    named = facts.withColumn("content", strip(F.col("content"))).filter(F.col("content") != "")
    source = strip(F.coalesce("source_chunk_id", F.lit("")))
    named = named.withColumn("source", F.when(F.coalesce("source_chunk_id", F.lit("")) == "", "unknown").otherwise(source))
    first = named.groupBy("concept", "content", "source").agg(F.min("fact_seq").alias("seq"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "source")))
    return first.groupBy("concept", "content").agg(ordered.alias("x"), F.min("seq").alias("seq")).select("concept", "content", "seq", F.col("x.source").alias("sources"))


def citations(facts: DataFrame) -> DataFrame:
    """sources_by_text with note: equal lists of sources share a number, in order of first use in a concept."""
    rows = sources_by_text(facts)
    notes = rows.groupBy("concept", "sources").agg(F.min("seq").alias("first"))
    notes = notes.withColumn("note", F.row_number().over(Window.partitionBy("concept").orderBy("first")).cast("long"))
    return rows.join(notes.drop("first"), ["concept", "sources"])


def promoted(facts: DataFrame, definitions: DataFrame | None = None, examples: bool = False, per_template: int = 2) -> DataFrame:
    """Facts fit for a page's body: no templates, questions, instructions or low signals, not the definition
    (concept, definition), once for each comparison form and at most so often for each sentence template."""
    x, low = F.col("content"), F.col("_low")
    rows = judged(facts, _base=_class(), _dull=classify.is_low_signal(x, low, F.col("_worked")))
    fine = F.when(F.col("_base") == "example", F.lit(examples)).otherwise(~F.col("_dull"))
    rows = rows.filter(~is_question(x) & (F.col("_base") != "instruction") & fine)
    if examples:  # elsewhere low signals have all templates
        rows = rows.filter(~classify.has_template_markers(x, low))
    rows = judged(rows.select(*facts.columns), _k=compare_text(x)).select(*facts.columns, "_k")
    if definitions is not None:
        rows = rows.join(definitions.select("concept", compare_text(F.coalesce("definition", F.lit(""))).alias("_d")), "concept", "left").filter(F.coalesce("_d", F.lit("")) != F.col("_k")).drop("_d")
    once = first_by(rows, F.col("_k")).withColumn("_t", number_marked(F.col("_k")))
    place = F.row_number().over(Window.partitionBy("concept", "_t").orderBy("fact_seq"))
    return once.withColumn("_n", place).filter(F.col("_n") <= per_template).select(facts.columns)


def best_definitions(facts: DataFrame) -> DataFrame:
    """concept, definition, score: the best scored fact that is no template or example; ties go to the
    first; none under -2."""
    x, low = F.col("content"), F.col("_low")
    rows = judged(facts.select("concept", "content", "fact_seq"), _ok=~classify.has_template_markers(x, low) & (_class() != "example")).filter("_ok")
    scored = rows.select("concept", "content", "fact_seq", classify.definition_score(F.col("concept"), x, low).alias("score"))
    best = scored.groupBy("concept").agg(F.max_by(F.struct("content", "score"), F.struct("score", -F.col("fact_seq"))).alias("b"))
    return best.filter(F.col("b.score") >= -2).select("concept", F.col("b.content").alias("definition"), F.col("b.score").alias("score"))


def fallback_definitions(facts: DataFrame) -> DataFrame:
    """concept, definition: best of the definitions, else of the key points, else of both by base class,
    else the first key point."""
    x, low = F.col("content"), F.col("_low")
    rows = judged(facts.select("concept", "content", "fact_seq"), _base=_class())
    score = F.struct(classify.definition_score(F.col("concept"), x, low).alias("score"), (-F.col("fact_seq")).alias("seq"))
    ok = ~classify.has_template_markers(x, low) & (F.col("_base") != "example")
    rows = rows.select("concept", "content", "fact_seq", "_base", classify.classify_semantic(x, F.col("_base"), low).alias("_class"), score.alias("_s"), ok.alias("_ok"))
    picked = {}
    for name, test in (("d", F.col("_class") == "definition"), ("k", F.col("_class") == "key_point"), ("b", F.col("_base").isin("definition", "key_point"))):
        mine = test & F.col("_ok") & (F.col("_s.score") >= -2)
        picked[name] = F.max_by(F.when(mine, x), F.when(mine, F.col("_s")))
    first = F.min_by(F.when(F.col("_class") == "key_point", strip(x)), F.when(F.col("_class") == "key_point", F.col("fact_seq")))
    agg = rows.groupBy("concept").agg(*[c.alias(n) for n, c in picked.items()], first.alias("f"))
    return agg.select("concept", F.coalesce("d", "k", "b", F.when(F.col("f") != "", F.col("f"))).alias("definition"))


def concept_types(facts: DataFrame) -> DataFrame:
    """concept, type; the signals are looked for fact by fact, as no signal crosses a fact."""
    from ..functions import vocab
    from ..functions.text import contains_any

    low, tests = F.lower("content"), []
    for _, signals in vocab.TYPE_SIGNALS:
        tests += [contains_any(low, terms) for _, terms in signals]
    tests.append(low.rlike(r"\S\s*[=/÷]\s*\S"))
    agg = facts.groupBy("concept").agg(*[F.coalesce(F.bool_or(t), F.lit(False)).alias(f"t{i}") for i, t in enumerate(tests)])
    out, i = None, 0
    for name, signals in vocab.TYPE_SIGNALS:
        total = F.lit(0)
        for points, _ in signals:
            total, i = total + F.when(F.col(f"t{i}"), points).otherwise(0), i + 1
        if name == "ratio":
            total = total + F.when(F.col(f"t{len(tests) - 1}"), 2).otherwise(0)
        out = F.when(total >= 2, name) if out is None else out.when(total >= 2, name)
    tokens = F.regexp_extract_all(F.lower("concept"), F.lit("([a-z]+)"), 1)
    has = lambda terms: F.arrays_overlap(tokens, F.array(*[F.lit(t) for t in terms]))
    return agg.select("concept", F.when(has(vocab.RATIO_WORDS), "ratio").when(has(vocab.METHOD_WORDS), "method").when(has(vocab.SYSTEM_WORDS), "system").otherwise(F.coalesce(out, F.lit("general"))).alias("type"))


def chunk_sets(facts: DataFrame) -> DataFrame:
    return facts.filter(F.coalesce("source_chunk_id", F.lit("")) != "").select("concept", "source_chunk_id").distinct()


def token_rows(concepts: DataFrame) -> DataFrame:
    return concepts.select("concept", F.explode(concept_tokens(F.col("concept"))).alias("token"))
