"""Steps that ask a model after the facts are there; each keeps what it had where an answer fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions.text import page_title, words
from ..operators import render
from ..operators.facts import concepts_of
from ..operators.merge import stored
from ..operators.related import related_by_chunks
from . import models


def _listed(rows: DataFrame, column: str, size: int, head: str) -> DataFrame:
    """batch_id, prompt: the column's values as JSON lists of about so many, dealt by hash."""
    n = F.greatest(F.ceil(F.lit(rows.count()) / size), F.lit(1)).cast("long")
    dealt = rows.select(F.pmod(F.xxhash64(column), n).alias("batch_id"), column)
    return dealt.groupBy("batch_id").agg(F.concat(F.lit(head + "\n"), F.to_json(F.array_sort(F.collect_list(column)))).alias("prompt"))


def _object_rows(answered: DataFrame, key: str, value: str) -> DataFrame:
    entries = F.map_entries(F.from_json(jsons.parse_object(jsons.strip_fences(F.col("answer"))), "map<string,string>"))
    return answered.select(F.explode(entries).alias("e")).select(F.col("e.key").alias(key), F.trim("e.value").alias(value))


def canonical_names(labels: DataFrame, cache: DataFrame, model: models.Model, size: int = 40) -> DataFrame:
    """name, canonical for labels (concept): cached ones, and answers for the others; a failed batch gives no rows."""
    missing = labels.select(F.col("concept").alias("name")).distinct().join(cache, "name", "left_anti")
    asked = models.answers(_listed(missing, "name", size, "Map each name to its canonical form, or null, as a JSON object."), model)
    found = _object_rows(asked, "name", "canonical").join(missing, "name", "left_semi")
    return stored(found.unionByName(cache.join(labels.select(F.col("concept").alias("name")), "name", "left_semi")), "canonical")


def consolidation_proposals(labels: DataFrame, model: models.Model, size: int = 200) -> DataFrame:
    """source, target that the model would merge; operators.merge.consolidate applies those that are safe."""
    asked = models.answers(_listed(labels.select("concept").distinct(), "concept", size, "Name duplicates as a JSON object from source to target."), model)
    return stored(_object_rows(asked, "source", "target"), "proposals")


def enrich_thin(facts: DataFrame, model: models.Model, least: int = 6) -> DataFrame:
    """facts with statements that the model adds to concepts under `least`, up to least - n + 1 each, without a source."""
    own = F.transform(F.array_sort(F.collect_list(F.struct("fact_seq", "content"))), lambda x: x["content"])
    thin = facts.groupBy("concept").agg(F.count("*").alias("n"), F.max("fact_seq").alias("last"), own.alias("own")).filter(F.col("n") < least)
    wanted = least - F.col("n") + 1
    prompts = thin.select(F.abs(F.xxhash64("concept")).alias("batch_id"), "concept", "last", wanted.alias("wanted"), F.concat(F.lit("Add "), wanted, F.lit(" statements about "), F.col("concept"), F.lit(" as a JSON list of strings.\nKnown:\n"), F.array_join("own", "\n")).alias("prompt"))
    items = F.from_json(jsons.parse_array(F.col("answer")), "array<string>")
    new = models.answers(prompts, model).select("concept", "last", "wanted", F.posexplode(items).alias("k", "content")).filter("k < wanted AND trim(content) <> ''")
    rows = new.select(F.sha2(F.concat_ws("|", F.lit("enriched"), "concept", "k", "content"), 256).alias("fact_id"), (F.col("last") + 1 + F.col("k")).alias("fact_seq"), "concept", F.trim("content").alias("content"), F.lit("").alias("source_chunk_id"))
    return facts.unionByName(stored(rows, "enriched"))


def synthesized(pages: DataFrame, facts: DataFrame, model: models.Model, model_name: str = "", most: int = 25) -> DataFrame:
    """pages (title, concept, markdown) written by the model from up to `most` facts each; a failed one stays
    as it was, stamped with the reason."""
    related = render._listed_titles(related_by_chunks(facts, 5), render.titles(concepts_of(facts)), "rank", "titles")
    prompts = render.synthesis_prompts(facts, related, most).withColumn("batch_id", F.abs(F.xxhash64("concept")))
    asked = stored(models.answers(prompts, model), "synthesis").select("concept", "answer", "error")
    rows = pages.join(asked, "concept", "left")
    fine = F.coalesce(F.length(F.trim("answer")) > 0, F.lit(False))
    front = F.regexp_extract("markdown", r"(?s)^(---\n.*?\n---\n)", 1)
    tail = F.regexp_extract("markdown", r"(?s)(\n(?:---\n\n)?## Related Concepts\b.*)$", 1)
    written = F.concat(front, render.clean_answer(F.col("answer"), F.col("title")), F.lit("\n"), tail)
    page = F.when(fine, render.attributed(written, F.lit(model.name), F.lit(model_name))).otherwise(fallback(F.col("markdown"), F.coalesce("error", F.lit("empty answer"))))
    return rows.select("title", "concept", page.alias("markdown"))


def fallback(markdown: Column, reason: Column) -> Column:
    """A page with the reason in its frontmatter."""
    line = F.concat(F.lit("fallback_reason: "), F.regexp_replace(reason, r"\s+", " "), F.lit("\n"))
    return F.when(markdown.startswith("---\n"), F.concat(F.lit("---\n"), line, F.substring(markdown, F.lit(5), F.lit(1 << 30)))).otherwise(F.concat(F.lit("---\n"), line, F.lit("---\n\n"), markdown))


def resynthesized(vault: DataFrame, model: models.Model, model_name: str = "") -> DataFrame:
    """title, concept, markdown: pages of a vault written anew from the facts that they hold."""
    from ..sources.readers import page_facts

    found = page_facts(vault)
    facts = found.select(F.sha2(F.concat_ws("|", "title", "position"), 256).alias("fact_id"), F.col("position").cast("long").alias("fact_seq"), F.col("title").alias("concept"), "content", F.lit("").alias("source_chunk_id"))
    return synthesized(vault.select("title", F.col("title").alias("concept"), "markdown"), facts, model, model_name)


def facts_in_one_pass(chunks: DataFrame, model: models.Model) -> DataFrame:
    """facts of chunks (chunk_id, batch_id, source, ...) where one answer gives concepts and contents together."""
    asked = models.answers(models.prompt_of_chunks(chunks), model)
    items = F.from_json(jsons.parse_array(F.col("answer")), "array<struct<concept:string,content:string,source_chunk_id:string>>")
    rows = asked.select("batch_id", F.posexplode(items).alias("k", "i")).select("batch_id", "k", F.trim("i.concept").alias("concept"), F.trim("i.content").alias("content"), F.col("i.source_chunk_id").alias("chunk_id"))
    known = rows.filter("concept <> '' AND content <> ''").join(chunks.select("chunk_id", "batch_id", "source"), ["chunk_id", "batch_id"])
    seq = F.abs(F.xxhash64("source", "chunk_id")) % (1 << 42) * F.lit(1 << 20) + F.col("k")
    return stored(known.select(F.sha2(F.concat_ws("|", "chunk_id", "k", "content"), 256).alias("fact_id"), seq.alias("fact_seq"), "concept", "content", F.concat_ws("::", "source", "chunk_id").alias("source_chunk_id")), "facts")


def matched_pages(pages: DataFrame, facts: DataFrame, least: float = 0.6) -> DataFrame:
    """title, concept: for each page the concept whose words match its title best, by shared words only."""
    title = pages.select("title", F.array_distinct(words(F.lower("title"))).alias("tw"))
    concept = concepts_of(facts).select("concept", F.array_distinct(words(F.lower(page_title(F.col("concept"))))).alias("cw"))
    hits = title.select("*", F.explode("tw").alias("w")).join(concept.select("*", F.explode("cw").alias("w")), "w").groupBy("title", "concept").agg(F.count("*").alias("n"), F.first(F.size("tw")).alias("a"), F.first(F.size("cw")).alias("b"))
    share = F.col("n") / F.least("a", "b")
    return hits.filter(share >= least).groupBy("title").agg(F.max_by("concept", F.struct(share, F.col("n"), F.col("concept"))).alias("concept"))
