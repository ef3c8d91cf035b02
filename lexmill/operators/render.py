"""Markdown pages from concepts and facts: sections are ordered aggregates, pages one concatenation."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.predicates import all_sources_are_uuids, is_question, looks_like_uuid
from ..functions.text import compare_text, emphasize_once, let, page_title, strip, words
from .facts import citations, comparable_contents, concept_types, concepts_of, fallback_definitions, judged, promoted, semantic_class, sources_by_text, unique_contents
from .merge import stored
from .related import related_by_chunks, related_by_tokens, see_also

NO_DEFINITION = "No definition available."
CAPS = {"formula": 3, "interpretation": 4, "example": 3, "caution": 3, "detail": 6}


def acronyms(concepts: DataFrame) -> DataFrame:
    """lower, acronym: capitals of 2 to 6 signs among all labels' words."""
    clean = F.regexp_replace("w", "[^A-Za-z0-9]", "")
    rows = concepts.select(F.explode(words(F.col("concept"))).alias("w")).select(clean.alias("acronym"))
    return rows.filter(F.col("acronym").rlike("[A-Z]") & ~F.col("acronym").rlike("[a-z]") & F.length("acronym").between(2, 6)).select(F.lower("acronym").alias("lower"), "acronym").distinct()


def titles(concepts: DataFrame) -> DataFrame:
    """concept, title: display titles in which every known acronym has its capitals; labels meet only the
    acronyms among their own words."""
    own = concepts.select("concept").distinct()
    tokens = own.select("concept", F.explode(F.array_distinct(F.transform(words(F.col("concept")), F.lower))).alias("lower"))
    known = tokens.join(acronyms(own), "lower").groupBy("concept").agg(F.map_from_entries(F.collect_list(F.struct("lower", "acronym"))).alias("known"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return own.join(known, "concept", "left").select("concept", page_title(F.col("concept"), F.coalesce("known", none)).alias("title"))


def _listed_titles(pairs: DataFrame, titled: DataFrame, order: str | None, name: str) -> DataFrame:
    """concept, name: the titles of the others of pairs (concept, other), by a column or by themselves."""
    rows = pairs.join(titled.select(F.col("concept").alias("other"), "title"), "other")
    if order is None:
        return rows.groupBy("concept").agg(F.array_sort(F.collect_set("title")).alias(name))
    return rows.groupBy("concept").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "title"))), lambda x: x["title"]).alias(name))


def link_maps(concepts: DataFrame, titled: DataFrame | None = None) -> DataFrame:
    """match, title, alias: the display titles, and for acronyms the title of the first concept that shows them."""
    titled = titles(concepts) if titled is None else titled
    runs = F.regexp_extract_all("title", F.lit("([A-Z0-9]{2,})"), 1)
    none = F.array().cast("array<string>")
    cut = lambda r, k: F.when(F.length(r) >= k, F.transform(F.sequence(F.lit(1), F.length(r) - k + 1), lambda i: F.substring(r, i, k))).otherwise(none)
    # All that a title could hold of an acronym, so that both meet by equality.
    parts = F.array_distinct(F.flatten(F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(2), F.lit(6)), lambda k: cut(r, k))))))
    shown = titled.select("concept", "title", F.explode(parts).alias("acronym"))
    short = shown.join(acronyms(concepts), "acronym").groupBy("lower").agg(F.min_by("title", "concept").alias("title"))
    return short.select(F.col("lower").alias("match"), "title", F.lit(True).alias("alias")).union(titled.select(F.col("title").alias("match"), "title", F.lit(False).alias("alias")).distinct())


class WikiLinker:
    """Puts [[title]] at the first whole-word hit of each other title, longest first, aliases before titles."""

    def __init__(self, links: list[tuple[str, str, bool]]):
        order = sorted(links, key=lambda x: (not x[2], -len(x[0]), x[0]))
        self.links = [(m, re.compile(r"\b" + re.escape(m) + r"\b", re.IGNORECASE), t) for m, t, _ in order]
        self.by_word: dict[str, list[int]] = {}
        for k, (m, _, _) in enumerate(self.links):
            self.by_word.setdefault((re.findall(r"\w+", m.lower()) or [""])[0], []).append(k)

    def __call__(self, text: str, own: str) -> str:
        linked = {own}
        near = sorted({k for w in set(re.findall(r"\w+", text.lower())) | {""} for k in self.by_word.get(w, ())})
        for k in near:
            _, pattern, title = self.links[k]
            if title in linked:
                continue
            parts = re.split(r"(\[\[[^\]]*\]\])", text)
            for i in range(0, len(parts), 2):  # odd parts are links already
                parts[i], n = pattern.subn(lambda _, t=title: f"[[{t}]]", parts[i], count=1)
                if n:
                    text = "".join(parts)
                    linked.add(title)
                    break
        return text


def inject_links(rows: DataFrame, links: DataFrame, column: str = "intro", own: str = "title") -> DataFrame:
    """rows with links in a column.  The table of links is one row for each concept and goes to every task."""
    linker = rows.sparkSession.sparkContext.broadcast([tuple(r) for r in links.select("match", "title", "alias").toLocalIterator()])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        link = WikiLinker(linker.value)
        for f in frames:
            f[column] = [None if t is None else link(t, o) for t, o in zip(f[column], f[own], strict=True)]
            yield f

    return rows.mapInPandas(run, rows.schema)


def _section(title: str, items: Column, code: bool = False) -> Column:
    body = F.array_join(F.transform(items, lambda x: F.concat(F.lit("```\n"), x, F.lit("\n```\n")) if code else F.concat(F.lit("- "), x)), "\n")
    return F.when(F.size(items) > 0, F.concat(F.lit(f"\n---\n\n## {title}\n\n"), body, F.lit("" if code else "\n")))


def frontmatter(sources: Column) -> Column:
    """YAML with sorted tags of source names without ending, and the first one's part before "-" as folder."""

    def lines(tags: Column) -> Column:
        folder = F.regexp_extract(F.get(tags, F.lit(0)), "^([^-]*)", 1)
        rows = F.concat(F.array(F.lit("---"), F.lit("tags:")), F.transform(tags, lambda t: F.concat(F.lit("  - "), t)))
        return F.concat_ws("\n", rows, F.when(folder != "", F.concat(F.lit("folder: "), folder)), F.lit("---"))

    stems = F.transform(F.filter(sources, lambda s: s != ""), lambda s: F.regexp_replace(F.get(F.split(s, "::"), F.lit(0)), r"\.[^.]*$", ""))
    return let(F.array_sort(F.array_distinct(stems)), lambda tags: F.when(F.size(tags) > 0, lines(tags)))


def source_names(facts: DataFrame) -> DataFrame:
    """concept, sources: sorted names of sources that aren't UUIDs."""
    name = F.get(F.split("source_chunk_id", "::"), F.lit(0))
    rows = facts.filter(F.coalesce("source_chunk_id", F.lit("")) != "").select("concept", name.alias("s"))
    return rows.filter(~looks_like_uuid(F.col("s"))).groupBy("concept").agg(F.array_sort(F.collect_set("s")).alias("sources"))


def sections(facts: DataFrame, definitions: DataFrame) -> DataFrame:
    """concept and an array for each section of CAPS, in order of facts."""
    rows = promoted(facts, definitions, examples=True)
    rows = judged(rows, _kind=semantic_class())
    kind = F.col("_kind")
    rows = rows.withColumn("kind", F.when(kind.isin("formula", "interpretation", "example", "caution"), kind).otherwise("detail"))
    place = F.row_number().over(Window.partitionBy("concept", "kind").orderBy("fact_seq"))
    cap = F.element_at(F.create_map(*[F.lit(x) for p in CAPS.items() for x in p]), F.col("kind"))
    # The first filter's bound is one that Spark takes into the sorts before the shuffle.
    rows = rows.select("concept", "kind", "fact_seq", "content").withColumn("n", place).filter(F.col("n") <= max(CAPS.values())).filter(F.col("n") <= cap)
    item = F.struct("fact_seq", "content")
    return rows.groupBy("concept").agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))), lambda x: x["content"]).alias(k) for k in CAPS])


def wiki_pages(facts: DataFrame, antonyms=None) -> DataFrame:
    """title, concept, markdown for every concept with a definition or content."""
    facts = stored(facts.select("fact_seq", "concept", "content", "source_chunk_id"), "facts")
    own = stored(unique_contents(facts.withColumn("content", F.regexp_replace("content", r"(?i)^fact\s+\w+\.?:\s*", ""))), "contents")
    concepts = concepts_of(facts)
    definitions = stored(fallback_definitions(own), "definitions")
    none = F.array().cast("array<string>")
    titled = stored(titles(concepts), "titles")
    related = _listed_titles(related_by_chunks(facts, 5, 2, antonyms), titled, "rank", "related")
    also = _listed_titles(see_also(concepts, antonyms), titled, None, "titles")
    rows = concepts.select("concept").join(titled, "concept")
    for other in (definitions, sections(own, definitions), concept_types(own), related, also, source_names(facts)):
        rows = rows.join(other, "concept", "left")
    lists = {k: F.coalesce(k, none).alias(k) for k in (*CAPS, "related", "titles", "sources")}
    rows = rows.select("concept", "title", "definition", F.coalesce("type", F.lit("general")).alias("type"), *lists.values())
    content = F.col("definition").isNotNull() | (F.size("formula") + F.size("interpretation") + F.size("caution") + F.size("detail") > 0)
    rows = rows.filter(content).withColumn("definition", F.coalesce("definition", F.lit(NO_DEFINITION)))
    extra = F.get("interpretation", F.lit(0))
    intro = F.concat_ws(" ", emphasize_once(F.col("definition"), F.col("title")), F.concat(F.upper(F.left(extra, F.lit(1))), F.substring(extra, F.lit(2), F.lit(1 << 30))))
    rows = inject_links(rows.withColumn("intro", intro), link_maps(concepts, titled))
    detail, interpretation = F.col("detail"), F.col("interpretation")
    first = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    ratio = F.concat_ws("\n", _section("Formula", F.col("formula"), True), _section("What It Tells You", first(interpretation, detail)), F.when(F.size(interpretation) > 0, _section("Key Takeaways", F.array_except(detail, interpretation))))
    method = F.concat_ws("\n", _section("How It Works", first(detail, interpretation)), _section("Formula", F.col("formula"), True), _section("Key Takeaways", interpretation))
    general = _section("Key Takeaways", F.concat(detail, interpretation))
    body = F.when(F.col("type") == "ratio", ratio).when(F.col("type").isin("method", "system"), method).otherwise(general)
    link = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")
    page = F.concat_ws(
        "\n", frontmatter(F.col("sources")), F.concat(F.lit("# "), F.col("title"), F.lit("\n")), F.concat(F.col("intro"), F.lit("\n\n---\n")), F.col("definition"),
        F.when(body != "", body), _section("Worked Example", F.col("example")), _section("Cautions", F.col("caution")),
        F.concat(F.lit("\n---\n\n## Related Concepts\n"), F.when(F.size("related") > 0, link(F.col("related"))).otherwise("- None")),
        F.when(F.size("titles") > 0, F.concat(F.lit("\n---\n\n## See Also\n"), link(F.col("titles")))),
        F.when(F.size("sources") > 0, F.concat(F.lit("\n---\n\n## Sources\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("- "), s)), "\n"))),
    )
    return rows.select("title", "concept", page.alias("markdown"))


def standard_pages(facts: DataFrame, antonyms=None) -> DataFrame:
    """title, concept, markdown with lead, key points with footnotes, related concepts and sources."""
    from ..functions.text import lead

    facts = stored(facts.select("fact_seq", "concept", "content", "source_chunk_id"), "facts")
    concepts = concepts_of(facts)
    points = comparable_contents(promoted(facts.select("fact_seq", "concept", "content")))
    cited = stored(points.join(citations(facts).select("concept", "content", "note", "sources"), ["concept", "content"]), "cited")
    item = F.struct("fact_seq", F.concat(F.col("content"), F.lit(" [^"), F.col("note"), F.lit("]")).alias("t"), "content")
    lists = cited.groupBy("concept").agg(F.sort_array(F.collect_list(item)).alias("x"))
    # Notes are made distinct as rows: of an array of structs, Spark compares all pairs.
    used = cited.select("concept", "note", F.array_join("sources", ", ").alias("s")).distinct()
    used = used.groupBy("concept").agg(F.sort_array(F.collect_list(F.struct("note", "s"))).alias("used"))
    notes = F.array_join(F.transform("used", lambda x: F.concat(F.lit("[^"), x["note"], F.lit("]: chunk="), x["s"])), "\n")
    titled = stored(titles(concepts), "titles")
    related = _listed_titles(related_by_tokens(concepts, 4, antonyms), titled, "rank", "others").select("concept", F.transform("others", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))).alias("related"))
    rows = lists.join(used, "concept").join(fallback_definitions(facts), "concept", "left").join(related, "concept", "left").join(titled, "concept")
    page = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title"), F.lit("\n")), lead(F.col("definition"), F.col("x.content")), _section("Key Points", F.col("x.t")), F.concat(F.lit("## Related Concepts\n"), F.coalesce(F.array_join("related", "\n"), F.lit("- None"))), F.concat(F.lit("\n## Sources\n"), notes))
    return rows.select("title", "concept", page.alias("markdown"))


def enhanced_intro(title: Column, definition: Column, interpretations: Column, points: Column) -> Column:
    """Two sentences at most: the definition, or else the first point or interpretation, with the title in bold,
    and the first other item with a capital."""
    primary = F.coalesce(F.when(definition != NO_DEFINITION, definition), F.get(points, F.lit(0)), F.get(interpretations, F.lit(0)))

    def joined(p: Column) -> Column:
        other = F.get(F.filter(F.concat(interpretations, points), lambda x: compare_text(x) != compare_text(p)), F.lit(0))
        whole = F.concat_ws(" ", p, F.concat(F.upper(F.left(strip(other), F.lit(1))), F.substring(strip(other), F.lit(2), F.lit(1 << 30))))
        return F.array_join(F.slice(F.split(strip(whole), r"(?<=[.!?])\s+"), 1, 2), " ")

    alone = F.concat(F.lit("**"), title, F.lit("** is a concept in this source material."))
    return F.when(primary.isNull(), alone).otherwise(let(emphasize_once(strip(primary), title), joined))


ENHANCED_CAPS = {"formula": 3, "interpretation": 4, "example": 2, "caution": 3, "key_point": 4}


def enhanced_pages(facts: DataFrame, antonyms=None) -> DataFrame:
    """title, concept, markdown in semantic sections with footnotes; concepts with neither a definition nor an
    item are left out, and sources that are all UUIDs hidden.  Links go into the intro."""
    facts = stored(facts.select("fact_seq", "concept", "content", "source_chunk_id"), "facts")
    own = judged(unique_contents(facts.select("fact_seq", "concept", "content")), _marked=classify.has_template_markers(F.col("content"), F.col("_low")))
    own = stored(own.filter(~is_question(F.col("content")) & ~F.col("_marked")).select("fact_seq", "concept", "content"), "contents")
    concepts, titled = concepts_of(facts), stored(titles(concepts_of(facts)), "titles")
    definitions = stored(fallback_definitions(own), "definitions")
    x = F.col("content")
    rows = judged(own, kind=semantic_class(), _dull=classify.is_low_signal(x, F.col("_low"), F.col("_worked"))).filter(F.col("kind").isin(*ENHANCED_CAPS))
    plain = F.col("kind").isin("interpretation", "key_point")
    rows = rows.join(definitions.select("concept", compare_text(F.coalesce("definition", F.lit(NO_DEFINITION))).alias("_d")), "concept", "left")
    rows = rows.filter(~plain | (~F.col("_dull") & (compare_text(x) != F.coalesce("_d", F.lit("")))))
    place = F.row_number().over(Window.partitionBy("concept", "kind").orderBy("fact_seq"))
    cap = F.element_at(F.create_map(*[F.lit(v) for p in ENHANCED_CAPS.items() for v in p]), F.col("kind"))
    rows = rows.select("concept", "kind", "fact_seq", "content").withColumn("n", place).filter(F.col("n") <= max(ENHANCED_CAPS.values())).filter(F.col("n") <= cap).select("concept", "kind", "n", "content")
    shown = definitions.filter("definition IS NOT NULL").select("concept", F.lit("definition").alias("kind"), F.lit(1).alias("n"), F.col("definition").alias("content")).unionByName(rows)
    shown = stored(shown, "shown")
    # Sources are gathered for the contents that are shown only.
    named = facts.join(shown.select("concept", F.col("content").alias("_c")).distinct(), (F.col("_c") == strip(x)) & (shown["concept"] == facts["concept"]), "left_semi")
    # Notes are numbered in the order of the page: equal lists of sources share one.
    order = F.element_at(F.create_map(*[F.lit(v) for p in enumerate(("definition", *ENHANCED_CAPS)) for v in reversed(p)]), F.col("kind"))
    cited = shown.join(sources_by_text(named).select("concept", "content", "sources"), ["concept", "content"], "left").withColumn("at", F.struct(order.alias("o"), "n"))
    notes = cited.filter("sources IS NOT NULL").groupBy("concept", "sources").agg(F.min("at").alias("first"))
    notes = notes.withColumn("note", F.row_number().over(Window.partitionBy("concept").orderBy("first")))
    cited = cited.join(notes.drop("first"), ["concept", "sources"], "left")
    text = F.concat(F.col("content"), F.coalesce(F.concat(F.lit(" [^"), F.col("note"), F.lit("]")), F.lit("")))
    item = F.struct("n", text.alias("t"), "content")
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, item))).alias(k) for k in ENHANCED_CAPS]
    note = F.array_sort(F.collect_set(F.when(F.col("note").isNotNull(), F.struct("note", F.array_join("sources", ", ").alias("s")))))
    grouped = cited.groupBy("concept").agg(*lists, note.alias("notes"))
    related = _listed_titles(related_by_tokens(concepts, 4, antonyms), titled, "rank", "related")
    source = strip(F.coalesce("source_chunk_id", F.lit("")))
    hidden = facts.filter(strip(x) != "").groupBy("concept").agg(F.bool_and(all_sources_are_uuids(F.array(source))).alias("hidden"))
    out = titled
    for other, how in ((grouped, "inner"), (definitions, "left"), (related, "left"), (source_names(facts), "left"), (hidden, "left")):
        out = out.join(other, "concept", how)
    none = F.array().cast("array<string>")
    definition, hide = F.coalesce("definition", F.lit(NO_DEFINITION)), F.coalesce("hidden", F.lit(True))
    content = lambda k: F.transform(k, lambda x: x["content"])
    out = out.withColumn("intro", enhanced_intro(F.col("title"), definition, content("interpretation"), content("key_point")))
    out = inject_links(out, link_maps(concepts, titled))
    section = lambda head, k, code=False: _section(head, F.when(hide, content(k)).otherwise(F.transform(k, lambda x: x["t"])), code)
    notes_ = F.when(F.size("notes") > 0, F.array_join(F.transform("notes", lambda x: F.concat(F.lit("[^"), x["note"], F.lit("]: chunk="), x["s"])), "\n")).otherwise("- None")
    page = F.concat_ws(
        "\n", frontmatter(F.coalesce("sources", none)), F.concat(F.lit("# "), F.col("title"), F.lit("\n")), F.concat(F.col("intro"), F.lit("\n\n---\n")),
        section("Formula", "formula", True), section("Interpretation", "interpretation"), section("Example", "example"), section("Cautions", "caution"), section("Key Points", "key_point"),
        F.concat(F.lit("---\n\n## Related Concepts\n"), F.when(F.size(F.coalesce("related", none)) > 0, F.array_join(F.transform("related", lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n")).otherwise("- None")),
        F.when(~hide, F.concat(F.lit("\n---\n\n## Sources\n"), notes_)),
    )
    return out.select("title", "concept", page.alias("markdown"))


def redirects(near: DataFrame, concepts: DataFrame) -> DataFrame:
    """title, target, markdown: of each near-duplicate pair the label with fewer facts points to the other."""
    n = concepts.select("concept", "n_facts")
    rows = near.join(n.select(F.col("concept").alias("left"), F.col("n_facts").alias("nl")), "left").join(n.select(F.col("concept").alias("right"), F.col("n_facts").alias("nr")), "right").filter("nl <> nr")
    fewer = F.col("nl") < F.col("nr")
    titled = titles(concepts)
    rows = rows.select(F.when(fewer, F.col("left")).otherwise(F.col("right")).alias("a"), F.when(fewer, F.col("right")).otherwise(F.col("left")).alias("b"))
    rows = rows.join(titled.select(F.col("concept").alias("a"), "title"), "a").join(titled.select(F.col("concept").alias("b"), F.col("title").alias("target")), "b").groupBy("title").agg(F.max("target").alias("target"))
    stub = F.concat(F.lit("---\ngenerated_by_backend: redirect\ngenerated_by_model: none\n---\n\n# "), F.col("title"), F.lit("\n\n> This page redirects to [["), F.col("target"), F.lit("]].\n\n## Redirect\n[["), F.col("target"), F.lit("]]\n"))
    return rows.withColumn("markdown", stub)


def page_document(pages: DataFrame, limit: int = 0) -> DataFrame:
    """One row, document: all pages (or the first so many by title) under numbered headings."""
    rows = pages.orderBy("title").limit(limit) if limit else pages
    all_ = F.array_sort(F.collect_list(F.struct("title", "markdown")))
    return rows.agg(F.array_join(F.transform(all_, lambda p, i: F.concat(F.lit("--- PAGE "), i + 1, F.lit(": "), p["title"], F.lit(" ---\n"), p["markdown"])), "\n\n").alias("document"))


# ---- model answers about pages ----


def clean_answer(x: Column, title: Column) -> Column:
    """A model's page without its thoughts, citations of fact numbers and automatic sections, with a heading."""
    y = F.regexp_replace(x, r"(?s)<think>.*?</think>", "")
    y = F.regexp_replace(y, r"(?i)\s*\(facts?\s+\d+(?:\s*,\s*(?:facts?\s+)?\d+)*\)", "")
    y = F.regexp_replace(y, r"(?im)\bfact\s+\w+\.?:\s*", "")
    y = F.trim(F.regexp_replace(y, r"(?s)\n##\s+(?:Related Concepts|See Also|Sources)\b.*$", ""))
    return F.when(y.startswith("# "), y).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), y))


def attributed(markdown: Column, backend: Column, model: Column) -> Column:
    """A page with its backend and model in the frontmatter, which is made if there is none."""
    keys = F.concat(F.lit("generated_by_backend: "), backend, F.lit("\ngenerated_by_model: "), model, F.lit("\n"))
    own = F.concat(F.lit("---\n"), keys, F.substring(markdown, F.lit(5), F.lit(1 << 30)))
    return F.when(markdown.startswith("---\n"), own).otherwise(F.concat(F.lit("---\n"), keys, F.lit("---\n\n"), markdown))


def synthesis_prompts(facts: DataFrame, links: DataFrame, most: int = 25) -> DataFrame:
    """concept, prompt: up to `most` numbered facts and the related titles (concept, titles)."""
    place = F.row_number().over(Window.partitionBy("concept").orderBy("fact_seq"))
    rows = unique_contents(facts).withColumn("n", place).filter(F.col("n") <= most)
    items = rows.groupBy("concept").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "content"))), lambda x: F.concat(x["n"], F.lit(". "), x["content"])), "\n").alias("items"))
    hints = F.coalesce(F.array_join("titles", ", "), F.lit("none"))
    return items.join(links, "concept", "left").select("concept", F.concat(F.lit("Topic: "), F.col("concept"), F.lit("\nStatements:\n"), F.col("items"), F.lit("\nPages to link: "), hints).alias("prompt"))
