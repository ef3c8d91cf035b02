"""DuckDB expressions of the scalar functions, for the oracle SQL."""

from __future__ import annotations

from ..functions import vocab


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items: list[str]) -> str:
    return "(" + ", ".join(map(text, items)) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(t)})" for t in terms) + ")"


def matches(x: str, patterns: list[str], any_case: bool = True) -> str:
    flag = ", 'i'" if any_case else ""
    return "(" + " OR ".join(f"regexp_matches({x}, {text(p)}{flag})" for p in patterns) + ")"


SENTENCES = r"""
sent AS (
  SELECT doc_id, source, unnest(s) AS sentence, unnest(range(len(s))) AS sent_idx
  FROM (SELECT doc_id, source,
               list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
                                          lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS s
        FROM documents))"""
FACTS = (
    SENTENCES
    + """,
names AS (SELECT list_sort(list(DISTINCT p_name)) AS n FROM part),
facts AS (
  SELECT doc_id * 1048576 + sent_idx AS fact_seq,
         CASE sent_idx % 4 WHEN 0 THEN l WHEN 1 THEN upper(l) WHEN 2 THEN l || 's' ELSE 'type of ' || l END AS concept,
         sentence AS content, source || '::' || doc_id AS source_chunk_id
  FROM (SELECT *, n[(doc_id * 31 + sent_idx) % len(n) + 1] AS l FROM sent, names WHERE length(sentence) > 10))"""
)


def title(token: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all(lower({token}), '[a-z]+|[0-9]+'), lambda r: upper(r[1:1]) || r[2:]), '')"


def group_key(x: str) -> str:
    clean = rf"regexp_replace({x}, '[^a-zA-Z0-9\s]', ' ', 'g')"
    return f"array_to_string(list_transform({words(clean)}, lambda t: CASE WHEN regexp_full_match(t, '[A-Z]{{1,6}}') THEN t ELSE {title('t')} END), ' ')"


def match_tokens(x: str) -> str:
    """Of labels without apostrophes."""
    w = words(rf"regexp_replace(lower({x}), '[^a-z0-9\s]', ' ', 'g')")
    last = f"{w}[-1]"
    single = f"CASE WHEN {last} LIKE '%ies' AND length({last}) > 4 THEN {last}[:-4] || 'y' WHEN {last} LIKE '%s' AND length({last}) > 3 THEN {last}[:-2] ELSE {last} END"
    return f"CASE WHEN len({w}) > 0 THEN list_append({w}[:-2], {single}) ELSE {w} END"


def concept_tokens(x: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN {listed(vocab.TOKEN_STOPWORDS)} AND length(t) > 1))"


def density(x: str) -> str:
    tokens = f"regexp_extract_all(lower({x}), '[a-z0-9]+')"
    return f"(CASE WHEN len({tokens}) = 0 THEN 0.0 ELSE len(list_filter({tokens}, lambda t: regexp_matches(t, '[0-9]'))) / len({tokens}) END)"


def compare_text(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({strip(x)}), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def template_markers(x: str) -> str:
    return matches(x, vocab.TEMPLATE_PATTERNS)


def worked_example(x: str) -> str:
    low = f"lower({x})"
    study = rf"(regexp_matches({low}, '\b19\d{{2}}\b|\b20\d{{2}}\b') AND regexp_matches({low}, '\b\d+(\.\d+)?\s*%') AND regexp_matches({x}, '\b[A-Z][a-zA-Z]+''s\b'))"
    years = rf"len(list_distinct(regexp_extract_all({low}, '\byear\s*\d+\b'))) >= 2"
    return f"({any_of(low, vocab.EXAMPLE_STRONG)} OR ({any_of(low, vocab.EXAMPLE_NUMERIC)} AND regexp_matches({low}, '[0-9]')) OR {study} OR {years} OR ({density(x)} >= 0.18 AND {any_of(low, vocab.EXAMPLE_DENSE)}))"


def formula(x: str) -> str:
    low = f"lower({x})"
    return rf"(regexp_matches({x}, '\S\s*=\s*\S') OR {any_of(low, vocab.FORMULA_WORDS)} OR (contains({low}, 'ratio') AND {any_of(low, vocab.COMPUTE_CUES)}) OR (len(regexp_extract_all({x}, '\b\d+([.,]\d+)?\b')) >= 2 AND regexp_matches({x}, '[-+/*=÷×]')))"


def low_signal(x: str) -> str:
    low = f"lower({x})"
    return rf"({strip(low)} = '' OR {template_markers(x)} OR {worked_example(x)} OR {any_of(low, vocab.NOISE_MARKERS)} OR {any_of(low, vocab.INSTRUCTION_MARKERS)} OR {density(x)} >= 0.22 OR len(regexp_extract_all({x}, '\S+')) < 6)"


def classify(x: str) -> str:
    """Of trimmed texts."""
    low = f"lower({x})"
    numbers, tokens = rf"len(regexp_extract_all({low}, '\b\d+([.,]\d+)?\b'))", f"greatest(len(regexp_extract_all({low}, '[a-z0-9]+')), 1)"
    return rf"""(CASE WHEN {x} = '' THEN 'key_point' WHEN regexp_matches({low}, '^there\s+(is|are)\b') THEN 'example' WHEN {worked_example(x)} THEN 'example'
      WHEN {any_of(low, vocab.INSTRUCTION_PHRASES)} OR regexp_matches({low}, '^({"|".join(vocab.INSTRUCTION_STARTS)})\b') THEN 'instruction'
      WHEN {any_of(low, vocab.EXAMPLE_MARKERS)} OR {numbers} / {tokens} >= 0.25 THEN 'example' WHEN {any_of(low, vocab.DEFINITION_MARKERS)} THEN 'definition' ELSE 'key_point' END)"""


def semantic(x: str, base: str) -> str:
    low = f"lower({x})"
    return f"(CASE WHEN {base} = 'instruction' THEN 'instruction' WHEN {formula(x)} THEN 'formula' WHEN {any_of(low, vocab.CAUTION_MARKERS)} THEN 'caution' WHEN {any_of(low, vocab.INTERPRETATION_MARKERS)} THEN 'interpretation' ELSE {base} END)"


def valid(x: str) -> str:
    """Of labels that are trimmed."""
    w, bare = words(x), lambda t: f"lower(regexp_replace({t}, '[.,!?;:]+$', ''))"
    tests = [
        f"{x} = ''", f"lower({x}) IN {listed(vocab.RESERVED_VALUES)}", rf"regexp_matches({x}, '\b(19|20)\d{{2}}\b')", f"len({w}) > 6",
        rf"regexp_matches({x}, '''s\b')", rf"regexp_matches({x}, '\b[A-Z]\s+[A-Z]\b')", any_of(f"lower({x})", [c.lower() for c in vocab.COUNTRIES_REGIONS]),
        f"len(list_filter({w}, lambda t: {bare('t')} LIKE '%ing' AND {bare('t')} NOT IN {listed(vocab.ING_NOUNS)})) > 0",
        "(" + " OR ".join(f"starts_with({x}, {text(v)})" for v in vocab.VAGUE_STARTS) + ")", f"{bare(w + '[1]')} IN {listed(vocab.IMPERATIVES)}",
        f"(len({w}) = 1 AND lower({x}) IN {listed(vocab.GENERIC_WORDS)})", f"{bare(w + '[1]')} IN {listed(vocab.ADJECTIVES)}", f"{bare(w + '[-1]')} IN {listed(vocab.RESOURCE_SUFFIXES)}",
        f"lower({x}) IN {listed(vocab.INTERNAL_LABELS)}", f"(contains(lower({x}), 'canonicalize') AND contains(lower({x}), 'concept'))",
    ]
    return "NOT (" + " OR ".join(f"coalesce({t}, false)" for t in tests) + ")"


def score(c: str, x: str) -> str:
    """The definition score of trimmed texts."""
    low, tokens = f"lower({x})", f"list_filter(regexp_extract_all(lower({c}), '[a-z0-9]+'), lambda t: t NOT IN {listed(vocab.TOKEN_STOPWORDS)} AND length(t) > 1)"
    starts = " OR ".join(f"starts_with({low}, '{a}' || lower({c}) || '{v}')" for a in ("", "the ") for v in (" is ", " refers to "))
    points = [
        (3, starts), (2, any_of(low, vocab.DEFINITION_TERMS)), (1, rf"regexp_matches({low}, '^(a|an|the)\s+[a-z]')"),
        (2, rf"contains(array_to_string(regexp_extract_all({low}, '\S+')[1:8], ' '), lower({c}))"),
        (1, rf"list_contains({tokens}, regexp_extract({low}, '^(a|an|the)\s+(\w+)', 2))"),
        (1, f"contains({low}, lower({c})) OR len(list_filter({tokens}, lambda t: contains({low}, t))) > 0"),
        (-2, rf"regexp_matches({x}, '[\d$%]') AND NOT {any_of(low, vocab.STATISTIC_TERMS)}"), (-2, any_of(low, vocab.TASK_TERMS)),
        (-1, rf"len(regexp_extract_all({x}, '\S+')) > 55"), (-3, any_of(low, vocab.VAGUE_TERMS)), (-3, f"starts_with({low}, 'there are')"), (-3, matches(low, vocab.COMPARATIVES, False)),
    ]
    return "(" + " + ".join(f"CASE WHEN {t} THEN {n} ELSE 0 END" for n, t in points) + ")"


def antonyms(a: str, b: str) -> str:
    return "(" + " OR ".join(f"(list_contains({a}, '{x}') AND list_contains({b}, '{y}')) OR (list_contains({a}, '{y}') AND list_contains({b}, '{x}'))" for x, y in vocab.ANTONYMS) + ")"


def sibling(a: str, b: str) -> str:
    return f"(len({a}) >= 2 AND len({b}) >= 2 AND {a}[-1] = {b}[-1] AND {a}[:-2] <> {b}[:-2])"


def cousin(a: str, b: str) -> str:
    return f"(len({a}) >= 2 AND len({a}) = len({b}) AND {a}[-1] <> {b}[-1] AND {a}[:-2] = {b}[:-2])"


def duplicate(a: str, b: str) -> str:
    off = f"list_filter(list_zip({a}, {b}), lambda p: p[1] <> p[2])"
    return f"(len({a}) = len({b}) AND (len({off}) = 0 OR (len({off}) = 1 AND levenshtein({off}[1][1], {off}[1][2]) = 1)))"


def bigrams(a: str) -> str:
    return f"list_transform(range(1, len({a})), lambda i: {a}[i] || ' ' || {a}[i + 1])"


def overlap(a: str, b: str) -> str:
    return f"(len({a}) >= 2 AND len({b}) >= 2 AND list_has_any({bigrams(a)}, {bigrams(b)}))"


def similar(a: str, b: str) -> str:
    return f"(NOT {antonyms(a, b)} AND ({duplicate(a, b)} OR (NOT {sibling(a, b)} AND NOT {cousin(a, b)} AND {overlap(a, b)} AND len(list_intersect({a}, {b})) >= greatest(2.0, 0.5 * least(len({a}), len({b}))))))"


def near(a: str, b: str) -> str:
    framed = lambda w: f"' ' || array_to_string({w}, ' ') || ' '"
    run = f"(least(len({a}), len({b})) >= 2 AND CASE WHEN len({a}) <= len({b}) THEN contains({framed(b)}, {framed(a)}) ELSE contains({framed(a)}, {framed(b)}) END)"
    longer, shorter = f"(CASE WHEN len({a}) > len({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN len({a}) > len({b}) THEN {b} ELSE {a} END)"
    one = f"(least(len({a}), len({b})) >= 2 AND ((abs(len({a}) - len({b})) = 1 AND list_has_all({longer}, {shorter})) OR (len({a}) = len({b}) AND len(list_filter(list_zip({a}, {b}), lambda p: p[1] <> p[2])) = 1)))"
    return f"(NOT {antonyms(a, b)} AND NOT {sibling(a, b)} AND NOT {cousin(a, b)} AND ({run} OR {one}))"


def merge_key(x: str) -> str:
    return f"array_to_string(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN {listed(vocab.MERGE_STOPWORDS)}), ' ')"


def capital(t: str) -> str:
    return f"(upper({t}[1:1]) || lower({t}[2:]))"


def is_acronym(t: str) -> str:
    return f"(regexp_matches({t}, '[A-Z]') AND NOT regexp_matches({t}, '[a-z]') AND length({t}) BETWEEN 2 AND 6)"


#: normal(concept, label) of labels(concept), for labels without parentheses.
NORMAL = rf"""
normal_1 AS (SELECT concept, {words(f"regexp_replace(replace(concept, '-', ' '), '^({'|'.join(vocab.LEADING_FILLERS)})', '', 'i')")} AS v FROM labels),
normal_2 AS (SELECT concept, list_filter(v, lambda t, i: i = 1 OR lower(t) <> lower(v[i - 1])) AS v FROM normal_1),
normal_3 AS (SELECT concept, CASE WHEN lower(v[-1]) IN {listed(vocab.GENERIC_SUFFIXES)} AND (len(v) >= 3 OR (len(v) = 2 AND length(v[1]) > 3)) THEN v[:-2] ELSE v END AS v FROM normal_2),
normal_4 AS (SELECT concept, v, v[-1] AS z, lower(v[-1]) AS y FROM normal_3),
normal_5 AS (SELECT concept, CASE WHEN len(v) = 0 THEN v ELSE list_append(v[:-2], CASE WHEN y IN {listed(vocab.SINGULAR_EXCEPTIONS)} OR length(z) <= 3 OR y NOT LIKE '%s' THEN z
  WHEN y LIKE '%ies' AND length(z) > 4 THEN z[:-4] || 'y' WHEN y LIKE '%ss' THEN z ELSE z[:-2] END) END AS v FROM normal_4),
normal AS (SELECT concept, array_to_string(list_transform(list_transform(v, lambda t: {{'t': t, 'c': regexp_replace(t, '[^A-Za-z0-9]', '', 'g')}}),
  lambda s: CASE WHEN {is_acronym('s.c')} THEN s.c ELSE {capital('s.t')} END), ' ') AS label FROM normal_5)"""


def title_case(w: str, known: str | None = None) -> str:
    """Of a list of words; known is a map from lower case to acronyms."""
    plain = f"CASE WHEN {is_acronym('t')} THEN t WHEN i > 1 AND lower(t) IN {listed(vocab.CONNECTORS)} THEN lower(t) ELSE {capital('t')} END"
    cased = plain if known is None else f"coalesce({known}[lower(t)], {plain})"
    return f"array_to_string(list_transform({w}, lambda t, i: {cased}), ' ')"


def page_title(w: str, known: str | None = None) -> str:
    """Of a list of words."""
    initials = f"upper(array_to_string(list_transform(list_filter({w}[:-2], lambda t: regexp_matches(t, '[A-Za-z]')), lambda t: t[1:1]), ''))"
    return f"(CASE WHEN len({w}) >= 2 AND {is_acronym(w + '[-1]')} AND contains({initials}, {w}[-1]) THEN {title_case(w + '[:-2]', known)} || ' (' || {w}[-1] || ')' ELSE {title_case(w, known)} END)"
