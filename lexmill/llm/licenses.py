"""Operator 10: licence scans by sentence rules, with DataFrame functions only.

A text is split into passages at sentence ends, blank lines and list numbers, so a passage may run over
several lines.  Each is normalised (ASCII lower case, everything but letters and digits as one space),
and known licence sentences are looked for across its line breaks; of those that begin in one line, the
first of the table counts, and each text stretch counts once.  An SPDX tag gives an identifier for each
licence of its expression.  The sequence of a text's identifiers is then matched
against ordered licence rules; each rule takes its sentences out of the sequence, so that a longer
grant isn't told again by a shorter one.  What no rule takes is ``unmatched``.

Edge cases: a null or empty text has no sentence; every row is scanned, also where ids repeat or are
null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Every sentence of SENTENCES has one of these words.
KEY = r"(?i)permission|redistribut|endorse|software|licen[cs]e|apache|gpl|applicable|(?<![a-z0-9])cc(?:0|[^a-z0-9])|attribution|creative|bsd|domain|reserved|spdx"
#: The narrower filter of the SQL, which sees no sentence without one of these words.
HINT = r"(?i)licen[cs]e|copyright|rights reserved|warrant|redistribut|permission|public domain|spdx|merchantab|creative commons"

#: (identifier, expression over a normalised sentence): the first that matches counts.
SENTENCES = (
    ("spdx", r"\bspdx license identifier\b"),
    ("mit_grant", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc_grant", r"^permission to use copy modify and or distribute this software for any purpose"),
    ("mit_notice", r"^the above copyright notice and this permission notice shall be included"),
    ("bsd_redistribution", r"^redistribution and use in source and binary forms"),
    ("bsd_source", r"redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_endorse", r"^(3 )?neither the names? of .* may be used to endorse or promote products"),
    ("as_is", r"\b(the|this) software is provided .*as is\b"),
    ("apache2_conditions", r"^you may not use this file except in compliance with the license"),
    ("apache2_obtain", r"^you may obtain a copy of the license at\b"),
    ("apache2_limits", r"^unless required by applicable law or agreed to in writing"),
    ("apache2", r"\bapache license,? version 2 0\b|\bapache (license )?2 0\b"),
    ("agpl3", r"\bgnu affero general public license\b|\bagpl( version)? ?v?3\b"),
    ("lgpl3", r"\bgnu (lesser|library) general public license\b.*\b3\b|\blgpl ?v?3\b"),
    ("lgpl2", r"\bgnu (lesser|library) general public license\b|\blgpl\b"),
    ("gpl3", r"\bgnu general public license\b.*\b3\b|\bgpl ?v?3\b"),
    ("gpl2", r"\bgnu general public license\b.*\b2\b|\bgpl ?v?2\b"),
    ("gpl", r"\bgnu general public license\b"),
    ("mpl2", r"\bmozilla public license\b"),
    ("cc_by_nc_sa", r"\bcc by nc sa\b|\battribution noncommercial sharealike\b"),
    ("cc_by_nc_nd", r"\bcc by nc nd\b|\battribution noncommercial noderivatives\b"),
    ("cc_by_nc", r"\bcc by nc\b|\battribution noncommercial\b"),
    ("cc_by_sa", r"\bcc by sa\b|\battribution sharealike\b"),
    ("cc_by_nd", r"\bcc by nd\b|\battribution noderivatives\b"),
    ("cc_by", r"\bcc by\b|\bcreative commons attribution\b"),
    ("cc0", r"\bcc0\b|\bcreative commons zero\b"),
    ("bsd3", r"\bbsd 3 clause\b|\b3 clause bsd\b|\bnew bsd license\b"),
    ("bsd2", r"\bbsd 2 clause\b|\b2 clause bsd\b|\bsimplified bsd license\b"),
    ("mit", r"\bmit license\b|\blicensed under (the )?mit\b"),
    ("isc", r"\bisc license\b"),
    ("unlicense", r"\breleased into the public domain\b|\bunlicense\b"),
    ("reserved", r"\ball rights reserved\b"),
)

#: (licence, sequence of identifiers, those with ? may be absent), tried in this order.
RULES = (
    ("MIT", ("mit_grant", "mit_notice?", "as_is?")),
    ("ISC", ("isc_grant", "as_is?")),
    ("BSD-3-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "bsd_endorse", "as_is?")),
    ("BSD-2-Clause", ("bsd_redistribution", "bsd_source", "bsd_binary", "as_is?")),
    ("Apache-2.0", ("apache2", "apache2_conditions?", "apache2_obtain?", "apache2_limits?")),
    ("AGPL-3.0", ("agpl3",)),
    ("LGPL-3.0", ("lgpl3",)),
    ("LGPL-2.1", ("lgpl2",)),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-2.0", ("gpl2",)),
    ("GPL", ("gpl",)),
    ("MPL-2.0", ("mpl2",)),
    ("CC-BY-NC-SA", ("cc_by_nc_sa",)),
    ("CC-BY-NC-ND", ("cc_by_nc_nd",)),
    ("CC-BY-NC", ("cc_by_nc",)),
    ("CC-BY-SA", ("cc_by_sa",)),
    ("CC-BY-ND", ("cc_by_nd",)),
    ("CC-BY", ("cc_by",)),
    ("CC0", ("cc0",)),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("MIT", ("mit",)),
    ("ISC", ("isc",)),
    ("Unlicense", ("unlicense",)),
    ("Reserved", ("reserved",)),
)
#: (licence, name of the identifier after spdx_, expression over a lower-cased SPDX identifier).
SPDX = (
    ("MIT", "mit", "mit"),
    ("ISC", "isc", "isc"),
    ("BSD-3-Clause", "bsd3", "bsd-3-clause"),
    ("BSD-2-Clause", "bsd2", "bsd-2-clause"),
    ("Apache-2.0", "apache2", r"apache-2\.0"),
    ("AGPL-3.0", "agpl3", r"agpl-3\.0(-only|-or-later)?"),
    ("LGPL-3.0", "lgpl3", r"lgpl-3\.0(-only|-or-later)?"),
    ("LGPL-2.1", "lgpl2", r"lgpl-2\.1(-only|-or-later)?"),
    ("GPL-3.0", "gpl3", r"gpl-3\.0(-only|-or-later)?"),
    ("GPL-2.0", "gpl2", r"gpl-2\.0(-only|-or-later)?"),
    ("MPL-2.0", "mpl2", r"mpl-2\.0"),
    ("CC-BY-NC-SA", "cc_by_nc_sa", r"cc-by-nc-sa-[0-9.]+"),
    ("CC-BY-NC-ND", "cc_by_nc_nd", r"cc-by-nc-nd-[0-9.]+"),
    ("CC-BY-NC", "cc_by_nc", r"cc-by-nc-[0-9.]+"),
    ("CC-BY-SA", "cc_by_sa", r"cc-by-sa-[0-9.]+"),
    ("CC-BY-ND", "cc_by_nd", r"cc-by-nd-[0-9.]+"),
    ("CC-BY", "cc_by", r"cc-by-[0-9.]+"),
    ("CC0", "cc0", r"cc0-1\.0"),
    ("Unlicense", "unlicense", "unlicense"),
)
SPDX_RULES = tuple((licence, (f"spdx_{name}",)) for licence, name, _ in SPDX)
SPDX_TAG = r"(?i)spdx[^a-z0-9]+license[^a-z0-9]+identifier(?![a-z0-9])"
_SPDX_ID = r"\(*[a-z0-9](?:[a-z0-9.+-]*[a-z0-9+])?\)*"
#: The licence expression after a tag.
SPDX_EXPRESSION = rf"{SPDX_TAG}[^a-z0-9(]*({_SPDX_ID}(?:\s+(?:and|or|with)\s+{_SPDX_ID})*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rule_expression(sequence: tuple[str, ...]) -> str:
    return "".join(f"(?:<{s[:-1]}>)?" if s.endswith("?") else f"<{s}>" for s in sequence)


def _passages(text: Column) -> Column:
    """Sentences over all their lines; a line with no ASCII letter or digit is blank, an SPDX tag ends with its line."""
    listed = F.regexp_replace(text, r"\n(?=[^A-Za-z0-9\n]*[0-9]{1,3}[.)][ \t]+\S)", "\x1e")
    ended = F.regexp_replace(F.regexp_replace(listed, r"\n(?:[^A-Za-z0-9\n]*\n)+", "\x1e"), r"([.!?;])\s+", "$1\x1e")
    return F.split(F.regexp_replace(ended, rf"({SPDX_TAG}[^\n\x1e]*)", "\x1e$1\x1e"), "\x1e")


def _normalised(passage: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(passage, UPPER, LOWER), "[^a-z0-9\n]+", " "), r" ?\n ?", "\n"))


#: A known sentence is replaced by its mark, which no later expression takes or reads across.
MARK, MARKS = 0xE000, "[\ue000-\ue0ff]"


def _across_lines(expression: str) -> str:
    """The expression with line breaks for spaces, ^ at each line, and a version told afterwards not taken."""
    expression = re.sub(r"\.\*(\\b\d\\b)", r"(?=.*\1)", expression)
    return "(?m)" + expression.replace(".*", MARKS.replace("[", "[^") + "*").replace(" ", r"[ \n]")


def _known(passage: Column) -> Column:
    """The identifiers of a passage's known sentences, by the lines that they begin in."""
    marked = reduce(lambda t, s: F.regexp_replace(t, _across_lines(s[1][1]), chr(MARK + s[0])), enumerate(SENTENCES), _normalised(passage))
    first = F.filter(F.transform(F.split(marked, "\n"), lambda x: F.array_min(F.regexp_extract_all(x, F.lit(MARKS), F.lit(0)))), lambda x: x.isNotNull())
    names = F.array(*[F.lit(i) for i, _ in SENTENCES])
    return F.transform(first, lambda x: F.element_at(names, F.ascii(x) - (MARK - 1)))


def _spdx_identifiers(sentence: Column) -> Column:
    """An identifier for each licence of the expression, spdx for an unknown one; exceptions are no licences."""
    bare = F.regexp_replace(F.regexp_extract(sentence, SPDX_EXPRESSION, 1), r"(?i)\s+with\s+[^\s()]+|[()]", "")
    each = lambda x: reduce(lambda c, s: c.when(x.rlike(rf"^(?:{s[2]})\+?$"), F.lit(f"spdx_{s[1]}")), SPDX, F.when(x == "", F.lit("spdx"))).otherwise(F.lit("spdx"))
    return F.transform(F.split(F.translate(bare, UPPER, LOWER), r"\s+(?:and|or)\s+"), each)


def _identifiers(passage: Column) -> Column:
    """All identifiers of a passage, as an array."""
    return F.when(passage.rlike(SPDX_TAG), _spdx_identifiers(passage)).otherwise(_known(passage))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences (identifiers), sentence_ids in order, licences found (array, in rule order), unmatched."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = F.flatten(F.transform(F.filter(_passages(text), lambda s: s.rlike(KEY)), _identifiers))
    out = docs.select("doc_id", F.when(text.rlike(KEY), known).otherwise(F.array().cast("array<string>")).alias("sentence_ids"))
    out = out.withColumn("sequence", F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), ""))
    # All rules in one expression: the sequence goes through them, each adding its licence if it matches.
    state = F.struct(F.col("sequence").alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_rule_expression(s)).alias("rule")) for name, s in (*RULES, *SPDX_RULES)])
    step = lambda a, r: F.struct(F.regexp_replace(a["rest"], r["rule"], "").alias("rest"), F.when(F.regexp_like(a["rest"], r["rule"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found"))
    matched = F.when(F.col("sequence") == "", state).otherwise(F.aggregate(rules, state, step))
    out = out.withColumn("matched", matched)
    return out.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), "sentence_ids", F.array_distinct("matched.found").alias("licences"), F.col("matched.rest").alias("unmatched"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def oracle() -> str:
    """The query's DuckDB SQL, from the same sentences and rules.

    It filters by HINT, has no rules for SPDX tags and cuts sentences at every line feed, so it gives the
    operator's rows only where no text has a tag, a licence sentence outside HINT or a wrapped one.
    """
    case = " ".join(f"WHEN regexp_matches(s, {_sql_text(e)}) THEN {_sql_text(i)}" for i, e in SENTENCES)
    steps, last = [], "ids"
    for k, (name, sequence) in enumerate(RULES):
        e = _sql_text(_rule_expression(sequence))
        steps.append(f"r{k} AS (SELECT doc_id, n, ids, regexp_replace(rest, {e}, '', 'g') AS rest, CASE WHEN regexp_matches(rest, {e}) AND NOT list_contains(found, {_sql_text(name)}) THEN list_append(found, {_sql_text(name)}) ELSE found END AS found FROM {last})")
        last = f"r{k}"
    return rf"""
WITH lines AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?;])\s+', '\1' || chr(10), 'g'), chr(10)) AS l
  FROM documents),
sentences AS (
  SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS k FROM lines),
normal AS (
  SELECT doc_id, k, trim(regexp_replace(translate(raw, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) AS s
  FROM sentences WHERE regexp_matches(raw, {_sql_text(HINT)})),
known AS (SELECT doc_id, k, CASE {case} END AS id FROM normal),
per_doc AS (SELECT doc_id, count(id) AS n, string_agg(id, ',' ORDER BY k) AS ids, string_agg('<' || id || '>', '' ORDER BY k) AS rest FROM known WHERE id IS NOT NULL GROUP BY doc_id),
ids AS (SELECT d.doc_id AS doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(rest, '') AS rest, CAST([] AS VARCHAR[]) AS found FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, ids AS sentence_ids, array_to_string(found, ',') AS licences, rest AS unmatched FROM {last}
"""
