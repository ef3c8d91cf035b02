"""Operator 8: secret scans by one combined deterministic automaton.

All rules' byte expressions are compiled by subset construction and minimisation into one transition
array; every byte of every text passes it once, for all rules together, and the places where a rule's
match may end come out.  Places in a row are one match; the reversed automaton of that rule, run back
from its end, gives the leftmost start after the match before (leftmost, not overlapping, in code
points).  No other engine for expressions is used.

Edge cases: a null text is an empty one; an empty text has no spans; rows with equal or null ids
stay rows of their own, also where texts are equal; texts may be of any length; an empty table gives
an empty result; other columns pass through, but for those named as a column of the result, which
that column replaces.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import slices
from .automaton import Automaton, compile_rules, scan


@dataclass(frozen=True)
class Rule:
    """A match is head and body; it fails if the body has less than least code points.

    Expressions are over bytes, with the classes written out, so that no letter outside ASCII matches.
    A match must end where its places of end in a row do: the body ends with a repeated class, or in
    one way only.  many stands for body in the combined automaton: it needn't count up to least, as the
    counters of several rules multiply, but where it finds no end no body reaches least.
    """

    kind: str
    body: str
    head: str = ""
    least: int = 0
    any_case: bool = False
    many: str = ""


#: The three base kinds, whose spans are fixed.
BASE = (
    Rule("assign", r"[A-Za-z0-9+/_.=-]+", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", 12, True),
    Rule("access", "AKIA[A-Z0-9]+", "", 18),
    Rule("hex", "[0-9a-f]+", "", 16, many="[0-9a-f]{8,}"),
)
#: What the method adds: widely documented formats of keys.
ADDED = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", "", 40),
    Rule("slack", "xox[baprs]-[A-Za-z0-9-]+", "", 15),
    Rule("stripe", "sk_live_[A-Za-z0-9]+", "", 24),
    Rule("google", "AIza[A-Za-z0-9_-]+", "", 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + ADDED


@functools.lru_cache(4)
def automaton_of(rules: tuple[Rule, ...]) -> Automaton:
    return compile_rules([(r.head + (r.many or r.body), r.any_case) for r in rules])


@functools.lru_cache(4)
def _single(rules: tuple[Rule, ...]) -> list[tuple[Automaton, Automaton | None]]:
    """For each rule the reversed automaton of its match, and the one of its head."""
    back = [compile_rules([(r.head + r.body, r.any_case)], anchored=True, backwards=True) for r in rules]
    return [(b, compile_rules([(r.head, r.any_case)], anchored=True) if r.head else None) for b, r in zip(back, rules, strict=True)]


def spans_of(rules: tuple[Rule, ...], automaton: Automaton, texts: list[str]) -> list[list[tuple[int, int, int]]]:
    """(start, rule, end) in code points of every match in each text, sorted."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # A line feed resets the automaton, as no rule's match holds one: texts can't run together.
    raw = "\n".join(texts).encode()
    data = np.frombuffer(raw, "u1")
    places, masks = scan(automaton, data)
    if not len(places):
        return out
    point = np.cumsum((data & 0xC0) != 0x80) - 1  # the code point that each byte belongs to
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    for r, (back, head) in enumerate(_single(rules)):
        own = places[masks >> r & 1 == 1]
        if not len(own):
            continue
        ends = own[np.append(np.diff(own) > 1, True)] + 1
        done = 0
        for end in ends.tolist():
            start = back.longest(raw, end, done)
            if start is None:
                continue
            done = end
            body = start if head is None else head.longest(raw, start, end)
            if end - body >= rules[r].least:
                first = int(point[start])
                k = int(np.searchsorted(begins, first, side="right")) - 1
                first -= int(begins[k])
                out[k].append((first, r, first + end - start))
    return [sorted(x) for x in out]


def _render(rules: tuple[Rule, ...], spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{rules[r].kind}:{s}:{e}" for s, r, e in spans)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = len(BASE)) -> DataFrame:
    """docs' columns but text, with hits (kind, start, end), their rendering and the base kinds' digest.

    The first ``base`` rules are counted as n_<kind>; the automaton is made on the driver once.
    """
    automaton = automaton_of(rules)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            hits = [x for part in slices(texts, 1000, 1_000_000) for x in spans_of(rules, automaton, part)]
            own = [[h for h in x if h[1] < base] for x in hits]
            columns = {name: batch.column(name) for name in batch.schema.names if name != "text"}
            for r in range(base):
                columns[f"n_{rules[r].kind}"] = pa.array([sum(h[1] == r for h in x) for x in own], pa.int64())
            columns["base_sha256"] = pa.array([hashlib.sha256(_render(rules, x).encode()).hexdigest() for x in own])
            columns["spans"] = pa.array([_render(rules, x) for x in hits], pa.string())
            columns["hits"] = pa.array([[{"kind": rules[r].kind, "start": s, "end": e} for s, r, e in x] for x in hits], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)

    new = [f"n_{r.kind}" for r in rules[:base]] + ["base_sha256", "spans", "hits"]
    docs = docs.withColumn("text", F.col("text").cast("string")).drop(*new)
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields if x.name != "text"]
    fields += [f"{n} long" for n in new[:base]] + ["base_sha256 string", "spans string", "hits array<struct<kind:string,start:long,end:long>>"]
    return docs.mapInArrow(found, ", ".join(fields))


def redact(text: str, hits: list[dict], mark: str = "[SECRET]") -> str:
    """text with every hit, also overlapping ones, replaced by mark."""
    out, at = [], 0
    for h in sorted(hits, key=lambda h: (h["start"], -h["end"])):
        if h["start"] >= at:
            out += [text[at : h["start"]], mark]
        at = max(at, h["end"])
    return "".join([*out, text[at:]])
