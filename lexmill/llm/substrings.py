"""Operator 6: substring dedup by suffix automata of reference shards.

A window is ``length`` consecutive words.  Candidates first: every window is known by the least hash
among its 5-word runs (its minimizer); windows whose minimizer no other text has can't repeat, and only
the others are hashed and counted.  What repeats gives the reference: each passage once, from the
document of the smallest id that has it.  Passages are dealt over shards of bounded size; a shard's
task builds a suffix automaton of its passages, with the smallest document of each state, and streams
the candidate stretches routed to it for matching statistics.  Stretches that reach ``length`` words
in a state of a smaller document are removed.  Crowded shards are dealt over several tasks that each
build the automaton, so a passage that a third of all documents share is no bottleneck.

Edge cases: a null or empty text has no words; rows whose id is null neither lose words nor serve as
reference; rows with the same id never remove one another's words; a later copy of a whole text loses
everything if it has a window; texts of any length count whole; an empty table gives an empty result; other
columns pass through, but for kept_text, n_words and n_removed, which the operator's replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, drop_finished_shuffles, fields_of, materialise, packed
from ._words import Words, join, mix, slices, windows

#: Words of a run whose hash stands for the window.
RUN = 5
#: Words of reference passages in a shard, about; stretches that a task of it streams.
SHARD_WORDS, TASK_STRETCHES = 100_000, 20_000


def _word_hashes(texts: list[str | None]) -> Iterator[np.ndarray]:
    for part in slices(texts):
        words = Words(*join(part), lower=False)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            yield words.hashes[a:b]


def minimizers(hashes: np.ndarray, length: int) -> np.ndarray:
    """For each window the least hash of its runs."""
    runs = windows(hashes, min(RUN, length))
    n, span = len(hashes) - length + 1, length - min(RUN, length) + 1
    if n <= 0:
        return np.zeros(0, "u8")
    out = runs[:n].copy()
    for k in range(1, span):
        np.minimum(out, runs[k : k + n], out=out)
    return out


def _combined(found: list[np.ndarray], owner: list[np.ndarray]) -> pa.RecordBatch:
    """One row (key = minimizer, smallest text, null) for each minimizer, and for those that several texts share
    here a row (key of its own, text, minimizer) for each of them."""
    all_m, all_t = np.concatenate([np.zeros(0, "u8"), *found]).view("i8"), np.concatenate([np.zeros(0, "i8"), *owner])
    order = np.lexsort((all_t, all_m))
    m, t = all_m[order], all_t[order]
    begin = np.flatnonzero(np.append(True, m[1:] != m[:-1])) if len(m) else np.zeros(0, "i8")
    count = np.diff(np.append(begin, len(m)))
    several = np.repeat(count > 1, count)
    one = np.sort(order[begin])  # rows of one text stay together, so that shuffle files compress well
    own = mix(m[several].view("u8") ^ mix(t[several].view("u8"))).view("i8")
    columns = [np.concatenate([all_m[one], own]), np.concatenate([all_t[one], t[several]])]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.concat_arrays([pa.nulls(len(one), pa.int64()), pa.array(m[several])])], names=["key", "t", "m"])


def _emit_minimizers(length: int, rows: int = 500_000):
    """Minimizers of each distinct text, combined by about so many rows: of a passage that a third of all texts
    share only one row of each such lot meets the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # copies within a task count once
        found, owner, held = [], [], 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for key, h in zip(keys, _word_hashes(batch.column(1).to_pylist()), strict=True):
                if key not in seen:
                    seen.add(key)
                    found.append(np.unique(minimizers(h, length)))
                    owner.append(np.full(len(found[-1]), key))
                    held += len(found[-1])
                    if held >= rows:
                        yield _combined(found, owner)
                        found, owner, held = [], [], 0
        yield _combined(found, owner)

    return run


def _stretches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    if len(at):
        cut = np.flatnonzero(np.diff(at) != 1) + 1
        yield from zip(at[np.append(0, cut)].tolist(), at[np.append(cut - 1, len(at) - 1)].tolist(), strict=True)


def _emit_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, doc, shared, h in zip(batch.column("t").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("shared"), _word_hashes(batch.column("_text").to_pylist()), strict=True):
                at = np.flatnonzero(np.isin(minimizers(h, length).view("i8"), shared.values.to_numpy(zero_copy_only=False)))
                rows += [(t, doc, a, h[a : b + length].tobytes()) for a, b in _stretches(at)]
            t, doc, start = (np.array([r[k] for r in rows], "i8") for k in range(3))
            run_id = mix(t.view("u8") ^ mix(start.view("u8"))).view("i8")
            yield pa.RecordBatch.from_arrays([*map(pa.array, (run_id, t, doc, start)), pa.array([r[3] for r in rows], pa.binary())], names=["r", "t", "doc", "start", "words"])

    return run


def _emit_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = [windows(np.frombuffer(x.as_py(), "u8"), length) for x in batch.column("words")]
            count = [len(x) for x in w]
            r, doc = (np.repeat(batch.column(c).to_numpy(), count) for c in ("r", "doc"))
            within = np.concatenate([np.zeros(0, "i4"), *(np.arange(n, dtype="i4") for n in count)])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate([np.zeros(0, "u8"), *w]).view("i8"), r, doc, within)], names=["w", "r", "doc", "pos"])

    return run


def _route(length: int, shards: int):
    """Reference passages (kind 0) and stretches to look up (kind 1) of each run, for their shards.

    pos and low are a run's repeated windows (from its start) and the smallest document that has each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch, rows = whole.slice(k, 1000), []
                for t, doc, start, raw, at, lowest in zip(*(batch.column(c).to_pylist() for c in ("t", "doc", "start")), *(batch.column(c) for c in ("words", "pos", "low")), strict=True):
                    words = np.frombuffer(raw.as_py(), "u8")
                    pos, low = at.values.to_numpy(zero_copy_only=False), lowest.values.to_numpy(zero_copy_only=False)
                    shard = low % shards
                    for kind, mask in ((0, low == doc), (1, low < doc)):
                        for s in np.unique(shard[mask]).tolist():
                            for a, b in _stretches(np.unique(pos[mask & (shard == s)])):
                                rows.append((s, kind, t, doc, start + a, words[a : b + length].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], x) for c, x in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "kind", "t", "doc", "start", "words"])

    return run


class SuffixAutomaton:
    """All passages' factors, with the smallest document in which each state's strings end."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.low = [-1], [0], [1 << 62]
        self._separator = -1

    def add(self, passage: list[int], doc: int) -> None:
        last = 0 if self.length == [0] else self._extend(self._last, self._separator, 1 << 62)
        self._separator -= 1
        for symbol in passage:
            last = self._extend(last, symbol, doc)
        self._last = last

    def _extend(self, last: int, symbol: int, doc: int) -> int:
        nxt, link, length, low = self.next, self.link, self.length, self.low
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        low.append(doc)
        link.append(0)
        p = last
        while p >= 0 and symbol not in nxt[p]:
            nxt[p][symbol] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][symbol]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(nxt[q].copy())
                length.append(length[p] + 1)
                low.append(1 << 62)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and nxt[p].get(symbol) == q:
                    nxt[p][symbol] = clone
                    p = link[p]
        return new

    def finish(self) -> None:
        """Smallest documents pass from longer strings to their suffixes."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[v]
            if self.low[v] < self.low[p]:
                self.low[p] = self.low[v]

    def spans(self, words: list[int], doc: int, least: int) -> list[tuple[int, int]]:
        """Maximal stretches of windows of `least` words that occur in a document smaller than doc."""
        nxt, link, length, low = self.next, self.link, self.length, self.low
        v = n = 0
        out: list[tuple[int, int]] = []
        for i, symbol in enumerate(words):
            while v and symbol not in nxt[v]:
                v = link[v]
                n = length[v]
            if symbol in nxt[v]:
                v = nxt[v][symbol]
                n += 1
            while v and length[link[v]] >= least:
                v = link[v]
            n = min(n, length[v])
            if n >= least and low[v] < doc:
                if out and out[-1][1] >= i + 1 - least:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((i + 1 - least, i + 1))
        return out


def _match(length: int):
    def one(group: pd.DataFrame) -> pd.DataFrame:
        automaton, rows = SuffixAutomaton(), []
        group = group.sort_values(["kind", "doc", "start"], kind="stable")
        for kind, t, doc, start, raw in zip(group["kind"], group["t"], group["doc"], group["start"], group["words"], strict=True):
            words = np.frombuffer(raw, "u8").tolist()
            if kind == 0:
                automaton.add(words, doc)
            else:
                if rows == []:
                    automaton.finish()
                    rows = [None]
                rows += [(t, start + a, start + b) for a, b in automaton.spans(words, doc, length)]
        return pd.DataFrame(rows[1:], columns=["t", "first", "end"])

    return one


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, gone = [], [], []
        for text, spans in zip(batch.column("_text"), batch.column("_spans"), strict=True):
            words = (text.as_py() or "").encode().split()
            keep = np.ones(len(words), bool)
            for s in spans.as_py() or ():
                keep[s["first"] : s["end"]] = False
            total.append(len(words))
            gone.append(len(words) - int(keep.sum()))
            texts.append(b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k] if gone[-1] else words).decode())
        kept = [k for k, name in enumerate(batch.schema.names) if name not in ("_text", "_spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*(batch.schema.names[k] for k in kept), "kept_text", "n_words", "n_removed"])


def repeated_spans(texts: DataFrame, first: DataFrame, length: int) -> DataFrame:
    """(t, spans) of the texts that repeat something; texts has t, doc_id and _text, first the smallest doc_id
    (first_doc) of each t.  A text counts with that one; further copies of it change nothing."""
    spark = texts.sparkSession
    found = texts.select("t", "_text").mapInArrow(_emit_minimizers(length), "key long, t long, m long")
    by_key = Window.partitionBy("key")
    shared = found.withColumns({"low": F.min("t").over(by_key), "high": F.max("t").over(by_key)}).filter(F.col("m").isNotNull() | (F.col("low") != F.col("high")))
    shared = materialise(shared.select("t", F.coalesce("m", "key").alias("m")).groupBy("t").agg(F.collect_set("m").alias("shared")), "shared")
    drop_finished_shuffles(spark)
    own = texts.join(shared.join(first, "t"), "t").filter("doc_id = first_doc").select("t", "doc_id", "_text", "shared")
    runs = materialise(own.mapInArrow(_emit_runs(length), "r long, t long, doc long, start long, words binary"), "runs")
    discard(shared)
    drop_finished_shuffles(spark)
    seen = runs.mapInArrow(_emit_windows(length), "w long, r long, doc long, pos int")
    # Written, so that a window of very many texts can be split where it is joined.
    low = materialise(seen.groupBy("w").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low <> high").select("w", "low"), "low")
    drop_finished_shuffles(spark)
    verdict = seen.select("w", "r", "pos").join(low, "w").groupBy("r").agg(F.collect_list(F.struct("pos", "low")).alias("found"))
    # Shards by the words of all runs, an upper bound on those of the passages.
    words = runs.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("n")).first()["n"] // 8
    shards = int(max(1, words // SHARD_WORDS))
    routed = materialise(runs.join(verdict, "r").select("t", "doc", "start", "words", F.col("found.pos").alias("pos"), F.col("found.low").alias("low")).mapInArrow(_route(length, shards), "shard long, kind int, t long, doc long, start long, words binary"), "routed")
    discard(runs, low)
    drop_finished_shuffles(spark)
    tasks = routed.filter("kind = 1").groupBy("shard").agg(F.ceil(F.count("*") / TASK_STRETCHES).cast("int").alias("tasks"))
    dealt = routed.join(tasks, "shard").withColumn("task", F.when(F.col("kind") == 0, F.sequence(F.lit(0), F.col("tasks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("t", "start"), "tasks").cast("int"))))
    spans = dealt.select("shard", F.explode("task").alias("task"), "kind", "t", "doc", "start", "words").groupBy("shard", "task").applyInPandas(_match(length), "t long, first long, end long")
    return spans.groupBy("t").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = 13) -> DataFrame:
    """docs' columns but text, with kept_text (words joined by a space), n_words, n_removed."""
    keyed = packed(docs, ("kept_text", "n_words", "n_removed")).withColumns({"t": F.xxhash64("_text"), "doc_id": F.col("_row.doc_id").cast("long")})
    first = keyed.filter("doc_id IS NOT NULL").groupBy("t").agg(F.min("doc_id").alias("first_doc"))
    texts = keyed.filter("doc_id IS NOT NULL").select("t", "doc_id", "_text")
    spans = materialise(repeated_spans(texts, first, length), "spans")
    # A later copy of a whole text loses all its words, if they make a window.
    joined = keyed.join(first.join(spans, "t", "left"), "t", "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first_doc"), F.lit(False)) & (F.size(F.filter(F.split(F.col("_text"), r"[ \t-\r]+", length + 2), lambda x: x != "")) >= length)
    every = F.array(F.struct(F.lit(0).cast("long").alias("first"), F.lit(1 << 40).cast("long").alias("end")))
    marked = joined.withColumn("_spans", F.when(copy, every).when(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("first_doc")), F.col("spans"))).select("_row", "_text", "_spans")
    out = marked.mapInArrow(_remove, ", ".join([*fields_of(marked, ("_text", "_spans")), "kept_text string, n_words long, n_removed long"]))
    return out.select("_row.*", "kept_text", "n_words", "n_removed")


#: DuckDB SQL of op6_substring_dedup.
ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM words),
win AS (SELECT doc_id, i, x, CASE WHEN i <= n - 12 THEN md5(string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)) END AS k FROM tok),
lows AS (SELECT k, min(doc_id) AS low FROM win WHERE k IS NOT NULL GROUP BY k),
hits AS (SELECT win.doc_id, i, x, coalesce(low < win.doc_id, false) AS hit FROM win LEFT JOIN lows USING (k)),
marked AS (SELECT doc_id, i, x, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM hits)
SELECT d.doc_id, count(x) AS n_words, count(x) FILTER (WHERE gone) AS n_removed, sha256(coalesce(string_agg(x, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM documents d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id
"""
