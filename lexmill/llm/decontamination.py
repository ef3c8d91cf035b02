"""Operator 4: benchmark decontamination by CGK embeddings and bit sampling.

Items and documents are word sequences (letters and digits, lower-cased).  A CGK random walk embeds a
window: at each step it puts out the word it stands on, and a random bit of that word and step says
whether it moves on; so sequences few edits apart agree in most places of their embeddings.  A key
samples some places; several independent walks reach the target recall.  Every offset of every item
has a window, documents one every ``stride`` words, so that any part of an item of a window's size and
stride meets a window that starts at the same word.  Pairs with equal keys are verified by the exact
edit distance of the whole item to the best stretch of the document around.

That holds for long items only, as these have many windows: the least length at which walks find items
with all their accepted edits is measured on random ones.  Shorter items are found without loss instead:
each edit spoils at most q of an item's runs of q words, so a stretch with no more than the accepted
edits has a least number of the item's runs, on diagonals no farther apart than those edits.

Items of less than 4 words, or null, aren't told from chance and match nothing.  Edge cases: a null or empty text matches nothing; rows with equal or null
ids are matched each by itself; repeated items (equal or null ids, equal texts) each match; texts of any
length are searched whole; of equally near places the first counts; empty tables give an empty result; other
columns pass through, but for those named as a column of the result, which that column replaces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import NOT_ALNUM, Words, join, mix, slices

STRIDE, WINDOW, SHORTEST = 3, 12, 4
SAMPLED = 8
#: Words of benchmark text handled in one pass over the documents; longer benchmarks take several.
BLOCK_WORDS = 200_000
MATCHES = "item_id long, edits int, item_words int, first_word long, end_word long"


def repeats_for(recall: float, edit_share: float, sampled: int = SAMPLED) -> int:
    """Walks for the recall of one aligned window, if each sampled place agrees with a chance of
    1 - edit_share; what they find of whole items is measured by walk_recall."""
    agree = (1 - edit_share) ** sampled
    if agree == 1:
        return 1
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


class Walks:
    """Keys of windows of `size` words from so many walks of 2 * size steps."""

    def __init__(self, size: int, repeats: int, sampled: int = SAMPLED, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.steps = size, 2 * size
        self.seeds = rng.integers(1, 2**63, repeats, dtype="u8")
        self.places = [frozenset(rng.choice(self.steps, min(sampled, self.steps), replace=False).tolist()) for _ in range(repeats)]

    def keys(self, hashes: np.ndarray, starts: np.ndarray, repeat: int) -> np.ndarray:
        """hashes has `size` spare values at its end."""
        bits = mix(hashes ^ self.seeds[repeat])
        at, end = starts.copy(), starts + (self.size - 1)
        key = np.full(len(starts), self.seeds[repeat], "u8")
        last = max(self.places[repeat])
        for step in range(last + 1):
            if step in self.places[repeat]:
                out = np.where(at <= end, hashes[np.minimum(at, end)], np.uint64(0))
                key = (key ^ out) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            if step < last:
                at += (bits[np.minimum(at, end)] >> np.uint64(step)).astype("i8") & 1
        return key


def edit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edits, first, end) of the stretch of text nearest to the whole item; ties go to the shortest, then first."""
    n = len(text)
    cost, begin = np.zeros(n + 1, "i8"), np.arange(n + 1)
    column = np.arange(n + 1)
    for i, word in enumerate(item.tolist()):
        swap = np.empty(n + 1, "i8")
        swap[0] = i + 1
        swap[1:] = np.minimum(cost[:-1] + (text != word), cost[1:] + 1)
        origin = np.empty(n + 1, "i8")
        origin[0] = 0
        origin[1:] = np.where(cost[:-1] + (text != word) <= cost[1:] + 1, begin[:-1], begin[1:])
        # Insertions run along the row: a running minimum of cost minus column.
        low = np.minimum.accumulate(swap - column)
        source = np.maximum.accumulate(np.where(swap - column == low, column, 0))
        cost, begin = low + column, origin[source]
    best = int(cost.min())
    ends = np.flatnonzero(cost == best)
    k = int(ends[np.lexsort((ends, ends - begin[ends]))[0]])
    return best, int(begin[k]), k


def walk_recall(walks: Walks, words: int, edits: int, trials: int = 400, seed: int = 11) -> float:
    """Share of random items of so many words with so many edits (a word changed, dropped or put in) that
    have a window in common with their edited text."""
    rng = np.random.default_rng(seed)
    spare = np.zeros(walks.size, "u8")
    found = 0
    for _ in range(trials):
        item = rng.integers(1, 2**63, words, dtype="u8")
        text = item.tolist()
        for at in sorted(rng.choice(words, edits, replace=False).tolist(), reverse=True):
            kind = int(rng.integers(3))
            text[at : at + (kind < 2)] = [int(rng.integers(1, 2**63))] * (kind != 1)
        text = np.concatenate([rng.integers(1, 2**63, rng.integers(walks.size, walks.size + STRIDE), dtype="u8"), np.array(text, "u8"), rng.integers(1, 2**63, walks.size, dtype="u8")])
        a, b = np.arange(words - walks.size + 1), np.arange(0, len(text) - walks.size + 1, STRIDE)
        item, text = np.concatenate([item, spare]), np.concatenate([text, spare])
        found += any(np.isin(walks.keys(text, b, r), walks.keys(item, a, r)).any() for r in range(len(walks.seeds)))
    return found / trials


@lru_cache
def least_for_walks(max_edits: float, recall: float) -> int:
    """Least number of words at which the walks find items with all accepted edits, with half the accepted
    loss as a margin for the sample; the lengths tried are those with the most edits a word."""
    walks = Walks(WINDOW, repeats_for(recall, max_edits / 2))
    least = WINDOW + STRIDE - 1
    if max_edits == 0:
        return least
    good = 0
    for edits in range(1, 31):
        words = math.ceil(edits / max_edits)
        if words >= least:
            good = good + 1 if walk_recall(walks, words, edits) >= (1 + recall) / 2 else 0
            if good == 2:
                return math.ceil((edits - 1) / max_edits)
    return 1 << 62


def runs(hashes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q words in a row."""
    n = max(0, len(hashes) - q + 1)
    key = np.zeros(n, "u8")
    for j in range(q):
        key = (key ^ hashes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def run_length(words: int, edits: int) -> tuple[int, int]:
    """(q, runs of q words that so many edits leave at least): the longest q up to 3 that leaves two, or else any."""
    left = {q: words - q + 1 - q * edits for q in (3, 2, 1)}
    return next(((q, t) for q, t in left.items() if t >= 2), (1, max(1, left[1])))


class ItemIndex:
    """Sorted keys of all windows of a block's long items, and of all runs of its shorter ones."""

    def __init__(self, items: list[tuple[int, str | None]], max_edits: float, recall: float):
        words = Words(*join([t for _, t in items]), lower=True, separators=NOT_ALNUM)
        spans = [(i, words.hashes[a:b]) for (i, _), a, b in zip(items, words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)]
        spans = [(i, h) for i, h in spans if len(h) >= SHORTEST]
        least = least_for_walks(max_edits, recall)
        self.items = [(i, h) for i, h in spans if len(h) >= least]
        n_long = len(self.items)
        short = [(i, h) for i, h in spans if len(h) < least]
        self.max_edits = max_edits
        self.size = WINDOW
        self.walks = Walks(self.size, repeats_for(recall, max_edits / 2, SAMPLED))
        owner, offset, flat, at = [], [], [], 0
        for k, (_, h) in enumerate(self.items):
            for o in range(len(h) - self.size + 1):
                owner.append(k)
                offset.append(o)
            flat += [h, np.zeros(self.size, "u8")]
        hashes = np.concatenate([*flat, np.zeros(1, "u8")])
        starts = []
        for _, h in self.items:
            starts.append(at + np.arange(len(h) - self.size + 1))
            at += len(h) + self.size
        self.tables = []
        if starts:
            at_ = np.concatenate(starts)
            owner_, offset_ = np.array(owner, "i8"), np.array(offset, "i8")
            for r in range(len(self.walks.seeds)):
                key = self.walks.keys(hashes, at_, r)
                order = np.argsort(key, kind="stable")
                self.tables.append((key[order], owner_[order], offset_[order]))
        self.items += short
        most = [int(max_edits * len(h)) for _, h in self.items]
        lengths = [run_length(len(h), e) for (_, h), e in zip(self.items, most, strict=True)]
        self.most, self.least_runs = np.array(most, "i8"), np.array([t for _, t in lengths], "i8")
        self.runs = []
        for q in (1, 2, 3):
            own = [k for k in range(n_long, len(self.items)) if lengths[k][0] == q]
            if own:
                keys = [runs(self.items[k][1], q) for k in own]
                key = np.concatenate(keys)
                order = np.argsort(key, kind="stable")
                owner_ = np.repeat(np.array(own, "i8"), [len(x) for x in keys])
                self.runs.append((q, key[order], owner_[order], np.concatenate([np.arange(len(x)) for x in keys])[order]))

    def matches(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text (item id, edits, item words, first word, end word) of the items in it, best place each."""
        words = Words(*join(texts), lower=True, separators=NOT_ALNUM)
        bounds, size = words.bounds, self.size
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        hashes = np.concatenate([words.hashes, np.zeros(size + 1, "u8")])
        if self.tables:
            starts, owner = [np.zeros(0, "i8")], [np.zeros(0, "i8")]
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                if b - a >= size:
                    s = np.arange(a, b - size + 1, STRIDE)
                    starts.append(s if s[-1] == b - size else np.append(s, b - size))
                    owner.append(np.full(len(starts[-1]), k))
            at, text_of = np.concatenate(starts), np.concatenate(owner)
            seen: set[tuple[int, int, int]] = set()
            for r, (keys, items, offsets) in enumerate(self.tables):
                key = self.walks.keys(hashes, at, r)
                left = np.searchsorted(keys, key)
                hit = np.flatnonzero(keys[np.minimum(left, len(keys) - 1)] == key)
                for w in hit.tolist():
                    k = int(text_of[w])
                    for j in range(int(left[w]), int(np.searchsorted(keys, key[w], side="right"))):
                        place = (k, int(items[j]), int(at[w] - offsets[j]))
                        if place not in seen:
                            seen.add(place)
                            self._verify(*place, place[2], hashes, bounds, found)
        for q, *table in self.runs:
            self._by_runs(q, *table, words.hashes, bounds, found)
        out: list[list[tuple[int, int, int, int, int]]] = [[] for _ in texts]
        for (k, item), (edits, first, end) in found.items():
            i, h = self.items[item]
            out[k].append((i, edits, len(h), first - int(bounds[k]), end - int(bounds[k])))
        return [sorted(x, key=lambda m: (m[0] is None, m[0] or 0, *m[1:])) for x in out]

    def _by_runs(self, q: int, keys: np.ndarray, items: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, found: dict) -> None:
        """Verifies all places with enough runs of an item on diagonals near enough."""
        key = runs(hashes, q)
        at = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key)
        text_of = np.searchsorted(bounds, at, side="right") - 1
        inside = at + q <= bounds[text_of + 1]
        at, text_of = at[inside], text_of[inside]
        left = np.searchsorted(keys, key[at])
        n = np.searchsorted(keys, key[at], side="right") - left
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - left, n)
        text_of, item, diagonal = np.repeat(text_of, n), items[entry], np.repeat(at, n) - offsets[entry]
        order = np.lexsort((diagonal, item, text_of))
        text_of, item, diagonal = text_of[order], item[order], diagonal[order]
        last = np.arange(len(item)) + self.least_runs[item] - 1
        inside = last < len(item)
        last = np.minimum(last, len(item) - 1)
        good = np.flatnonzero(inside & (text_of[last] == text_of) & (item[last] == item) & (diagonal[last] - diagonal <= self.most[item]))
        if not len(good):
            return
        k, i, d = text_of[good], item[good], diagonal[good]
        # Places that follow each other closely are one stretch.
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (d[1:] - d[:-1] > self.most[i[1:]] + 1)])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), len(k)], strict=True):
            self._verify(int(k[a]), int(i[a]), int(d[a]), int(d[b - 1] + self.most[i[a]]), hashes, bounds, found)

    def _verify(self, k: int, item: int, start: int, last: int, hashes: np.ndarray, bounds: np.ndarray, found: dict) -> None:
        h, old = self.items[item][1], found.get((k, item))
        if old is not None and old[0] == 0:
            return
        most = int(self.max_edits * len(h))
        low, high = max(int(bounds[k]), start - most), min(int(bounds[k + 1]), last + len(h) + most)
        near = set(hashes[low:high].tolist())
        if sum(w not in near for w in h.tolist()) > most:  # each absent word is an edit
            return
        edits, first, end = edit_distance(h, hashes[low:high])
        if edits <= most and (old is None or (edits, low + first) < old[:2]):
            found[k, item] = edits, low + first, low + end


def _find(index: ItemIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, owner = batch.column("_text").to_pylist(), [], []
            for k, hits in enumerate(h for part in slices(texts) for h in index.matches(part)):
                rows += hits
                owner += [k] * len(hits)
            take = pa.array(owner, pa.int64())
            kept = [k for k, name in enumerate(batch.schema.names) if name != "_text"]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in kept), *(pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds))], names=[*(batch.schema.names[k] for k in kept), "item_id", "edits", "item_words", "first_word", "end_word"])

    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.95, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item in it: docs' columns but text, then item_id, edits, item_words,
    first_word, end_word (in the document's words).

    max_edits is the share of an item's words that may be edited.  The benchmark is read in blocks of
    at most block_words words (an item is never cut); each block's index of about repeats * 24 bytes a
    word goes to the tasks of one pass.
    """
    own = benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    docs = docs.drop("item_id", "edits", "item_words", "first_word", "end_word").withColumn("_text", F.col("text").cast("string")).drop("text")
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields if x.name != "_text"]
    schema, out = ", ".join([*fields, MATCHES]), []

    def add(items: list[tuple[int, str]]) -> None:
        out.append(docs.mapInArrow(_find(ItemIndex(items, max_edits, recall)), schema))

    block, held = [], 0
    for row in own.sort("item_id", "text").toLocalIterator():
        n = len(row["text"].split())
        if block and held + n > block_words:
            add(block)
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += n
    add(block)
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
