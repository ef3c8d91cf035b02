"""Operator 7: toxicity by weak supervision.

Voters are lexicons and patterns: sets of words and word beginnings that labelled rows show to go with
toxic texts, dealt over several voters, a fixed list of insults, and counts of hits.  A generative label
model, fitted by EM to the votes on all documents, estimates each voter's accuracies and which voters
are correlated beyond the label; correlated ones are modelled jointly.  Its posterior labels of a bounded
sample of all documents that may be learned from, labelled or not, train a linear classifier on hashed
words and word beginnings, which scores every text.  Gold labels only make lexicons and the prior.

Edge cases: a null or empty text has no features and gets the model's base score; a text of any length
counts whole; labels that are null or whose document is absent aren't used; where a document has several
labels the highest counts; rows whose id is null count as held out; without labelled rows of both kinds
the fixed list alone votes; rows with equal ids or texts stay rows of their own and get equal scores; an
empty table gives an empty result; other columns pass through, but for toxicity, which the operator's replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._words import LOWER, NOT_ALNUM, Words, join, mix, slices
from .linear import Ftrl

BITS = 20
#: Labelled rows that lexicons are made from at most, about half of them toxic.
MAX_LABELLED_ROWS = 5000
#: Documents whose posterior labels train the classifier at most, about half of them with a vote.
MAX_TRAINING_ROWS = 6000
#: The fixed list (general insults).
INSULTS = ("clown", "disgusting", "dumb", "fool", "garbage", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "ugly", "vermin", "worthless")
PREFIXES = (4, 5, 6, 7)
LEXICONS = 6
#: Mined lexicons, the fixed list, two or more distinct hits, four or more.
VOTERS = LEXICONS + 3
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The distinct feature numbers of each text: hashed words, and beginnings of longer words."""
    data, begins = join(texts)
    words = Words(data, begins, lower=True, separators=NOT_ALNUM)
    padded = np.concatenate([LOWER[data], np.zeros(8, "u1")])
    start = np.zeros(len(words.starts), "u8")
    kinds, keep = [words.hashes * _MULTIPLY >> np.uint64(64 - BITS)], [np.ones(len(start), bool)]
    for k in range(max(PREFIXES)):
        start |= padded[words.starts + k].astype("u8") << np.uint64(8 * k)
        if k + 1 in PREFIXES:
            h = (start + np.uint64(k)) * _MULTIPLY
            kinds.append((h ^ (h >> np.uint64(32))) * _MULTIPLY >> np.uint64(64 - BITS))
            keep.append(words.lengths > k + 1)
    all_, kept = np.stack(kinds, axis=1).astype("i4"), np.stack(keep, axis=1)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        yield np.unique(all_[a:b][kept[a:b]])


def _slices(column: pa.Array) -> Iterator[np.ndarray]:
    for part in slices(column.to_pylist()):
        yield from features(part)


def distinct_rows(rows: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Numbers of the rows but for near copies of an earlier one with the same label, which would pass
    off their text's rare words as signs of the label: rows that share one of six triples of minima."""
    salts = np.random.default_rng(1).integers(1, 2**63, 18, dtype="u8") * np.uint64(2) + np.uint64(1)
    seen: set[tuple] = set()
    kept = []
    for k, (x, y) in enumerate(zip(rows, toxic, strict=True)):
        if len(x):
            low = [int(mix(x.astype("u8") * salt).min()) for salt in salts]
            keys = [(bool(y), j, *low[3 * j : 3 * j + 3]) for j in range(6)]
            if not seen.isdisjoint(keys):
                continue
            seen.update(keys)
        kept.append(k)
    return np.array(kept, "i8")


def mine_voters(rows: list[np.ndarray], toxic: np.ndarray, least: int = 5, lift: float = 40.0, sure: float = 4.0) -> np.ndarray:
    """For each feature the voters it belongs to, as bits: features at least lift times as frequent in
    toxic rows, and surely (in standard errors of the log odds) more frequent."""
    voters = np.zeros(1 << BITS, "i4")
    if toxic.any() and not toxic.all():
        count = np.zeros((2, 1 << BITS))
        for x, y in zip(rows, toxic, strict=True):
            count[int(y), x] += 1
        rate = (count + 0.5) / (np.array([[(~toxic).sum()], [toxic.sum()]]) + 1)
        error = np.sqrt(1 / (count[0] + 0.5) + 1 / (count[1] + 0.5))
        found = np.flatnonzero((count[1] >= least) & (rate[1] >= lift * rate[0]) & (np.log(rate[1] / rate[0]) >= sure * np.minimum(error, 1.0)))
        order = found[np.lexsort((found, -count[1][found] * np.log(rate[1] / rate[0])[found]))]
        voters[order] |= 1 << (np.arange(len(order)) % LEXICONS)
    fixed = Words(*join([" ".join(INSULTS)]), lower=True, separators=NOT_ALNUM).hashes * _MULTIPLY >> np.uint64(64 - BITS)
    voters[fixed.astype("i8")] |= 1 << LEXICONS
    return voters


def vote(x: np.ndarray, voters: np.ndarray) -> int:
    """The votes of all voters on one row's features, as bits."""
    own = voters[x]
    own = own[own > 0]
    if not len(own):
        return 0
    return int(np.bitwise_or.reduce(own)) | (len(own) >= 2) << (LEXICONS + 1) | (len(own) >= 4) << (LEXICONS + 2)


class LabelModel:
    """P(toxic | votes) from counts of vote patterns, with groups of correlated voters."""

    def __init__(self, voters: int = VOTERS, prior: float = 0.1):
        self.voters, self.prior = voters, prior
        self.groups = [(j,) for j in range(voters)]
        self.tables: list[np.ndarray] = []

    def _cells(self, patterns: np.ndarray) -> list[np.ndarray]:
        return [sum(((patterns >> j & 1) << k for k, j in enumerate(g)), np.zeros(len(patterns), "i8")) for g in self.groups]

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        odds = np.full(len(patterns), np.log(self.prior / (1 - self.prior)))
        for table, cell in zip(self.tables, self._cells(patterns), strict=True):
            odds += np.log(table[1, cell]) - np.log(table[0, cell])
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))

    def _em(self, patterns: np.ndarray, counts: np.ndarray, q: np.ndarray, rounds: int = 60) -> np.ndarray:
        cells = self._cells(patterns)
        for _ in range(rounds):
            self.prior = float(np.clip((q * counts).sum() / counts.sum(), 1e-4, 0.5))
            self.tables = []
            for g, cell in zip(self.groups, cells, strict=True):
                t = np.stack([np.bincount(cell, weights=counts * p, minlength=1 << len(g)) for p in (1 - q, q)]) + 1.0
                self.tables.append(t / t.sum(axis=1, keepdims=True))
            q = self.posterior(patterns)
        return q

    def fit(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, least: float = 0.1, largest: int = 3) -> LabelModel:
        """Pairs correlated beyond the starting labels are joined, strongest first, then all is fitted by EM.

        Correlations come first: else EM takes the agreement of two copies of a voter for the label.
        """
        self._em(patterns, counts, start, 1)
        total, bits = counts.sum(), [(patterns >> j & 1).astype(float) for j in range(self.voters)]
        excess = []
        for i, j in combinations(range(self.voters), 2):
            both = (counts * bits[i] * bits[j]).sum() / total
            expected = sum(p * self.tables[i][y, 1] * self.tables[j][y, 1] for y, p in ((0, 1 - self.prior), (1, self.prior)))
            si, sj = ((counts * b).sum() / total for b in (bits[i], bits[j]))
            scale = np.sqrt(max(si * (1 - si) * sj * (1 - sj), 1e-9))
            excess.append((abs(both - expected) / scale, i, j))
        for size, i, j in sorted(excess, reverse=True):
            a, b = (next(g for g in self.groups if k in g) for k in (i, j))
            if size >= least and a != b and len(a) + len(b) <= largest:
                self.groups = [g for g in self.groups if g not in (a, b)] + [a + b]
        self._em(patterns, counts, start)
        return self


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[x].sum(dtype="f8"), -30, 30))))


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.astype("<i4").tobytes() for x in _slices(batch.column(1))], pa.binary())], names=["toxic", "features"])


def _patterns(voters: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << VOTERS, "i8")
        for batch in batches:
            seen += np.bincount([vote(x, voters) for x in _slices(batch.column(0))], minlength=1 << VOTERS)
        index = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(index.astype("i4")), pa.array(seen[index])], names=["pattern", "docs"])

    return run


def _training_features(voters: np.ndarray, shares: tuple[int, int]):
    """Of rows (h, text) those whose h is within the share of rows without or with a vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, raw = [], []
            for h, x in zip(batch.column(0).to_pylist(), _slices(batch.column(1)), strict=True):
                p = vote(x, voters)
                if h <= shares[p > 0]:
                    pattern.append(p)
                    raw.append(x.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), pa.array(raw, pa.binary())], names=["pattern", "features"])

    return run


def _hash(salt: str):
    """62 bits of an id's hash; a null id's is null."""
    return F.when(F.col("doc_id").isNotNull(), F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(salt)), 2))


def _collected(df: DataFrame, key: str) -> list[tuple[int, np.ndarray]]:
    """(key, features) in an order that depends on the rows alone."""
    found = sorted(((r[key], r["features"]) for r in df.toArrow().to_pylist()))
    np.random.default_rng(0).shuffle(found)
    return [(k, np.frombuffer(f, "<i4")) for k, f in found]


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED_ROWS, epochs: int = 3, may_learn=None, max_training: int = MAX_TRAINING_ROWS) -> ToxicityModel:
    """A model from docs (doc_id, text) and labels (doc_id, toxic) that may be learned from.

    Votes are counted over all docs; may_learn (a column, null as false) says whose texts may train the classifier.
    """
    labels = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    labels = labels.withColumn("h", _hash("sample"))
    sizes = {r["toxic"]: r["n"] for r in labels.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    share = {y: int(min(1.0, max_rows / 2 / n) * 2**62) for y, n in sizes.items()}
    # A sample of max_rows ids, with room for chance: small enough to broadcast.
    sample = labels.filter(F.col("h") <= F.when(F.col("toxic") > 0, share.get(1, 0)).otherwise(share.get(0, 0))).select("doc_id", "toxic").limit(max_rows + max_rows // 4)
    text = F.col("text").cast("string").alias("text")
    found = _collected(docs.select("doc_id", text).join(F.broadcast(sample), "doc_id").select("toxic", "text").mapInArrow(_sample_features, "toxic int, features binary"), "toxic")
    rows, toxic = [x for _, x in found], np.array([y > 0 for y, _ in found], bool)
    kept = distinct_rows(rows, toxic)
    voters = mine_voters([rows[k] for k in kept], toxic[kept])
    seen = docs.select(text).mapInArrow(_patterns(voters), "pattern int, docs long").groupBy("pattern").agg(F.sum("docs").alias("docs")).toPandas()
    patterns, counts = seen.pattern.to_numpy("i8"), seen.docs.to_numpy("f8")
    hits = np.array([bin(p).count("1") for p in patterns.tolist()])
    prior = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes.get(1) and sizes.get(0) else 0.1
    model = LabelModel(prior=prior)
    if len(patterns):
        model.fit(patterns, counts, np.where(hits >= 1, 0.9, 0.02))
    # Half of the training rows have a vote, as far as there are so many.
    n = [float(counts[hits == 0].sum()), float(counts[hits > 0].sum())]
    shares = tuple(int(min(1.0, max_training / 2 / max(1.0, x)) * 2**62) for x in n)
    allowed = F.coalesce(F.lit(True) if may_learn is None else may_learn, F.lit(False))
    near = docs.select(_hash("train").alias("h"), text, allowed.alias("a")).filter(F.col("a") & (F.col("h") <= max(shares))).select("h", "text")
    train = _collected(near.mapInArrow(_training_features(voters, shares), "pattern int, features binary").limit(max_training + max_training // 4), "pattern")
    kept = distinct_rows([x for _, x in train], np.array([p > 0 for p, _ in train], bool))
    train = [train[k] for k in kept]
    q = model.posterior(np.array([p for p, _ in train], "i8")) if train and len(patterns) else np.zeros(0)
    classifier, bias_at = Ftrl((1 << BITS) + 1, 1 + 1, alpha=1.0, l1=4.0, l2=0.01), 1 << BITS
    support = np.zeros(1 << BITS, "i4")
    for _, x in train:
        support[x] += 1
    for _ in range(epochs):
        for (_, x), p in zip(train, q, strict=False):
            index = np.append(x[support[x] >= 5], bias_at)
            classifier.update(index, np.ones(len(index)), np.array([1 - p, p]))
    w = classifier.weights
    weights, bias = (w[1] - w[0])[:bias_at], float(w[1, bias_at] - w[0, bias_at])
    if not len(q) or not (toxic.any() and not toxic.all()):  # no labels to learn from: the fixed list decides
        weights, bias = np.where(voters >> LEXICONS & 1, 4.0, 0.0), -3.0
    return ToxicityModel(weights.astype("f4"), bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs' columns with toxicity, the score of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model.score(x) for x in _slices(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "toxicity"])

    docs = docs.drop("toxicity").withColumn("text", F.col("text").cast("string"))
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields]
    return docs.mapInArrow(run, ", ".join([*fields, "toxicity double"]))


def held_out(folds: int = 5, held_fold: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(True))


def learnable(labels: DataFrame, folds: int = 5, held_fold: int = 0) -> DataFrame:
    """The labels outside the held fold."""
    return labels.filter(~held_out(folds, held_fold)).select("doc_id", "toxic")


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_fold: int = 0, max_rows: int = MAX_LABELLED_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = fit(docs.select("doc_id", "text"), learnable(labels, folds, held_fold), max_rows, may_learn=~held_out(folds, held_fold))
    out = score(docs.select("doc_id", held_out(folds, held_fold).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
