"""Operator 3: language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3 code points of the lower-cased text,
with everything but letters as one kind of space).  Document frequencies cover all training documents;
the weights are trained by FTRL with an elastic net on a bounded sample of them, and a temperature
fitted on a part held back from training calibrates the scores.

Every language of the training documents is learned, however many there are: the model has a row of
weights for each, over the n-grams that the L1 penalty leaves.

Edge cases: a null text or one without letters is ``und`` with score 0; null languages aren't learned
from, nor are rows whose id is null (they count as held out); without any training row everything is
``und``; equal scores go to the first language by name; a text of any length counts whole; rows with
equal ids stay rows of their own; other columns pass through, but for lang_pred and score, which the
operator's replace; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linear import Ftrl, softmax, temperature

BITS = 16
#: Rows that training may use, over all languages; with more languages than that, one row of each.
MAX_TRAINING_ROWS = 4000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


@functools.lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature, count) of a text's n-grams; None if it has no letter."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[code]
    if not letter.any():
        return None
    # Runs of other characters become one space; the text is framed by spaces.
    code = np.where(letter, code, 32)
    first = np.append(True, letter[:-1]) if len(letter) > 1 else np.array([True])
    code = np.concatenate([[32], code[letter | first], [32]]).astype("u8")
    two = code[:-1] * _M1 + code[1:]
    three = two[:-1] * _M2 + code[2:]
    shift = np.uint64(64 - BITS)
    h = np.concatenate([(code * _M2) >> shift, (two * _M2) >> shift, ((three ^ (three >> np.uint64(29))) * _M1) >> shift])
    count = np.bincount(h.astype("i8"), minlength=1 << BITS)
    index = np.flatnonzero(count)
    return index, count[index]


def _vector(found: tuple[np.ndarray, np.ndarray], idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(found[1])) * idf[found[0]]
    norm = np.sqrt(value @ value)
    return value / norm if norm else value


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen, rows = np.zeros(1 << BITS, "i8"), 0
    for batch in batches:
        for text in batch.column(0):
            if (found := ngrams(text.as_py() or "")) is not None:
                seen[found[0]] += 1
                rows += 1
    index = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(index, -1).astype("i4")), pa.array(np.append(seen[index], rows))], names=["feature", "docs"])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [ngrams(t.as_py() or "") for t in batch.column(1)]
        kept = [k for k, f in enumerate(found) if f is not None]
        own = [found[k] for k in kept]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([f[0].astype("<u2").tobytes() for f in own], pa.binary()), pa.array([f[1].astype("<f4").tobytes() for f in own], pa.binary())], names=["lang", "feature", "count"])


class LanguageModel:
    """weights has a column for each feature that any language has a weight for; column says which (the last, of zeros, for none)."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, heat: float):
        self.languages, self.idf, self.bias, self.heat = languages, idf, bias, heat
        used = np.flatnonzero(weights.any(axis=0))
        self.column = np.full(weights.shape[1], len(used), "i4")
        self.column[used] = np.arange(len(used))
        self.weights = np.concatenate([weights[:, used], np.zeros((len(weights), 1), weights.dtype)], axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or (found := ngrams(text or "")) is None:
            return "und", 0.0
        p = softmax((self.weights[:, self.column[found[0]]] @ _vector(found, self.idf) + self.bias) / self.heat)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def fit(train: DataFrame, key: Column, max_rows: int = MAX_TRAINING_ROWS, epochs: int = 3) -> LanguageModel:
    """A model from train's text and lang; key is a column whose hash picks the sample."""
    train = train.filter(F.col("lang").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.xxhash64(key, F.lit("sample")).alias("h"))
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 1.0)
    df = train.select("text").mapInArrow(_document_counts, "feature int, docs long").groupBy("feature").agg(F.sum("docs").alias("docs")).toPandas()
    rows = int(df.docs[df.feature == -1].sum())
    idf = np.full(1 << BITS, np.log(1 + rows))
    own = df[df.feature >= 0]
    idf[own.feature] = np.log((1 + rows) / (1 + own.docs))+ 1e-3
    # So many rows of each language, chosen by hash; of a rare one all, so that it has one at least.
    share = max(1, max_rows // len(languages))
    limits = [(lang, int(min(1.0, max(2 * share, 20) / n) * 2**62) if n > max(2 * share, 20) else 2**63 - 1) for lang, n in sizes.items()]
    table = F.broadcast(train.sparkSession.createDataFrame(limits, "lang string, most long"))  # a row for each language
    near = train.withColumn("h", F.abs(F.shiftright("h", 1))).join(table, "lang").filter(F.col("h") <= F.col("most"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    near = near.withColumn("place", place).filter(F.col("place") <= share)
    sample = near.select("lang", "text").mapInArrow(_features, "lang string, feature binary, count binary").toArrow().to_pylist()
    sample.sort(key=lambda r: (r["lang"], r["feature"], r["count"]))
    np.random.default_rng(0).shuffle(sample)
    number = {lang: k for k, lang in enumerate(languages)}
    bias_at = 1 << BITS
    data = []
    for r in sample:
        found = np.frombuffer(r["feature"], "<u2").astype("i8"), np.frombuffer(r["count"], "<f4")
        data.append((np.append(found[0], bias_at), np.append(_vector(found, idf), 1.0), np.eye(len(languages))[number[r["lang"]]]))
    held = data[::5] if len(data) >= 50 else []
    model = Ftrl((1 << BITS) + 1, len(languages), alpha=2.0, l1=1e-3, l2=1e-3)
    for _ in range(epochs):
        for k, row in enumerate(data):
            if not held or k % 5:
                model.update(*row)
    w = model.weights
    logits = np.array([w[:, i] @ v for i, v, _ in held])
    heat = temperature(logits, np.array([t for *_, t in held])) if held else 1.0
    return LanguageModel(languages, idf.astype("f4"), w[:, :bias_at].astype("f4"), w[:, bias_at].astype("f4"), heat)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs' columns but text, with lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column("_text")]
            kept = [k for k, name in enumerate(batch.schema.names) if name != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], names=[*(batch.schema.names[k] for k in kept), "lang_pred", "score"])

    docs = docs.drop("lang_pred", "score").withColumn("_text", F.col("text").cast("string")).drop("text")
    fields = [f"`{x.name}` {x.dataType.simpleString()}" for x in docs.schema.fields if x.name != "_text"]
    return docs.mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))


def identify_languages(docs: DataFrame, folds: int = 4, held_fold: int = 2, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from rows whose crc32(doc_id) isn't in the held fold."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == held_fold, F.lit(True))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(docs.filter(~F.col("held_out")), F.col("doc_id"), max_rows)
    return predict(docs.select("doc_id", "text", "held_out"), model)
