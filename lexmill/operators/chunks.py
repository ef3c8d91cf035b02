"""Documents to sentences and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, sentences, words

MIN_WORDS, MAX_WORDS = 800, 1200


def explode_sentences(docs: DataFrame, text: str = "text", least: int = 0) -> DataFrame:
    """A row for each sentence over so many characters; sent_idx counts all of a document's sentences from 0."""
    kept = [c for c in docs.columns if c != text]
    out = docs.select(*kept, F.posexplode(sentences(F.col(text))).alias("sent_idx", "sentence"))
    return out.filter(F.length("sentence") > least) if least else out


def packed_chunks(text: Column, least: int = MIN_WORDS, most: int = MAX_WORDS) -> Column:
    """array<struct<text, n_words, fallback>>: sentences packed greedily.

    A chunk ends where it has the least words and the next sentence would take it over the most.  A
    sentence over the most ends the chunk before it and is cut into parts of that many words.
    """
    empty = F.array().cast("array<struct<text:string,n_words:int,fallback:boolean>>")
    chunk = lambda s, n, f: F.struct(F.array_join(s, " ").alias("text"), n.cast("int").alias("n_words"), F.lit(f).alias("fallback"))
    none = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), none.alias("open"), F.lit(0).alias("n"))

    def flushed(a: Column) -> Column:
        return F.when(F.size(a["open"]) > 0, F.array_append(a["done"], chunk(a["open"], a["n"], False))).otherwise(a["done"])

    def step(a: Column, s: Column) -> Column:
        def with_words(w: Column) -> Column:
            n = F.size(w)
            parts = F.transform(F.sequence(F.lit(0), n - 1, F.lit(most)), lambda i: let(F.slice(w, i + 1, most), lambda p: chunk(p, F.size(p), True)))
            full = (F.size(a["open"]) > 0) & (a["n"] >= least) & (a["n"] + n > most)
            return (
                F.when(n > most, F.struct(F.concat(flushed(a), parts).alias("done"), none.alias("open"), F.lit(0).alias("n")))
                .when(full, F.struct(flushed(a).alias("done"), F.array(s).alias("open"), n.alias("n")))
                .otherwise(F.struct(a["done"].alias("done"), F.array_append(a["open"], s).alias("open"), (a["n"] + n).alias("n")))
            )

        return let(words(s), with_words)

    return F.aggregate(sentences(text), start, step, flushed)


def chunk_documents(docs: DataFrame, least: int = MIN_WORDS, most: int = MAX_WORDS, limit: int = 0) -> DataFrame:
    """chunk_id, chunk_seq, text, source, chapter, n_words, fallback of documents (source, doc_id, text).

    Ids are hashes of source, document and position, so that a rerun gives the same.
    """
    least, most = max(1, least), max(least, most, 1)
    out = docs.select("doc_id", "source", F.posexplode(packed_chunks(F.coalesce("text", F.lit("")), least, most)).alias("chunk_seq", "c"))
    if limit > 0:
        out = out.orderBy("source", "doc_id", "chunk_seq").limit(limit)
    name = F.sha2(F.concat_ws("|", "source", "doc_id", "chunk_seq"), 256)
    return out.select(name.alias("chunk_id"), "doc_id", "chunk_seq", "c.text", "source", F.lit(None).cast("string").alias("chapter"), "c.n_words", "c.fallback")


def batches(rows: DataFrame, size: int, order: list[str], within: list[str]) -> DataFrame:
    """A batch_id for each `size` rows within the given columns, in order."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*within).orderBy(*order))
    return rows.withColumn("batch_id", F.floor((place - 1) / max(1, size)).cast("long"))
