"""A corpus pipeline over documents: each stage works on all that its predecessor kept.

Stages: toxic documents go; lines found in many documents go; one document of each group of near
copies stays; documents with a benchmark item in them go; the rest is packed into training sequences.
Every stage but the last returns the columns of documents (text, and n_chars with it, as they are
after the stage).  A stage's result is written as Parquet and read again as the next one's input: a stage first deletes the
scratch tables of the stages before it, so a result must be written before the next stage is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontamination, jaccard, lines, packing, toxicity
from lexmill.llm._store import delete, discard_all, materialise
from lexmill.session import share_source

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document is toxic from this score on; near copies have this share of five-word shingles in common.
TOXIC = 0.5
SHINGLE, NUM, DEN = 5, 80, 100


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents under the score; learns from labels outside the held fold."""
    labels = toxicity.learnable(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels, may_learn=~toxicity.held_out())
    return toxicity.score(docs, model).filter(F.col("toxicity") < TOXIC).select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that are in ten or more documents; documents stay, if need be empty."""
    discard_all(spark)
    out = lines.dedup_lines(docs, min_docs=10, min_chars=1)
    changed = F.col("n_dropped") > 0
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.when(changed, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of near copies the row of the smallest doc_id; texts without words stay, and
    rows that repeat a kept id."""
    discard_all(spark)
    classed = jaccard.similarity_components(docs.select("doc_id", "text"), SHINGLE, NUM, DEN)
    keep = (F.col("n_shingles") == 0) | (F.col("doc_id") == F.col("component_id"))
    # The ids that go are the smaller side, so texts are shuffled only where these are too many to broadcast;
    # rows without an id match none of them and stay.
    gone = materialise(classed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(keep).alias("keep")).filter("NOT keep").select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, with up to a fifth of its words edited."""
    discard_all(spark)
    found = decontamination.find_contamination(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document: its ids' place in the sequences of 2048 tokens."""
    discard_all(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_near_copies),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", pack),
]
#: SQL can express neither the trained model nor the tokenizer; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; every stage's rows are written and read again."""
    share_source(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs, f"stage{k}", own=False)
            if last:
                delete(spark, last)
            last = docs.scratch
    return docs
