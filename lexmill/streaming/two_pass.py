"""Two passes over a stream of documents; with the same seeds, the facts equal those of a batch run over the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import render
from ..plans.pipeline import Options, extract_statements, name_concepts, refine, resolve_seeds
from ..sources.readers import read_table

DOCUMENTS = "doc_id long, source string, text string"
SEEDS = "seed_idx int, seed string"


def stream_facts(spark: SparkSession, source: str, out: str, checkpoint: str, options: Options, seeds: DataFrame | None = None, files_per_trigger: int = 1, schema: str = DOCUMENTS):
    """Starts a query that appends each micro-batch's facts to out/facts.  A replayed batch overwrites its own part.

    Without seeds but with options.seeder, the first micro-batch is the gate: seeds are derived from its
    statements before their second pass, written to out/seeds and used by all later ones.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)

    def seeds_of(statements: DataFrame) -> DataFrame | None:
        if seeds is not None or options.seeder is None:
            return seeds
        known = read_table(spark, f"{out}/seeds", SEEDS)
        if known is None:
            found, _ = resolve_seeds(statements, options.seeder)
            found = spark.createDataFrame([], SEEDS) if found is None else found
            found.coalesce(1).write.mode("overwrite").parquet(f"{out}/seeds")
            known = read_table(spark, f"{out}/seeds", SEEDS)
        return None if known.isEmpty() else known

    def one(batch: DataFrame, epoch: int) -> None:
        statements = extract_statements(batch.select("doc_id", "source", "text"), options)
        facts = name_concepts(statements, options, seeds_of(statements))
        facts.write.mode("overwrite").parquet(f"{out}/facts/epoch={epoch}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_pages(spark: SparkSession, out: str, options: Options) -> DataFrame:
    """title, concept, markdown of all facts so far, written to out/pages: merges need all labels, so pages are
    made over the whole table whenever they are wanted."""
    facts = spark.read.parquet(f"{out}/facts").drop("epoch")
    render.wiki_pages(refine(facts, options), options.antonyms).write.mode("overwrite").parquet(f"{out}/pages")
    return spark.read.parquet(f"{out}/pages")
