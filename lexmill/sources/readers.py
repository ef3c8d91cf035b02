"""Documents, seeds, vaults and stored results as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_unicode, safe_filename, strip


def read_documents(spark: SparkSession, path: str, kind: str = "text") -> DataFrame:
    """doc_id, source, text of whole text files, or of PDFs where a library for them is installed."""
    if kind == "text":
        raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("text"))
    else:
        files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("source"), "content")

        def extract(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import io

            from pypdf import PdfReader  # an optional library

            for f in frames:
                f["text"] = ["\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages) for b in f.pop("content")]
                yield f

        raw = files.mapInPandas(extract, "source string, text string")
    return raw.select(F.xxhash64("source").alias("doc_id"), "source", fold_unicode(F.col("text")).alias("text"))


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """seed_idx, seed of a JSON file: an array of names, or an object with "concepts"."""
    raw = spark.read.text(path, wholetext=True)
    names = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.concepts"), "array<string>"))
    rows = raw.select(F.posexplode(F.filter(F.transform(names, strip), lambda s: s.isNotNull() & (s != ""))).alias("seed_idx", "seed"))
    if rows.isEmpty():
        raise ValueError(f"no seeds in {path}")
    return rows


def read_antonyms(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Pairs of exactly two words of a seed file's "antonyms", lower-cased and trimmed: a small table by its nature."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json(F.get_json_object("value", "$.antonyms"), "array<array<string>>").alias("p"))
    rows = raw.select(F.explode("p").alias("p")).filter(F.size("p") == 2).select(F.lower(strip(F.col("p")[0])).alias("a"), F.lower(strip(F.col("p")[1])).alias("b"))
    return [(r["a"], r["b"]) for r in rows.collect()]


def read_vault(spark: SparkSession, path: str, unsynthesized: bool = False) -> DataFrame:
    """title, backend, markdown of a folder of Markdown pages; optionally only those no model has written."""
    raw = spark.read.text(f"{path}/*.md", wholetext=True).withColumnRenamed("value", "markdown")
    stem = F.regexp_replace("_metadata.file_name", r"\.md$", "")
    heading = strip(F.regexp_extract("markdown", r"(?m)^# (.+)$", 1))
    backend = strip(F.regexp_extract("markdown", r"(?m)^generated_by_backend:\s*(\S+)", 1))
    rows = raw.select(F.when(heading != "", heading).otherwise(stem).alias("title"), F.when(backend != "", backend).otherwise("unknown").alias("backend"), "markdown")
    return rows.filter(~F.col("markdown").contains("generated_by_backend:")) if unsynthesized else rows


def page_facts(vault: DataFrame, plain: int = 2) -> DataFrame:
    """title, position, content: labelled facts, bullets and the first plain lines of each page's body."""
    body = F.regexp_replace("markdown", r"(?s)^.*?\n---\n", "")
    body = F.regexp_replace(body, r"(?s)\n## (?:Related Concepts|See Also)\b.*$", "")
    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda s: s != "")
    labelled = F.transform(F.filter(lines, lambda s: s.rlike(r"(?i)^fact\s+\w+\.?:")), lambda s: F.regexp_replace(s, r"(?i)^fact\s+\w+\.?:\s*", ""))
    bullets = F.transform(F.filter(lines, lambda s: s.rlike(r"^[-*]\s+")), lambda s: F.regexp_replace(s, r"^[-*]\s+", ""))
    prose = F.slice(F.filter(lines, lambda s: ~s.rlike(r"(?i)^(?:[-*#>`\[|]|fact\s+\w+\.?:)")), 1, plain)
    return vault.select("title", F.posexplode(F.concat(labelled, bullets, prose)).alias("position", "content"))


def write_vault(pages: DataFrame, path: str) -> int:
    """Writes <title>.md files with Hadoop's file system, so to any store; equal file names keep the first
    title and the others get a number.  Pages stream through the driver one partition at a time, as a
    vault is a folder for people; large results are better written as a table.  Returns the number of pages."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("file").orderBy("title"))
    rows = pages.select("title", safe_filename(F.col("title")).alias("file"), "markdown").withColumn("n", place)
    named = rows.select(F.when(F.col("n") == 1, F.col("file")).otherwise(F.concat_ws(" ", "file", "n")).alias("file"), "markdown")
    spark, n = pages.sparkSession, 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    system = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in named.toLocalIterator():
        out = system.create(hadoop(f"{path}/{row['file']}.md"), True)
        out.write(bytearray(row["markdown"], "utf-8"))
        out.close()
        n += 1
    return n


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A written table, or None if there is none."""
    try:
        spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None
    return spark.read.schema(schema).parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """name, canonical of earlier answers; empty if there is none."""
    try:
        return spark.read.parquet(path).select("name", "canonical")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "name string, canonical string")


def update_cache(cache: DataFrame, answers: DataFrame, path: str) -> None:
    """Appends answers for names that cache doesn't hold, so each name is there once however often this is
    called; failures (null) aren't kept, so they are asked again."""
    fresh = answers.filter(F.col("canonical").isNotNull()).groupBy("name").agg(F.min("canonical").alias("canonical"))
    fresh.join(cache.select("name"), "name", "left_anti").write.mode("append").parquet(path)


def save_evaluation(evaluation: DataFrame, path: str) -> None:
    evaluation.withColumn("saved_at", F.current_timestamp()).write.mode("append").parquet(path)


def last_evaluation(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path).orderBy(F.desc("saved_at")).limit(1).drop("saved_at")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
