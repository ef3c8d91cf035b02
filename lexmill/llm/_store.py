"""Written tables that cut lineage, in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths of scratch tables that nobody has discarded yet.
_live: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; a session in one process (tests) that names none gets a local one, any other an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lexmill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; what isn't discarded before goes when the driver ends."""
    path = f"{scratch_root(spark)}/lexmill-{tag}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def materialise(df: DataFrame, tag: str, own: bool = True) -> DataFrame:
    """Write df as Parquet and read it back: a lost executor costs a re-read, not a recomputation.

    With own=False the table outlives discard_all.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    if own:
        _live.add(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    _live.discard(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialise that nothing will read any more."""
    for t in tables:
        delete(t.sparkSession, t.scratch)


def discard_all(spark: SparkSession) -> None:
    """Deletes every scratch table: only for a caller who has written all results that read them."""
    for path in list(_live):
        delete(spark, path)
    drop_finished_shuffles(spark)


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner see that plans of finished steps are gone, so that it deletes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def packed(docs: DataFrame, new: tuple[str, ...]) -> DataFrame:
    """docs as _row (all columns but text, and but those that an operator adds) and _text: no name of a
    caller's column can clash with an operator's own."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != "text" and c not in new]
    row = F.struct(*kept) if kept else F.struct(F.lit(None).cast("string").alias("_none"))
    return docs.select(row.alias("_row"), F.col("text").cast("string").alias("_text"))


def fields_of(df: DataFrame, leave: tuple[str, ...] = ()) -> list[str]:
    """DDL of df's columns, for the schema of a mapInArrow."""
    return [f"`{x.name}` {x.dataType.simpleString()}" for x in df.schema.fields if x.name not in leave]
