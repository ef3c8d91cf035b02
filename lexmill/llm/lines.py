"""Operator 5: line dedup over levelled sorted runs of line hashes.

The runs are an LSM-like store of tables, bucketed and sorted by hash, all alike, so that joining them
moves none of their rows.  Each batch of documents counts its line hashes, merge-anti-joins them with
the settled runs, whose lines are in enough documents already and need no more counting, and adds what
is left as a run of its own on level 0.  When a level has ``fanout`` runs, they are compacted into one
of the next level, and hashes that have reached ``min_docs`` documents there become a settled run.
After the last batch one compaction over all levels settles the rest; then lines lose those whose key
is settled.

Edge cases: a null or empty text is one empty line; keys under ``min_chars`` code points never count;
each row counts as a document, also where ids repeat or are null; texts of any length count whole; equal
rows are treated alike; an empty table gives an empty result; other columns pass through, but for
kept_text, n_lines and n_dropped, which the operator's replace.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import delete, discard, fields_of, materialise, packed, scratch_path

#: Stripped at both ends of a line: \x20 and \x09 to \x0d.
SPACE = b" \t\n\x0b\x0c\r"
_RUN = "h1 long, h2 long, docs long"
_KEYS = "t1 long, t2 long, pos int, h1 long, h2 long, once boolean"


class LineRuns:
    """Sorted runs by level, and settled ones; the driver holds their names only."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 3):
        self._spark, self._min, self._fanout = spark, min_docs, fanout
        self._buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels, self.settled, self._paths = [[]], [], {}

    def _write(self, counts: DataFrame, what: str) -> str:
        """A run: counts, dealt and sorted by hash, each bucket by one task."""
        path = scratch_path(self._spark, what)
        name = "lexmill_" + path.rsplit("-", 1)[1]
        rows = counts.repartition(self._buckets, "h1", "h2")
        rows.write.bucketBy(self._buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("compression", "zstd").option("path", path).saveAsTable(name)
        self._paths[name] = path
        return name

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self._spark.sql(f"DROP TABLE IF EXISTS {name}")
            delete(self._spark, self._paths.pop(name))

    def _read(self, names: list[str]) -> DataFrame:
        out = self._spark.createDataFrame([], _RUN) if not names else self._spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self._spark.table(name))
        return out

    def add(self, keys: DataFrame) -> None:
        """One more run from (h1, h2) rows, one for each document and key; full levels are compacted."""
        fresh = keys.groupBy("h1", "h2").agg(F.count("*").alias("docs"))
        for name in self.settled:
            fresh = fresh.join(self._spark.table(name).hint("merge"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._settle(self._write(fresh, "run")))
        level = 0
        while len(self.levels[level]) >= self._fanout:
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._compact(self.levels[level]))
            self.levels[level], level = [], level + 1

    def _settle(self, name: str) -> str:
        """What has come to min_docs in a run is copied to a settled one; wherever runs are read it counts no more."""
        due = self._spark.table(name).filter(F.col("docs") >= self._min)
        if not due.isEmpty():
            self.settled.append(self._write(due, "settled"))
        return name

    def _compact(self, names: list[str]) -> str:
        merged = self._write(self._read(names).filter(F.col("docs") < self._min).groupBy("h1", "h2").agg(F.sum("docs").alias("docs")), "run")
        self._drop(names)
        return self._settle(merged)

    def keys(self) -> DataFrame:
        """(h1, h2) of the lines in at least min_docs documents, as a scratch table; the store is gone then."""
        rest = self._read([n for level in self.levels for n in level]).filter(F.col("docs") < self._min).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))
        due = rest.filter(F.col("docs") >= self._min).select("h1", "h2")
        out = materialise(due.unionByName(self._read(self.settled).select("h1", "h2")).distinct(), "frequent")
        self._drop([*self._paths])
        self.levels, self.settled = [[]], []
        return out


def _with_text_hash(docs: DataFrame) -> DataFrame:
    text = F.coalesce("_text", F.lit(""))
    return docs.select("_row", text.alias("_text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("2"), text).alias("t2"))


def _hash_lines(min_chars: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            counts, pos, raw, once = [], [], [], []
            for text in batch.column(2):
                keys = [line.strip(SPACE) for line in text.as_py().encode().lower().split(b"\n")]
                own = [k for k, key in enumerate(keys) if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)]
                seen: set[bytes] = set()
                for k in own:
                    raw.append(h := digest(keys[k]))
                    once.append(h not in seen)
                    seen.add(h)
                counts.append(len(own))
                pos += own
            h = np.frombuffer(b"".join(raw), "<i8").reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array(pos, pa.int32()), pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(once, pa.bool_())], names=["t1", "t2", "pos", "h1", "h2", "once"])

    return hashes


def line_keys(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row for each line of each packed document: text hash, position, key hash, whether first of its key there."""
    return _with_text_hash(docs).select("t1", "t2", "_text").mapInArrow(_hash_lines(min_chars), _KEYS)


def _drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, total, gone = [], [], []
        for text, drops in zip(batch.column("_text"), batch.column("_drops"), strict=True):
            text, drops = text.as_py(), drops.as_py()
            lines = text.split("\n")
            total.append(len(lines))
            gone.append(len(drops or ()))
            if drops:
                dropped = set(drops)
                text = "\n".join([x for k, x in enumerate(lines) if k not in dropped])
            texts.append(text)
        kept = [k for k, name in enumerate(batch.schema.names) if name not in ("_text", "_drops")]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=[*(batch.schema.names[k] for k in kept), "kept_text", "n_lines", "n_dropped"])


def drop_frequent_lines(docs: DataFrame, keys: DataFrame, frequent: DataFrame) -> DataFrame:
    """Packed docs' columns with kept_text, n_lines, n_dropped; keys are their line_keys, frequent the hashes to drop.

    Lines are found by their text's hash, so copies of a text share one list of positions.
    """
    hits = keys.select("t1", "t2", "pos", "h1", "h2").join(frequent, ["h1", "h2"], "left_semi")
    # Written, so that joins know their sizes: few hashes are broadcast, and a text with many copies is split.
    drops = materialise(hits.groupBy("t1", "t2").agg(F.collect_set("pos").alias("_drops")), "drops")
    joined = _with_text_hash(docs).join(drops, ["t1", "t2"], "left").drop("t1", "t2")
    out = joined.mapInArrow(_drop_lines, ", ".join([*fields_of(joined, ("_text", "_drops")), "kept_text string, n_lines long, n_dropped long"]))
    return out.select("_row.*", "kept_text", "n_lines", "n_dropped")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 3) -> DataFrame:
    """docs' columns but text, with kept_text, n_lines, n_dropped; documents come in as so many batches."""
    docs, runs = packed(docs, ("kept_text", "n_lines", "n_dropped")), LineRuns(docs.sparkSession, min_docs, fanout)
    keys = materialise(line_keys(docs, min_chars).withColumn("batch", F.pmod("t1", F.lit(batches)).cast("int")), "lines")
    for k in range(batches):
        runs.add(keys.filter((F.col("batch") == k) & F.col("once")).select("h1", "h2"))
    frequent = runs.keys()
    out = drop_frequent_lines(docs, keys, frequent)
    discard(keys, frequent)
    return out


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key
GROUP BY k.doc_id
"""
