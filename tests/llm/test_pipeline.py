"""The pipeline against plain versions of its stages."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexmill.llm import packing, queries, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(8), tmp_path_factory.mktemp("sf")
    vocabulary = [f"word{i}" for i in range(500)]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [text(20) for _ in range(4)]
    docs, labels = [], []
    for i in range(300):
        t = text(r.randint(30, 80))
        if i % 10 == 0:
            t = t.replace("word1", "grumbat", 3) + " idiot grumbat"
        if i % 7 == 0:
            t += "\nThe same footer."
        if i % 25 == 1:
            t = items[i % 4] + " " + t
        docs.append((i, t))
        if i % 2 == 0:
            labels.append((i, 1, int(i % 10 == 0)))
    docs += [(400 + i, docs[i][1]) for i in range(2, 9)] + [(500 + i, docs[i][1] + " more") for i in range(2, 9)] + [(600, None), (601, "")]
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), docs, items


def test_run_equals_plain_stages(spark, tables):
    folder, docs, items = tables
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(frame.select("doc_id", "text"), toxicity.learnable(spark.read.parquet(f"{folder}/labels.parquet")), may_learn=~toxicity.held_out())
    kept = [(d, t) for d, t in docs if model.score(next(toxicity.features([t]))) < 0.5]
    gone = {d for d, _ in docs} - {d for d, _ in kept}
    assert {d for d in gone if d < 300} >= {d for d in range(0, 300, 10)} and len(gone) < 45
    seen = Counter(k for _, t in kept for k in {x.strip().lower() for x in (t or "").split("\n")})
    kept = [(d, "\n".join(x for x in (t or "").split("\n") if x.strip() == "" or seen[x.strip().lower()] < 10)) for d, t in kept]

    def shingles(t):
        w = re.findall(r"\S+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}

    sets, parent = {d: shingles(t) for d, t in kept}, {d: d for d, _ in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = [(d, t) for d, t in kept if find(d) == d]
    kept = [(d, t) for d, t in kept if not any(x in t for x in items)]
    tokenizer, expected = packing.tokenizer_at(None), Counter()
    for d, t in kept:
        ids = np.append(np.frombuffer(tokenizer.ids(t), "<u4"), 0).astype("<u4")
        for k, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            expected[d, k, start, length, zlib.crc32(ids[start : start + length].tobytes())] += 1
    out = corpus_pipeline.run(spark, folder)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == expected


def test_stages_return_documents(spark, tables):
    folder, *_ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").isEmpty()
        assert out.filter(F.col("text").isNotNull() & (F.length("text") != F.col("n_chars"))).isEmpty()


def test_queries_are_registered():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(n) for n in range(1, 11)]
