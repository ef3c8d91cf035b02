"""Operators over relations: invariants, order rules, and streaming against batch."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.operators import chunks, evaluate, facts, merge, related, render
from lexmill.plans import config, models, pipeline
from lexmill.sources import readers
from lexmill.streaming import two_pass

FACTS = "fact_id string, fact_seq long, concept string, content string, source_chunk_id string"


def labels(spark, rows):
    return spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(rows)], "concept string, concept_seq long, n_facts long")


def mapping(df):
    return {r["concept"]: r["merged"] for r in df.collect()}


def plain_chunks(text, least, most):
    out, run, n = [], [], 0
    for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()):
        w = s.split()
        if len(w) > most:
            out += [" ".join(run)] * bool(run) + [" ".join(w[i : i + most]) for i in range(0, len(w), most)]
            run, n = [], 0
            continue
        if run and n >= least and n + len(w) > most:
            out.append(" ".join(run))
            run, n = [], 0
        run.append(s)
        n += len(w)
    return out + [" ".join(run)] * bool(run)


def test_chunks_pack_greedily(spark):
    texts = ["", "One two three.", " ".join(f"w{i} and more words." for i in range(40)), "a " * 95 + "end. Short one.", "x y z. " * 9 + "q " * 30 + ". t u."]
    docs = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    out = chunks.chunk_documents(docs, 15, 25).orderBy("doc_id", "chunk_seq").collect()
    for i, t in enumerate(texts):
        assert [r["text"] for r in out if r["doc_id"] == i] == plain_chunks(t, 15, 25)
    assert all(r["n_words"] == len(r["text"].split()) for r in out) and len({r["chunk_id"] for r in out}) == len(out)


def test_exact_fold_counts_what_is_gathered(spark):
    rows = [("Order Book", 3), ("order-books", 2), ("ORDER BOOKS", 5)]
    # 3 + 2 facts are gathered before the third comes with as many, and it isn't shorter.
    assert set(mapping(merge.exact_duplicates(labels(spark, rows))).values()) == {"Order Book"}
    assert set(mapping(merge.exact_duplicates(labels(spark, [*rows[:2], ("ORDER BOOKS", 6)]))).values()) == {"ORDER BOOKS"}


def test_compact_and_metric_families(spark):
    assert set(mapping(merge.compact_duplicates(labels(spark, [("Inventoryturnover", 1), ("Inventory Turnover", 1)]))).values()) == {"Inventory Turnover"}
    out = mapping(merge.metric_families(labels(spark, [("Debt", 9), ("Debt Ratio", 1), ("First Last", 1), ("First Last Rate", 1)])))
    assert out["Debt"] == "Debt Ratio" and out["First Last"] != out["First Last Rate"]


def test_greedy_merge_is_ordered_and_respects_opposites(spark):
    rows = [("Net Cash Flow", 2), ("Cash Flow Statement", 5), ("Gross Cash Flow", 1), ("Order Book", 1), ("Order Boon", 1)]
    out = mapping(merge.merge_labels(labels(spark, rows)))
    assert out["Net Cash Flow"] == out["Cash Flow Statement"] == "Cash Flow Statement"
    assert out["Gross Cash Flow"] == "Cash Flow Statement" and out["Order Boon"] == "Order Book"
    kept = mapping(merge.similar_labels(labels(spark, [("Net Cash Flow", 2), ("Gross Cash Flow", 1)])))
    assert kept["Net Cash Flow"] != kept["Gross Cash Flow"]


def test_merges_conserve_facts_at_any_partitioning(spark):
    rows = [(f"{a} {b}", 1 + (i % 3)) for i, (a, b) in enumerate((a, b) for a in ("cold", "old", "new", "bold") for b in ("bolt", "bolts", "Bolt ratio", "cover"))]
    seen = []
    for n in (1, 3, 8):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(mapping(merge.merge_labels(labels(spark, rows))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2] and set(seen[0]) == {c for c, _ in rows}
    total = Counter()
    for c, n in rows:
        total[seen[0][c]] += n
    assert sum(total.values()) == sum(n for _, n in rows)


def test_blocks_miss_no_similar_pair(spark):
    names = ["cold bolt", "old bolt", "cold boltt", "net cash flow", "cash flow statement", "a", "ab", "abc", "b", "x y z", "x y", "y z w"]
    rows = labels(spark, [(n, 1) for n in names])
    from lexmill.functions import pairs
    from lexmill.functions.text import match_tokens

    t = rows.select("concept", "concept_seq", match_tokens(F.col("concept")).alias("m"))
    every = t.alias("l").join(t.alias("r"), F.col("l.concept_seq") < F.col("r.concept_seq")).filter(pairs.are_similar(F.col("l.m"), F.col("r.m"))).select("l.concept", "r.concept")
    assert {tuple(r) for r in merge.similar_pairs(rows).collect()} == {tuple(r) for r in every.collect()}


@pytest.fixture
def sample(spark):
    rows = [
        ("1", 1, "Gross Margin", "Gross margin is what remains of sales after the cost of goods.", "doc.pdf::c1"),
        ("2", 2, "Gross Margin", "Gross margin = sales - cost of goods sold", "doc.pdf::c1"),
        ("3", 3, "Gross Margin", "A falling gross margin suggests rising costs in the plant.", "doc.pdf::c2"),
        ("4", 4, "Net Margin", "Net margin is what remains after every cost and tax is paid.", "doc.pdf::c2"),
        ("5", 5, "Net Margin", "net margin is what remains after every cost and tax is paid.", ""),
        ("6", 6, "Order Book", "The order book lists all open orders of the firm by date.", "notes.txt::c1"),
        ("7", 7, "Order Book", "Which of the following is an order book?", "notes.txt::c1"),
    ]
    return spark.createDataFrame(rows, FACTS)


def test_facts_relations(sample):
    assert facts.clean_facts(sample).count() == 6
    assert {r["fact_id"] for r in facts.unique_contents(sample).collect()} == {"1", "2", "3", "4", "6", "7"}
    ready, thin = facts.split_ready(sample, 3)
    assert ready.count() == 3 and thin.count() == 4
    best = {r["concept"]: r["definition"] for r in facts.best_definitions(sample).collect()}
    assert best["Gross Margin"].startswith("Gross margin is")
    notes = {(r["concept"], r["content"][:9]): r["note"] for r in facts.citations(sample).collect()}
    assert notes["Gross Margin", "Gross mar"] == 1 and notes["Gross Margin", "A falling"] == 2 and notes["Net Margin", "net margi"] == 2


def test_pages(sample):
    pages = {r["title"]: r["markdown"] for r in render.wiki_pages(facts.clean_facts(sample)).collect()}
    page = pages["Gross Margin"]
    assert page.startswith("---\ntags:\n  - doc\nfolder: doc\n---\n# Gross Margin") and "## Related Concepts" in page and "- [[Net Margin]]" in page
    assert page.index("## Formula") < page.index("## What It Tells You") < page.index("## See Also") and page.rstrip().endswith("- doc.pdf")
    assert "[^1]" in {r["title"]: r["markdown"] for r in render.standard_pages(facts.clean_facts(sample)).collect()}["Order Book"]
    near = sample.sparkSession.createDataFrame([("Net Margin", "Gross Margin")], "left string, right string")
    stub = render.redirects(near, facts.concepts_of(sample)).first()
    assert stub["title"] == "Net Margin" and "[[Gross Margin]]" in stub["markdown"]


def test_wikilinks_once_longest_first_and_never_nested():
    link = render.WikiLinker([("Cash Flow", "Cash Flow", False), ("Net Cash Flow", "Net Cash Flow", False), ("ncf", "Net Cash Flow", True)])
    assert link("The net cash flow and cash flow and NCF.", "Other") == "The net [[Cash Flow]] and cash flow and [[Net Cash Flow]]."
    assert link("net cash flow", "Net Cash Flow") == "net [[Cash Flow]]"
    assert link("[[Cash Flow]] of cash flows", "X") == "[[Cash Flow]] of cash flows"


def test_related_and_evaluation(spark, sample):
    concepts = facts.concepts_of(sample)
    out = {(r["concept"], r["other"]) for r in related.see_also(concepts).collect()}
    assert out == {("Gross Margin", "Net Margin"), ("Net Margin", "Gross Margin")}
    e = evaluate.evaluate(labels(spark, [("Net Cash Flow", 1), ("Cash Flow Net Tax", 2), ("Goals Plan", 1), ("Glass", 3)])).first()
    assert e["total_concepts"] == 4 and e["singleton_ratio"] == 0.5 and e["suspicious"] == ["Glass", "Goals Plan"] and len(e["near_duplicates"]) == 1
    assert [r["failed"] for r in evaluate.regressions(evaluate.evaluate(labels(spark, [("A B", 1)]))).collect()] == [True]


def test_seed_anchor(spark, sample):
    seeds = spark.createDataFrame([(0, "Profit Margin"), (1, "Order Flow")], "seed_idx int, seed string")
    assert {r["concept"] for r in related.anchor_to_seeds(sample, seeds).collect()} == {"Profit Margin", "Order Flow"}


def test_sources_round_trip(spark, tmp_path, sample):
    (tmp_path / "seeds.json").write_text('{"concepts": [" A ", "", "B"], "antonyms": [["Up ", "down"], ["x"]]}')
    assert [tuple(r) for r in readers.read_seeds(spark, str(tmp_path / "seeds.json")).collect()] == [(0, "A"), (1, "B")]
    assert readers.read_antonyms(spark, str(tmp_path / "seeds.json")) == [("up", "down")]
    (tmp_path / "a.md").write_text("---\ngenerated_by_backend: rule\n---\n# Title A\n\n- one fact\nplain line\n## Related Concepts\n- x")
    (tmp_path / "b.md").write_text("---\nk: v\n---\n# Title B\n\n- two\n")
    vault = readers.read_vault(spark, str(tmp_path))
    assert {(r["title"], r["backend"]) for r in vault.collect()} == {("Title A", "rule"), ("Title B", "unknown")}
    assert [r["title"] for r in readers.read_vault(spark, str(tmp_path), unsynthesized=True).collect()] == ["Title B"]
    assert [r["content"] for r in readers.page_facts(vault.filter("title = 'Title A'")).collect()] == ["one fact", "plain line"]
    assert readers.read_cache(spark, str(tmp_path / "none")).count() == 0
    answers = spark.createDataFrame([("a", "A"), ("b", None)], "name string, canonical string")
    readers.update_cache(readers.read_cache(spark, str(tmp_path / "cache")), answers, str(tmp_path / "cache"))
    assert [tuple(r) for r in readers.read_cache(spark, str(tmp_path / "cache")).collect()] == [("a", "A")]
    again = spark.createDataFrame([("a", "A"), ("c", "C"), ("c", "C")], "name string, canonical string")
    readers.update_cache(readers.read_cache(spark, str(tmp_path / "cache")), again, str(tmp_path / "cache"))
    assert sorted(tuple(r) for r in readers.read_cache(spark, str(tmp_path / "cache")).collect()) == [("a", "A"), ("c", "C")]
    assert readers.write_vault(spark.createDataFrame([("A/B", "x"), ("AB", "y")], "title string, markdown string"), str(tmp_path / "out")) == 2
    assert {f.name: f.read_text() for f in (tmp_path / "out").glob("*.md")} == {"AB.md": "x", "AB 2.md": "y"}


def test_configuration():
    assert config.parse_env("A='x # y'\nexport B=1 # note\n#C=2\n") == {"A": "x # y", "B": "1"}
    assert config.interpolate({"k": ["${A}/b"]}, {"A": "x"}) == {"k": ["x/b"]} and config.flag({"F": "Yes"}, "F")
    assert models.retry_after("try again in 1m5.5s") == 65.5 and models.retry_after("Retry-After: 7") == 7 and models.retry_after('"retryDelay": "3s"') == 3
    assert models.retry_after("no") is None and config.preflight(["/nowhere"], "/tmp/x") == ["not a readable file: /nowhere"]


def test_pool_falls_back():
    def broken(_):
        raise models.ModelError("down")

    pool = models.Pool([(models.Rule(broken), 2), (models.Rule(str.upper), 1)])
    assert pool.generate("x", 0) == "X" and [m is pool.members[1][0] for m in (pool.choose(k)[0] for k in range(3))] == [False, False, True]


def test_bad_answers_lose_only_their_batch(spark):
    prompts = spark.createDataFrame([(0, "good"), (1, "bad")], "batch_id long, prompt string")
    model = models.Replay({"good": '[{"statement": "a long enough statement", "source_chunk_id": "c0"}, {"statement": "foreign statement", "source_chunk_id": "c9"}]'}, default="oops")
    chunk = spark.createDataFrame([("c0", 0, "s"), ("c1", 1, "s")], "chunk_id string, batch_id long, source string")
    assert [r["statement"] for r in models.statements(chunk, models.answers(prompts, model)).collect()] == ["a long enough statement"]


def test_streaming_equals_batch_and_whole_run(spark, tmp_path):
    text = "Gross Margin is what remains of sales. Costs rise with volume in every plant. Inventory Turnover shows how fast goods move. "
    docs = spark.createDataFrame([(i, f"s{i}", text * (i + 1)) for i in range(3)], "doc_id long, source string, text string")
    for i in range(3):
        docs.filter(F.col("doc_id") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    options = pipeline.Options(models.rule_extractor(), models.rule_namer())
    query = two_pass.stream_facts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), options)
    query.awaitTermination(120)
    streamed = {(r["fact_id"], r["concept"]) for r in spark.read.parquet(str(tmp_path / "out/facts")).collect()}
    batch = pipeline.name_concepts(pipeline.extract_statements(docs, options), options)
    assert streamed == {(r["fact_id"], r["concept"]) for r in batch.collect()} and streamed
    out = pipeline.run(docs, options)
    assert out["pages"].count() > 0 and out["evaluation"].first()["total_concepts"] == out["facts"].select("concept").distinct().count()


def test_model_steps(spark, sample):
    from lexmill.plans import model_steps as steps

    names = facts.concepts_of(sample)
    cache = spark.createDataFrame([("Net Margin", "Net Profit Margin")], "name string, canonical string")
    found = steps.canonical_names(names, cache, models.Rule(lambda p: '{"Gross Margin": null, "Order Book": "Orders", "Foreign": "X"}'))
    assert {tuple(r) for r in found.collect()} == {("Net Margin", "Net Profit Margin"), ("Gross Margin", None), ("Order Book", "Orders")}
    assert {r["concept"] for r in merge.apply_canonical(sample, found).collect()} == {"Net Profit Margin", "Gross Margin", "Orders"}
    proposals = steps.consolidation_proposals(names, models.Rule(lambda p: 'x {"Order Book": "Net Margin", "Gross Margin": "Net Margin"} y'))
    assert {r["concept"] for r in merge.consolidate(sample, proposals, least=2).collect()} == {"Gross Margin", "Net Margin"}
    richer = steps.enrich_thin(sample, models.Rule(lambda p: '["one more", "two more", "three more", "four more"]'), least=3)
    assert richer.groupBy("concept").count().filter("concept = 'Net Margin'").first()["count"] == 4 and richer.count() == 11
    assert steps.enrich_thin(sample, models.Rule(lambda p: "no json"), least=3).count() == 7
    pages = render.wiki_pages(facts.clean_facts(sample))
    written = {r["concept"]: r["markdown"] for r in steps.synthesized(pages, sample, models.Rule(lambda p: "<think>x</think>About it (fact 1, 2).\n## See Also\nz" if "Order" in p else "", "rule")).collect()}
    assert "About it." in written["Order Book"] and "generated_by_backend: rule" in written["Order Book"] and "<think>" not in written["Order Book"]
    assert written["Net Margin"].startswith("---\nfallback_reason: empty answer\n")
    matched = steps.matched_pages(spark.createDataFrame([("Gross Margin Basics",), ("Other",)], "title string"), sample)
    assert [tuple(r) for r in matched.collect()] == [("Gross Margin Basics", "Gross Margin")]


def test_prompts_have_related_titles_and_all_seeds(spark, monkeypatch):
    from lexmill.plans import model_steps as steps

    rows = [(f"{c}{k}", 10 * n + k, c, f"{c} is statement {k}.", "doc::c1") for n, c in enumerate(("Order Book", "Trade Log")) for k in range(3)]
    own = spark.createDataFrame(rows, "fact_id string, fact_seq long, concept string, content string, source_chunk_id string")
    pages = spark.createDataFrame([(c, c, "text") for c in ("Order Book", "Trade Log")], "title string, concept string, markdown string")
    written = {r["concept"]: r["markdown"] for r in steps.synthesized(pages, own, models.Rule(lambda p: p, "rule")).collect()}
    assert "Pages to link: Trade Log" in written["Order Book"] and "Pages to link: Order Book" in written["Trade Log"]
    docs = spark.createDataFrame([(1, "a", "The order book lists all open orders of the market.")], "doc_id long, source string, text string")
    seeds = spark.createDataFrame([(f"seed number {i}x", i) for i in range(600)], "seed string, seed_idx int")
    options, given, prompts = pipeline.Options(models.rule_extractor(), models.rule_namer()), [], models.prompt_of_statements
    monkeypatch.setattr(models, "prompt_of_statements", lambda rows, names, strict=False: given.extend(names) or prompts(rows, names, strict))
    pipeline.name_concepts(pipeline.extract_statements(docs, options), options, seeds)
    assert given == [f"seed number {i}x" for i in range(600)]


def test_topology_makes_models_and_requests():
    topology = {
        "backends": {"a": {"base_url": "http://localhost:1", "model": "m1", "weight": 2}, "b": {"provider": "messages", "base_url": "https://x.test/v1", "model": "m2", "system": "Be brief."}, "c": {"provider": "generate", "base_url": "https://y.test/v1", "model": "m3"}, "r": {"provider": "rule-name"}},
        "passes": {"extract": ["a", {"backend": "b", "weight": 3}], "name": ["r"], "write": [{"backend": "c", "max_tokens": 7}]},
    }
    rule = models.rule_namer()
    out = models.from_topology(topology, {"rule-name": rule})
    assert out["name"] is rule and [w for _, w in out["extract"].members] == [2, 3] and out["write"].max_tokens == 7
    assert models.paced(out["write"]) and models.paced(out["extract"]) and not models.paced(out["extract"].members[0][0])
    path, _, body = out["extract"].members[1][0]._request("m2", "hi")
    assert path == "/messages" and body["system"] == "Be brief."
    path, _, body = out["write"]._request("m3", "hi")
    assert path == "/models/m3:generateContent" and out["write"]._answer({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}) == "ab"
    chat = models.Chat("http://h", "m", json_mode="schema", json_schema={"type": "array"})
    assert chat._request("m", "p")[2]["response_format"]["json_schema"]["schema"]["properties"] == {"items": {"type": "array"}}
    for wrong in ({"base_url": "ftp://h", "model": "m"}, {"base_url": "http://h", "model": ""}, {"base_url": "http://h", "model": "m", "json_mode": "schema"}):
        with pytest.raises(ValueError):
            models.Chat(**wrong)


def test_a_pausing_model_is_passed_over(monkeypatch):
    import email.message
    import io
    import urllib.error

    asked = []

    def post(self, path, headers, body):
        asked.append(body["model"])
        if body["model"] == "m1":
            raise urllib.error.HTTPError("u", 429, "slow", email.message.Message(), io.BytesIO(b"retry-after: 30"))
        return {"choices": [{"message": {"content": "ok"}}]}

    monkeypatch.setattr(models.Chat, "_post", post)
    chat = models.Chat("http://h", "m1", fallback_models=["m2"])
    assert [chat.generate("p"), chat.generate("p")] == ["ok", "ok"] and asked == ["m1", "m2", "m2"] and chat.hops == 2


def test_retries_dead_letters_and_metrics(spark, tmp_path):
    assert models.is_array('x [1] y') and models.is_array('{"k": [1]}') and not models.is_array('{"k": 1}') and not models.is_array("[1")
    docs = spark.createDataFrame([(1, "a", "The order book lists all open orders."), (2, "b", "Broken text that is refused here.")], "doc_id long, source string, text string")
    rule = models.rule_extractor()
    model = models.Rule(lambda p: "oops" if "Broken" in p else rule.rule(p))
    options = pipeline.Options(model, models.rule_namer(), dead_letters=str(tmp_path / "dead"))
    statements = pipeline.extract_statements(docs, options)
    assert statements.count() == 1
    metrics = {r["measure"]: r["value"] for r in pipeline.run_metrics(options, statements=statements).collect()}
    assert (metrics["extract_batches"], metrics["extract_failed"], metrics["extract_retries"], metrics["statements"]) == (2, 1, 2 - 1, 1)
    dead = spark.read.parquet(str(tmp_path / "dead"))
    assert [(r["pass"], r["error"]) for r in dead.collect()] == [("extract", "malformed answer")]
    assert models.requeue(dead, rule, accept=models.is_array).filter("answer IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="malformed answer"):
        pipeline.extract_statements(docs, pipeline.Options(model, models.rule_namer(), raise_failures=True)).collect()


def test_seeds_are_resolved_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(f"Gross Margin is number {i}.",) for i in range(50)] + [("Order Book rules.",)], "statement string")
    (tmp_path / "s.json").write_text('["X"]')
    assert [r["seed"] for r in pipeline.resolve_seeds(rows, None, str(tmp_path / "s.json"))[0].collect()] == ["X"]
    asked = []
    small = models.Rule(lambda p: asked.append(p) or ("no" if len(asked) == 1 else '["A", " ", "A", "B"]'))
    assert [r["seed"] for r in pipeline.resolve_seeds(rows, small, str(tmp_path / "none"))[0].collect()] == ["A", "B"] and len(asked) == 2
    assert "40" in asked[0] and "20" in asked[1] and pipeline.resolve_seeds(rows, models.Rule(lambda p: "no"))[0] is None
    assert pipeline.derive_seeds(rows, models.rule_seeder())[0] == "Gross Margin"
    docs = spark.createDataFrame([(1, "a", "The order book lists all open orders.")], "doc_id long, source string, text string")
    seeds = spark.createDataFrame([(0, "Other Name")], "seed_idx int, seed string")
    options = pipeline.Options(models.rule_extractor(), models.rule_namer(), strict_seeds=True)
    assert pipeline.name_concepts(pipeline.extract_statements(docs, options), options, seeds).isEmpty()


def test_stream_gate_and_pages(spark, tmp_path):
    text = "Gross Margin is what remains of sales. Gross Margin falls when costs rise in every plant. "
    for i in range(2):
        spark.createDataFrame([(i, f"s{i}", text * (i + 1))], "doc_id long, source string, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    options = pipeline.Options(models.rule_extractor(), models.rule_namer(), seeder=models.rule_seeder())
    two_pass.stream_facts(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), options).awaitTermination(120)
    assert [r["seed"] for r in spark.read.parquet(str(tmp_path / "out/seeds")).collect()] == ["Gross Margin"]
    assert two_pass.stream_pages(spark, str(tmp_path / "out"), options).columns == ["title", "concept", "markdown"]


def test_titles_links_and_enhanced_pages(spark, sample):
    names = spark.createDataFrame([("fifo method", 1, 1), ("FIFO Cost", 2, 1), ("gross margin", 3, 1)], "concept string, concept_seq long, n_facts long")
    assert {r["concept"]: r["title"] for r in render.titles(names).collect()} == {"fifo method": "FIFO Method", "FIFO Cost": "FIFO Cost", "gross margin": "Gross Margin"}
    links = {tuple(r) for r in render.link_maps(names).collect()}
    assert ("fifo", "FIFO Cost", True) in links and ("Gross Margin", "Gross Margin", False) in links and len(links) == 4
    pages = {r["concept"]: r["markdown"] for r in render.enhanced_pages(facts.clean_facts(sample)).collect()}
    assert pages and all("## Related Concepts" in m and "# " in m for m in pages.values())
    intro = spark.range(1).select(render.enhanced_intro(F.lit("Gross Margin"), F.lit("Gross margin is sales less cost."), F.array(F.lit("high values are good. And more.")), F.array().cast("array<string>")).alias("i")).first()["i"]
    assert intro == "**Gross Margin** is sales less cost. High values are good."
    made = spark.createDataFrame([("a", "# x", 0.9, "LOW"), ("b", "# x\n## s\n## t\n## u", 0.5, "HIGH")], "backend string, markdown string, coverage double, risk string")
    verdict = {r["measure"]: r["verdict"] for r in evaluate.compared_backends(made, "a", "b").collect()}
    assert verdict["coverage"] == "a better" and verdict["sections"] == "b more detailed" and verdict["links"] == "comparable"
    assert [r["concept"] for r in evaluate.group_report(names.withColumn("n_facts", F.col("concept_seq"))).collect()] == ["gross margin", "FIFO Cost", "fifo method"]


def test_islands_of_a_long_path(spark):
    n = 70
    edges = spark.createDataFrame([(f"c{i:03}", f"c{i + 1:03}") for i in range(n)], "a string, b string")
    nodes = spark.createDataFrame([(f"c{i:03}",) for i in range(n + 1)] + [("z",)], "concept string")
    out = {r["concept"]: r["island"] for r in merge._islands(edges, nodes).collect()}
    assert set(out.values()) == {"c000", "z"} and len(out) == n + 2



def lowered(df) -> int:
    """How often a plan works out the lower case of a content."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("lower(content")


def test_promoted_works_out_each_test_once(sample):
    assert lowered(facts.promoted(sample)) <= 8


def test_best_definitions_work_out_each_test_once(sample):
    assert lowered(facts.best_definitions(sample)) <= 4


def test_fallback_definitions_work_out_each_test_once(sample):
    assert lowered(facts.fallback_definitions(sample)) <= 4


def test_unique_counts_keep_concepts_without_comparable_contents(spark):
    rows = spark.createDataFrame([("A", "One two.", 0), ("A", " one TWO. ", 1), ("A", "one two!", 2), ("B", "一二", 3), ("B", " ", 4)], "concept string, content string, fact_seq long")
    assert sorted(map(tuple, facts.unique_counts(rows).collect())) == [("A", 2, 1), ("B", 1, 0)]


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_standard_pages_compare_no_pairs_of_notes(sample):
    assert "array_distinct(transform(x" not in planned(render.standard_pages(sample))


def test_sections_are_cut_before_the_shuffle(sample):
    definitions = facts.fallback_definitions(sample)
    assert planned(render.sections(sample, definitions)).count("WindowGroupLimit") == 2


def test_enhanced_pages_gather_no_sources_of_whole_concepts(sample):
    assert "flatten(collect_list(sources" not in planned(render.enhanced_pages(sample))


def test_risk_by_evidence_equals_risk_of_the_joined_facts(spark):
    rows = spark.createDataFrame([("A", "It increases by 20%"), ("A", "in 1999 and 20011999."), ("B", "Never higher."), ("C", None)], "concept string, content string")
    pages = spark.createDataFrame([("A", "It decreases. Many studies of 1999, 2000, 2001, 1%, 2%, 3%, 4%, 5%, 6%"), ("B", "always lower"), ("C", "lower")], "concept string, markdown string")
    bag = rows.groupBy("concept").agg(F.concat_ws(" ", F.collect_list("content")).alias("bag"))
    joined = pages.join(bag, "concept").join(evaluate.evidence(rows), "concept")
    for covered in (0.5, 0.65, 0.9):
        has = {w: F.col(w) for p in evaluate.CONTRADICTIONS for w in p}
        two = joined.select(evaluate.hallucination_risk(F.col("markdown"), F.col("bag"), F.lit(covered)), evaluate.risk_by_evidence(F.col("markdown"), has, F.col("figures"), F.lit(covered)))
        assert all(a == b for a, b in two.collect())


def test_related_chunks_reads_facts_once(sample):
    assert "LogicalRDD" not in planned(related.related_by_chunks(sample))  # only what is stored


def test_answered_prompts_are_not_kept(spark):
    prompts = spark.createDataFrame([(1, 'x\n[{"id": "c", "text": "One. Two."}]')], "batch_id long, prompt string")
    out = pipeline._asked(prompts, models.rule_extractor(), "extract", pipeline.Options(models.rule_extractor(), models.rule_namer()))
    assert [(r["prompt"], r["answer"] is None) for r in out.collect()] == [(None, False)]
