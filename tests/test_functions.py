"""Truth tables of scalar functions and predicates, on wording of our own."""

import pytest
from pyspark.sql import functions as F

from lexmill.functions import classify, jsons, pairs, text
from lexmill.functions.predicates import all_sources_are_uuids, is_noise_fact, is_valid_concept, looks_like_uuid, needs_canonicalization


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_valid_concepts(spark):
    table = {
        "Inventory Turnover": True, "Net Present Value": True, "   ": False, "": False, "None": False, "Crisis of 2008": False,
        "a b c d e f g": False, "Smith's Rule": False, "U S Market": False, "Normality": False, "Selling Goods": False,
        "Training Plan": True, "Example Two": False, "example two": True, "Record Entry": False, "Cost": False, "Cost Driver": True,
        "Higher Margin": False, "Vendor Portal": False, "Chunk  ID": False, "Canonicalize the Concept": False, "Greek Letters": True,
    }
    assert dict(zip(table, apply(spark, is_valid_concept, list(table)), strict=True)) == table
    assert apply(spark, lambda x: is_valid_concept(x, whole_words=True), ["Normality", "Trade with Mali"]) == [True, False]
    assert apply(spark, is_valid_concept, [None]) == [False]


@pytest.mark.parametrize(("f", "table"), [
    (text.group_key, {"net present-value": "Net Present Value", "FIFO method": "FIFO Method", "TOOLONGCAPS": "Toolongcaps", "3d model2x": "3D Model2X", "": ""}),
    (text.normalize_label, {"Types": "Type", "number of Units": "Unit", "Days Sales Outstanding (DSO)": "Days Sales Outstanding", "Gross Margin (GM%)": "Gross Margin", "Alpha (beta)": "Alpha Beta", "Perpetual inventory System": "Perpetual Inventory", "The Method": "The Method", "cost cost drivers": "Cost Driver", "Policies": "Policy", "risk Analysis": "Risk Analysis", "Gross-Profit": "Gross Profit", "  ": ""}),
    (text.merge_key, {"Cost of the Goods": "cost goods", "A B": "b"}),
    (lambda x: F.array_join(text.match_tokens(x), "|"), {"Certificate Authorities": "certificate|authority", "Nora's Plans": "nora's|plan", "Analysis": "analysi", "'Quoted' Words!": "quoted|word", "": ""}),
    (text.page_title, {"days sales IN inventory DSI": "Days Sales IN Inventory (DSI)", "Free On Board FOB": "Free on Board (FOB)", "cost of goods": "Cost of Goods"}),
    (text.compare_text, {"  The Cost, of:  X! ": "the cost of x"}),
    (text.template_of, {"Sold 1200 units for 35": "sold <num> units for <num>"}),
    (text.fold_unicode, {"a—b–c… “q” x­y": 'a--b-c... "q" xy'}),
    (text.safe_filename, {'a/b:c*"?': "abc", "///": "Unnamed Concept"}),
    (lambda x: F.array_join(text.sentences(x), "|"), {"One. Two!  Three?\nFour": "One.|Two!|Three?|Four", " ": ""}),
])
def test_text_functions(spark, f, table):
    assert dict(zip(table, apply(spark, f, list(table)), strict=True)) == table


def test_classes(spark):
    table = {
        "": "key_point", "There are three kinds.": "example", "Compute the margin for the firm.": "instruction", "The findings matter.": "instruction",
        "A margin is what remains after costs.": "definition", "Suppose prices rise.": "example", "In year 1 and year 2 sales grew.": "example",
        "Costs fell 10 20 30.": "example", "Margins guide decisions.": "key_point", "The clerk had a balance of 40 coins.": "example",
    }
    assert dict(zip(table, apply(spark, classify.classify_fact, list(table)), strict=True)) == table
    semantic = {"Margin = sales - costs": "formula", "A ratio is one value divided by another.": "formula", "However, this misleads.": "caution", "A high value indicates strain.": "interpretation", "A margin is what remains.": "definition"}
    assert dict(zip(semantic, apply(spark, classify.classify_semantic, list(semantic)), strict=True)) == semantic
    assert apply(spark, classify.is_low_signal, ["", "Too short here", "This sentence has quite enough words in it", "As shown in the chart this long sentence runs"]) == [True, True, False, True]
    assert apply(spark, is_noise_fact, [None, " ", "Option B", "Multiple  choice", "Optional part"]) == [True, True, True, True, False]


def test_definition_scores_and_types(spark):
    score = lambda x: classify.definition_score(F.lit("Gross Margin"), x)
    assert apply(spark, score, ["Gross margin is a measure of profit.", "There are various kinds of things.", "It is higher than net margin."]) == [8, -6, -2]
    bag = ["sales divided by assets, it indicates speed", "it continuously updates", "this technique assigns a cost", "nothing"]
    assert apply(spark, lambda x: classify.concept_type(F.lit("Thing"), x), bag) == ["ratio", "system", "method", "general"]


def test_pairs(spark):
    rows = [("FIFO", "LIFO"), ("Fixed Cost", "Variable Cost"), ("Accounts Payable", "Accounts Receivable"), ("Net Cash Flow", "Cash Flow Statement"), ("Cash Flow", "Net Cash Flow"), ("Order Book", "Order Books")]
    df = spark.createDataFrame(rows, "a string, b string").select(text.match_tokens(F.col("a")).alias("a"), text.match_tokens(F.col("b")).alias("b"))
    tests = {"dup": pairs.is_duplicate, "sib": pairs.is_sibling, "cou": pairs.is_cousin, "ovl": pairs.has_strong_overlap, "ant": pairs.has_antonyms, "sim": pairs.are_similar, "near": pairs.near_duplicates}
    for x, y in (("a", "b"), ("b", "a")):  # all are symmetric
        out = [{n for n in tests if r[n]} for r in df.select(*[f(F.col(x), F.col(y)).alias(n) for n, f in tests.items()]).collect()]
        assert out == [{"dup", "sim"}, {"sib", "ant"}, {"cou"}, {"ovl", "sim"}, {"sib", "ovl"}, {"dup", "ovl", "sim", "near"}]


def test_json(spark):
    cases = ['[{"a":1}]', '```json\n[1,2]\n```', 'Here: [1] ok', '{"e":[],"items":[1,2]}', "[1,", "", '{"a":1}', "no"]
    assert apply(spark, jsons.parse_array, cases) == ['[{"a":1}]', "[1,2]", "[1]", "[1,2]", None, None, None, None]
    assert apply(spark, jsons.parse_object, ['x {"a":1} y', "{", '{"b":2}']) == ['{"a":1}', None, '{"b":2}']
    assert apply(spark, jsons.failure, ["", "[1,", '{"a":1}', "{", "no"]) == ["empty response", "truncated array", "object instead of array: a", "object instead of array", "malformed"]


def test_sources_and_signs(spark):
    u = "123e4567-e89b-12d3-a456-426614174000"
    assert apply(spark, looks_like_uuid, [u.upper(), "doc.pdf"]) == [True, False]
    df = spark.createDataFrame([([u, "unknown"],), ([u, "doc"],)], "s array<string>")
    assert [r[0] for r in df.select(all_sources_are_uuids(F.col("s"))).collect()] == [True, False]
    assert apply(spark, needs_canonicalization, ["Plan B", "Cost  Cost", "Net Cost"]) == [True, True, False]
