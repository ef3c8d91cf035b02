"""Each operator against brute force on small rows with nulls, empty and odd texts, ties and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import automaton, components, decontamination, jaccard, language, licenses, lines, linear, packing, quality, secrets, substrings, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root long, t string, sig string, part int, `_key` string, group string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def docs_of(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(d, t, "en", "s", len(t or ""), 7, "t", "s", 1, "k", "g") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(120)] + ["Ünder", "naïve", "THE", "of"]
    out, d = [], 0
    for _ in range(14):
        base = [r.choice(vocabulary) for _ in range(r.choice([2, 9, 16, 40, 150]))]
        for v in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(v and r.randint(0, 1 + len(w) // 30)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            d += r.randint(1, 9)
            out.append((d, ("\n" if v % 3 == 1 else " ").join(w).upper() if v == 4 else " ".join(w) + "\nFooter line " * (v % 2)))
    return [*out, (None, out[0][1]), (out[1][0], out[1][1]), (d + 1, None), (d + 2, ""), (d + 3, " \t\n"), (d + 4, "x " * 5000)]


def test_pieces_round_trip_and_bins(spark, rows):
    out = packing.pack_documents(docs_of(spark, rows), seq_len=64, items_per_partition=5).toPandas()
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = 0
    expected = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for k, (start, length) in enumerate(packing.cut(len(ids), 64)):
            expected[d, k, start, length, zlib.crc32(np.asarray(ids[start : start + length], "<u4").tobytes())] += 1
    found = Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples())
    assert found == expected
    by = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.sum() <= 64).all() and (out.sort_values(["sequence_id", "offset"]).offset == by.length.cumsum() - out.sort_values(["sequence_id", "offset"]).length).all()
    assert out.sequence_id.nunique() <= -(-total // 64) * 1.1 + 1


def test_bounds_never_exceed_the_optimum():
    r = random.Random(1)

    def optimum(sizes, capacity):
        best = [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= capacity:
                    place(i + 1, bins[:k] + [bins[k] + sizes[i]] + bins[k + 1 :])
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best[0]

    for _ in range(400):
        capacity = r.randint(5, 30)
        sizes = sorted((r.randint(1, capacity) for _ in range(r.randint(1, 7))), reverse=True)
        assert packing.lower_bound(np.array(sizes), capacity) <= optimum(sizes, capacity) <= packing.best_fit_decreasing(np.array(sizes), capacity)[2]


def test_repair_closes_gaps():
    r, before, after = np.random.default_rng(0), 0, 0
    for k in range(24):
        lengths = np.sort(r.integers(300, 1101, 400) if k % 2 else r.integers(250, 800, 900))[::-1].copy()
        bound, first = packing.lower_bound(lengths, 2048), packing.best_fit_decreasing(lengths, 2048)
        bins, offsets, n = packing.repacked(lengths, *first, 2048, bound)
        before, after = before + first[2] - bound, after + n - bound
        order = np.lexsort((offsets, bins))
        ends = np.append(0, (offsets + lengths)[order][:-1]) * np.append(False, np.diff(bins[order]) == 0)
        assert (offsets[order] == ends).all() and (offsets + lengths).max() <= 2048 and set(bins) == set(range(n))
    assert after <= 0.4 * before
    assert packing.repacked(np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i8"), 0, 2048, 0)[2] == 0


def test_one_partition_is_repaired(spark):
    """Fewer sequences than BFD needs, also where all items are in one partition."""
    r = np.random.default_rng(1)
    lengths = r.integers(300, 1101, 400)
    pieces = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(lengths)], packing.PIECES)
    out = packing.pack_pieces(pieces).toPandas()
    bfd = packing.best_fit_decreasing(np.sort(lengths)[::-1], 2048)[2]
    assert out.groupby("sequence_id").length.sum().max() <= 2048 and out.sequence_id.nunique() < bfd and len(out) == 400


def test_a_very_long_text_is_cut_whole(spark):
    text = "alpha beta " * 30000
    out = packing.pack_documents(docs_of(spark, [(1, text), (2, "x")])).filter("doc_id = 1").toPandas().sort_values("piece")
    ids = np.append(np.frombuffer(packing.tokenizer_at(None).ids(text), "<u4"), 0)
    assert out.length.sum() == len(ids) and (out.length.iloc[1:] == 2048).all() and out.start.tolist() == [0, *out.length.cumsum().tolist()[:-1]]


def test_special_token_strings_and_odd_spaces():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, own, r = Tokenizer.from_file(path), packing.ByteTokenizer(path), random.Random(3)
    signs = [*" \n\n  ab.1'sé\t\xa0 !²ª٣", "<|endoftext|>", "'re"]
    for _ in range(2000):
        x = "".join(r.choice(signs) for _ in range(r.randint(0, 30)))
        assert own.ids(x) == np.asarray(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes()


def plain_components(rows, size, num, den):
    def shingles(t):
        w = [ascii_lower(x) for x in words(t)]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}

    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(x for x in (low.get(find(i)), d) if x is not None) if d is not None or low.get(find(i)) is not None else None
    return Counter((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "num", "den", "block"), [(3, 90, 100, 700), (5, 80, 100, 3)])
def test_jaccard_components(spark, rows, size, num, den, block):
    expected = plain_components(rows, size, num, den)
    out = jaccard.similarity_components(docs_of(spark, rows), size, num, den, block)
    assert {"root", "sig", "_key"} <= set(out.columns)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == expected


def test_similar_sets_share_a_signature():
    r = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100), (5, 10)):
        for n in (3, 11, 24, 70, 400):
            for _ in range(60):
                a = np.unique(r.integers(0, 2**64, n, dtype="u8"))
                k = int(len(a) * (1 - num / den) * 1.05)
                b = np.unique(np.concatenate([r.permutation(a)[: len(a) - int(r.integers(0, k + 1))], r.integers(0, 2**64, int(r.integers(0, k + 1)), dtype="u8")]))
                both = len(np.intersect1d(a, b))
                x, y = jaccard.sketch(a), jaccard.sketch(b)
                m = min(len(x), len(y))
                for c in (m, m // 2):
                    assert jaccard.least_difference(jaccard.fold(x, c), jaccard.fold(y, c)) <= len(a) + len(b) - 2 * both
                if den * both >= num * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert len(np.intersect1d(jaccard.signatures(a, num, den), jaccard.signatures(b, num, den)))


def test_connected_components_of_a_long_path(spark):
    links = spark.range(60).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).union(spark.createDataFrame([(100, 101), (101, 100)], "u long, v long"))
    out = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    assert out == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_line_dedup(spark, rows):
    n = 3
    split = [(d, (t or "").split("\n")) for d, t in rows]
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, x in split for k in {key(y) for y in x})
    expected = Counter()
    for d, x in split:
        kept = [y for y in x if key(y) == "" or seen[key(y)] < n]
        expected[d, len(x), len(x) - len(kept), "\n".join(kept)] += 1
    out = lines.dedup_lines(docs_of(spark, rows), min_docs=n, batches=5, fanout=2)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in out.collect()) == expected


@pytest.mark.parametrize("fanout", [2, 3, 9])
def test_line_runs_count_over_all_batches(spark, fanout):
    """Against plain counts, with hashes that are frequent in one batch, over several, and settled early."""
    r, plain = random.Random(fanout), Counter()
    runs = lines.LineRuns(spark, 4, fanout)
    for k in range(6):
        batch = [(r.randint(0, 30 + 10 * k), 1) for _ in range(25)] + [(1000 + k, 2)] * r.randint(2, 5) + [(2000, 3)]
        plain.update(batch)
        runs.add(spark.createDataFrame(batch, "h1 long, h2 long"))
    assert {tuple(x) for x in runs.keys().collect()} == {k for k, n in plain.items() if n >= 4}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("lexmill_")]


def plain_removed(rows, n):
    split, first = [(d, words(t)) for d, t in rows], {}
    for d, w in split:
        for i in range(len(w) - n + 1) if d is not None else ():
            first[tuple(w[i : i + n])] = min(first.get(tuple(w[i : i + n]), d), d)
    expected = Counter()
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1) if d is not None else ():
            if first[tuple(w[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        expected[d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)] += 1
    return expected


@pytest.mark.parametrize("n", [13, 4])
def test_substring_dedup(spark, rows, n):
    expected = plain_removed(rows, n)
    out = substrings.dedup_substrings(docs_of(spark, rows), n)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect()) == expected


def test_sql_of_whole_table_queries(rows):
    """The SQL that two queries are held against, against the same brute force, on rows of distinct ids."""
    unique = list({d: (d, t) for d, t in rows if d is not None}.values())
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", unique)
    found = con.execute(f"SELECT doc_id, n_shingles, component_id FROM ({jaccard.ORACLE})").fetchall()
    assert Counter(found) == plain_components(unique, 3, 90, 100)
    found = con.execute(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({substrings.ORACLE})").fetchall()
    assert Counter(found) == Counter((*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in plain_removed(unique, 13).elements())


def test_suffix_automaton_prefers_the_smallest_document():
    a = substrings.SuffixAutomaton()
    a.add([1, 2, 3, 4], 5)
    a.add([2, 3, 4, 9], 3)
    a.finish()
    assert a.spans([7, 2, 3, 4, 9, 1, 2, 3], 4, 3) == [(1, 5)]
    assert a.spans([1, 2, 3, 4], 5, 3) == [(1, 4)] and a.spans([1, 2, 3, 4], 6, 3) == [(0, 4)]


#: (kind, expression, counted group, least), written down apart from the operator's own rules.
PLAIN_SECRETS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile("[0-9a-f]+"), 0, 16),
    ("pem", re.compile("-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0, 0),
    ("github", re.compile("gh[pousr]_[A-Za-z0-9]+"), 0, 40),
    ("slack", re.compile("xox[baprs]-[A-Za-z0-9-]+"), 0, 15),
    ("stripe", re.compile("sk_live_[A-Za-z0-9]+"), 0, 24),
    ("google", re.compile("AIza[A-Za-z0-9_-]+"), 0, 39),
    ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 0),
]


def brute_secrets(text):
    return sorted((m.start(), k, m.end()) for k, (_, rule, group, least) in enumerate(PLAIN_SECRETS) for m in rule.finditer(text) if len(m.group(group)) >= least)


def test_secrets(spark):
    r = random.Random(5)
    bits = ["token", "secret", "Password", "api_key", "=", ":", "=", "'", '"', " ", "AKIA", "ABCDEF012345", "0123456789abcdef", "\n", ",", "é", "x", "-----BEGIN RSA PRIVATE KEY-----", "ghp_", "A" * 36, "xoxb-", "AIza", "eyJ", ".", "_", "abctoken", "\u017f", "\u212a", "sk_live_"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts += ["", "a" * 40000 + " token: " + "b" * 30, "token=" * 5000, "token=abcdefghijklmno pa\u017f\u017fword=abcdefghijklmnop", "pa\u017f\u017fword=abcdefghijklmnop", "to\u212aen=abcdefghijklmnop", "token=abcdefghijkltoken:abcdefghijklmnop", "token=abctoken:token=abcdefghijklmnop"]
    texts += texts[:3]
    got = secrets.spans_of(secrets.RULES, secrets.automaton_of(secrets.RULES), texts)
    for text, spans in zip(texts, got, strict=True):
        assert spans == brute_secrets(text), text[:200]
    some = texts[-400:]
    out = secrets.scan_secrets(docs_of(spark, [*enumerate(some), (None, None), (1, some[1])]).withColumn("spans", F.lit("clash"))).collect()
    assert len(out) == len(some) + 2
    for row in out:
        spans = brute_secrets("" if row["doc_id"] is None else some[row["doc_id"]])
        render = lambda s: ",".join(f"{PLAIN_SECRETS[k][0]}:{a}:{b}" for a, k, b in s)
        assert row["spans"] == render(spans)
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert row["base_sha256"] == hashlib.sha256(render([s for s in spans if s[1] < 3]).encode()).hexdigest()
    assert secrets.redact("key AKIA0000 end", [{"start": 4, "end": 12}]) == "key [SECRET] end"


def test_automaton_is_minimal_and_resets():
    a = automaton.compile_rules([("ab+c", False), ("ab*c", False)])
    assert len(a.masks) == 5 and a.resets[ord("x")] and not a.resets[ord("a")]
    places, masks = automaton.scan(a, np.frombuffer(b"xx abbc\n ac", "u1"))
    assert places.tolist() == [6, 10] and masks.tolist() == [3, 2]
    back = automaton.compile_rules([("a(b|cd)+", True)], anchored=True, backwards=True)
    assert back.longest(b"xaABcdb", 7, 0) == 2 and back.longest(b"xaABcdb", 7, 3) is None


def test_decontamination(spark):
    r = random.Random(2)
    vocabulary = [f"v{i}x" for i in range(900)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([5, 15, 30, 60])))) for i in range(30)]
    clean = [(1000 + i, " ".join(r.choice(vocabulary) for _ in range(200))) for i in range(30)]
    planted = [(i, " ".join([*clean[i][1].split()[: r.randint(0, 99)], *t.upper().split(), "tail"])) for i, t in items]
    edited = []
    for i, t in items:
        if len(w := t.split()) >= 30:
            w[len(w) // 2] = "changed"
            edited.append((500 + i, "head " + " ".join(w)))
    benchmark = spark.createDataFrame([*items, (77, None), (78, "too short")], "item_id long, text string")
    rows = [*clean, *planted, *edited, (9999, None), (9998, "")]
    out = decontamination.find_contamination(docs_of(spark, rows), benchmark, block_words=400).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in out}
    assert {(i, i): 0 for i, _ in items}.items() <= found.items()
    assert all(found[500 + i, i] == 1 for i in [d - 500 for d, _ in edited])
    assert not [k for k in found if k[0] >= 1000]


def test_decontamination_recall_by_length():
    """Against the exact distance of each item to each text, by item length and number of edits."""
    r = random.Random(5)
    vocabulary = [f"v{i}x" for i in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(k, some(n)) for k, n in enumerate(n for n in (4, 5, 6, 7, 8, 10, 12, 15, 16, 20, 25, 30, 40, 60) for _ in range(8))]
    texts, own = [], []
    for k, item in items:
        for edits in {int(0.2 * len(item)) // 2, int(0.2 * len(item))}:
            for _ in range(4):
                w = list(item)
                for at in sorted(r.sample(range(len(w)), edits), reverse=True):
                    w[at : at + r.choice((0, 1, 1))] = some(1) if r.random() < 0.6 else []
                texts.append(" ".join([*some(r.randint(0, 30)), *w, *some(r.randint(0, 30))]))
                own.append((k, edits))
    got = decontamination.ItemIndex([(k, " ".join(w)) for k, w in items], 0.2, 0.95).matches(texts)
    code = {w: i for i, w in enumerate(vocabulary)}
    as_codes = lambda w: np.array([code[x] for x in w], "u8")
    seen = Counter()
    for text, (k, edits), found in zip(texts, own, got, strict=True):
        item = items[k][1]
        best = decontamination.edit_distance(as_codes(item), as_codes(text.split()))[0]
        here = [m for m in found if m[0] == k]
        if best <= int(0.2 * len(item)):
            seen[len(item), edits, "all"] += 1
            seen[len(item), edits, "found"] += bool(here)
            assert all(m[1] == best for m in here) or len(item) >= 30
    for n, edits, what in list(seen):
        if what == "all":
            assert seen[n, edits, "found"] >= (1 if n < 25 else 0.95) * seen[n, edits, "all"], (n, edits)


def test_decontamination_edges(spark, rows):
    item = " ".join(f"it{i}" for i in range(30))
    benchmark = spark.createDataFrame([(1, item), (1, item), (2, item), (None, item)], "item_id long, text string")
    docs = docs_of(spark, [*rows, (9000, "w " * 100000 + item), (9001, item), (9001, item), (None, item)])
    out = decontamination.find_contamination(docs.withColumn("edits", F.lit("x")), benchmark)
    found = Counter(r["doc_id"] for r in out.filter("edits = 0").collect())
    assert set(found) == {9000, 9001, None} and found[9001] == 2 * found[9000]
    assert decontamination.find_contamination(docs.limit(0), benchmark).isEmpty()
    assert decontamination.find_contamination(docs, benchmark.limit(0)).isEmpty()


def test_quality_and_licences_of_odd_rows(spark, rows):
    long = "\n".join(f"line number {i} of a very long text" for i in range(20000))
    odd = [*rows, (9000, long), (9001, "Licensed under MIT."), (9001, "Licensed under MIT."), (9002, long + "\nLicensed under MIT.")]
    docs = docs_of(spark, odd).withColumn("group", F.lit("clash")).withColumn("d2", F.lit(1)).withColumn("sequence", F.lit(1))
    out = quality.quality(docs).collect()
    assert len(out) == len(odd) and len({r["kept"] for r in out if r["doc_id"] == 9001}) == 1
    assert next(r["n_words"] for r in out if r["doc_id"] == 9000) == 160000
    found = Counter((r["doc_id"], tuple(r["licences"])) for r in licenses.scan_licenses(docs).collect())
    assert found[9001, ("MIT",)] == 2 and found[9002, ("MIT",)] == 1 and sum(found.values()) == len(odd)


def test_minimum_determinant_against_plain_numpy(spark):
    """The same starts and steps on a plain array: the estimate's determinant is as small, and smaller than one start's."""
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(700, 5)), r.normal(size=(200, 5)) * 0.3 + [6, 6, 0, 0, 0]])
    z = spark.createDataFrame([("g", *map(float, v)) for v in x], "group string, " + ", ".join(f"z{i} double" for i in range(5)))
    got = quality.minimum_determinant(z).first()

    def step(d):
        core = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
        m, c = core.mean(axis=0), 0.9 * np.cov(core.T, bias=True) + 0.1 * np.eye(5)
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), np.log(np.linalg.det(c))

    ends = []
    for start in ((x**2).sum(1), abs(x).sum(1), abs(x).max(1), (np.tanh(x) ** 2).sum(1)):
        d, spread = step(start)
        for _ in range(60):
            d, spread = step(d)
        ends.append(spread)
    spread = 2 * sum(np.log(got[f"l{i}{i}"]) for i in range(5))
    assert spread <= min(ends) + 0.05


def test_minimum_determinant_leaves_groups_at_rest(spark, monkeypatch):
    """Large groups, one with many equal rows, end where plain exact steps end, and only those that still fall go on."""
    r = np.random.default_rng(5)
    groups = {f"g{k}": np.concatenate([r.normal(size=(9000, 5)), r.normal(size=(3000, 5)) + [3, 0, k, 0, 0]]) for k in range(2)}
    groups["ties"] = r.integers(0, 3, size=(6000, 5)).astype(float)
    z = spark.createDataFrame([(g, *map(float, v)) for g, x in groups.items() for v in x], "group string, " + ", ".join(f"z{i} double" for i in range(5)))
    worked, estimate = [], quality._estimate
    monkeypatch.setattr(quality, "_estimate", lambda rows: worked.append(rows.select("group").distinct().count()) or estimate(rows))
    got = {row["group"]: row for row in quality.minimum_determinant(z).collect()}
    steps = Counter()
    for g, x in groups.items():

        def step(d, x=x):
            core = x[d <= np.sort(d)[int(np.ceil(0.75 * len(d))) - 1]]
            m, c = core.mean(axis=0), 0.9 * np.cov(core.T, bias=True) + 0.1 * np.eye(5)
            return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), np.linalg.slogdet(c)[1]

        first = ((x**2).sum(1), abs(x).sum(1), abs(x).max(1), (np.tanh(x) ** 2).sum(1))
        d, spread = min((step(step(d)[0]) for d in first), key=lambda e: e[1])
        fell = 1.0
        while fell > 1e-4:
            steps[g] += 1
            d, now = step(d)
            fell, spread = spread - now, min(spread, now)
        assert abs(2 * sum(np.log(got[g][f"l{i}{i}"]) for i in range(5)) - spread) < 1e-6
    assert worked == [12, 12] + [sum(n > k for n in steps.values()) for k in range(max(steps.values()))]


def test_core_edges_are_exact(spark):
    r = np.random.default_rng(8)
    near = {"large": r.exponential(size=30000), "equal": np.full(9000, 2.0), "few": r.integers(0, 4, 9001).astype(float), "one": np.array([0.5]), "none within": np.repeat([0.0, 9.0], [7499, 2501])}
    rows = spark.createDataFrame([(g, float(d)) for g, ds in near.items() for d in ds], "group string, d2 double")
    assert {x["group"]: x["edge"] for x in quality.core_edges(rows).collect()} == {g: float(np.sort(ds)[int(np.ceil(0.75 * len(ds))) - 1]) for g, ds in near.items()}


def test_edit_distance_against_all_stretches():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j + 1] + 1, row[j] + 1)
        return row[-1]

    r = random.Random(2)
    for _ in range(150):
        a, t = ([r.randint(0, 3) for _ in range(n)] for n in (r.randint(1, 8), r.randint(0, 10)))
        edits, first, end = decontamination.edit_distance(np.array(a, "u8"), np.array(t, "u8"))
        assert edits == min(plain(a, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1)) == plain(a, t[first:end])


def test_language_held_out_accuracy(spark):
    r = random.Random(1)
    stems = {"aa": ["thon", "ing", "ed", "the"], "bb": ["ción", "que", "llo", "de"], "cc": ["sch", "ung", "über", "der"]}
    rows = [(i, " ".join("".join(r.choice(stems[lang]) for _ in range(3)) for _ in range(30)), lang) for i in range(300) for lang in [r.choice(list(stems))]]
    odd = [(9000, None, "aa"), (9001, "123 ...", "bb"), (9002, "thoning theed", None), (None, "thoning the", "aa")]
    df = spark.createDataFrame([*rows, *odd], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in language.identify_languages(df).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i]["held_out"] for i in held) and np.mean([out[i]["lang_pred"] == truth[i] for i in held]) > 0.95
    assert out[9000]["lang_pred"] == out[9001]["lang_pred"] == "und" and out[9002]["lang_pred"] == "aa"
    assert all(0 <= x["score"] <= 1 for x in out.values())
    clash = language.identify_languages(df.withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y")))
    assert clash.columns == ["doc_id", "held_out", "lang_pred", "score"] and clash.count() == len(rows) + 4
    long = spark.createDataFrame([*rows, (9500, "thon ing theed " * 40000, "aa")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in language.identify_languages(long).collect()}[9500] == "aa"
    none = language.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred <> 'und'")
    assert none.isEmpty() and language.identify_languages(df.limit(0)).isEmpty()


def test_more_languages_than_any_cap(spark):
    """300 languages, each with words of its own, are all learned."""
    r = random.Random(2)
    syllable = lambda: r.choice("bcdfghjklmnpqrstvwxz") + r.choice("aeiou") + r.choice("bcdfghjklmnpqrstvwxz")
    words_of = [["".join(syllable() for _ in range(2)) for _ in range(4)] for _ in range(300)]
    rows = [(1000 * k + j, " ".join(r.choice(words_of[k]) for _ in range(12)), f"l{k:03}") for k in range(300) for j in range(4)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.col("doc_id"))
    assert len(model.languages) == 300 and np.mean([model.predict(t)[0] == lang for _, t, lang in rows]) > 0.95


def test_temperature_cools_overconfidence():
    r = np.random.default_rng(0)
    target = np.eye(2)[r.integers(0, 2, 400)]
    assert linear.temperature(20 * (target + 0.9 * r.normal(size=target.shape)), target) > 3


def test_toxicity_held_out(spark):
    r = random.Random(1)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        toxic = r.random() < 0.2
        w = [r.choice(vocabulary) for _ in range(40)]
        if toxic:
            w[3:5] = [r.choice(["zorkish", "zorkly", "grumbat", "idiot"]) for _ in range(2)]
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df, lab = docs_of(spark, [*rows, (None, "idiot"), (7000, None)]), spark.createDataFrame([*labels, (5, None), (None, 1), (888888, 1)], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_toxicity(df, lab).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([out[i]["predicted"] == labels[i][1] for i in held]) > 0.93 and all(out[i]["held_out"] for i in held)
    assert len(out) == 602 and all(0 <= x["score"] <= 1 for x in out.values())
    assert toxicity.score_toxicity(df, lab.limit(0)).count() == 602


def test_toxicity_edges(spark, rows):
    docs = docs_of(spark, [*rows, (9000, "idiot " * 60000), (9001, "same"), (9001, "same")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score_toxicity(docs, none).collect()
    assert len(out) == len(rows) + 3 and len({r["score"] for r in out if r["doc_id"] == 9001}) == 1
    assert toxicity.score_toxicity(docs.limit(0), none).isEmpty()
    clash = toxicity.score(docs.withColumn("toxicity", F.lit("x")), toxicity.fit(docs, none))
    assert dict(clash.dtypes)["toxicity"] == "double" and clash.count() == len(rows) + 3


def test_label_model_finds_good_and_correlated_voters():
    r = np.random.default_rng(0)
    y = r.random(20000) < 0.2
    votes = [np.where(y, r.random(len(y)) < good, r.random(len(y)) < bad) for good, bad in ((0.8, 0.05), (0.7, 0.02), (0.6, 0.1))]
    votes.append(np.where(r.random(len(y)) < 0.95, votes[2], ~votes[2]))
    pattern = sum(v.astype(int) << k for k, v in enumerate(votes))
    u, n = np.unique(pattern, return_counts=True)
    m = toxicity.LabelModel(4, 0.2).fit(u, n.astype(float), np.where(u > 0, 0.7, 0.05))
    assert any({2, 3} <= set(g) for g in m.groups) and abs(m.prior - 0.2) < 0.1
    assert ((m.posterior(pattern) > 0.5) == y).mean() > 0.85


def test_quality_base_and_outliers(spark):
    r = random.Random(4)
    sentence = lambda n: " ".join("w" * r.randint(2, 8) + str(r.randint(0, 999)) for _ in range(n))
    rows = [(i, "\n".join(sentence(12) for _ in range(r.randint(3, 9)))) for i in range(200)]
    odd = [(900, sentence(60).replace(" ", " | ## ")), (901, None), (902, ""), (903, (sentence(10) + " ") * 30), (904, "same line here\n" * 4 + sentence(40))]
    out = {r["doc_id"]: r for r in quality.quality(docs_of(spark, [*rows, *odd])).collect()}

    def base(t):
        w, t = words(t), t or ""
        runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        seen, covered = Counter(runs), [False] * len(w)
        for i, x in enumerate(runs):
            if seen[x] > 1:
                covered[i : i + 8] = [True] * 8
        own = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(own) - len(set(own)), sum(covered)

    for d, t in [*rows, *odd]:
        x = out[d]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == base(t)
        assert x["base_failed"] == (x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"])
    assert not out[900]["kept"] and not out[901]["kept"] and not out[903]["kept"]
    assert np.mean([out[d]["kept"] for d, _ in rows]) > 0.97
    assert quality.quality(docs_of(spark, rows).limit(0)).isEmpty()


def test_quality_outlier_of_each_statistic(spark):
    """A text otherwise at the centre goes for each of the five statistics alone."""
    r = random.Random(6)
    word = lambda n=None: "".join(r.choice("abcdefghij") for _ in range(n or r.randint(3, 8)))
    line = lambda: " ".join(word() for _ in range(12))
    rows = [(i, "\n".join(line() for _ in range(r.choice((7, 8, 9, 10, 11))))) for i in range(300)]
    short = "\n".join(" ".join(word() for _ in range(6)) for _ in range(2)) + "\n" + " ".join(word() for _ in range(8))
    passage, twice = line(), f"{word()} {word()}"
    odd = {
        "x_words": [short, "\n".join(line() for _ in range(200))],
        "x_length": ["\n".join(" ".join(word(30) for _ in range(12)) for _ in range(9))],
        "x_symbols": ["\n".join(line() + " ####" for _ in range(9))],
        "x_lines": ["\n".join(f"{' '.join(word() for _ in range(7))}\n{twice}" for _ in range(12))],
        "x_repeat": ["\n".join([line(), f"{word()} {passage}", line(), line(), f"{passage} {word()}", line(), line(), line()])],
    }
    flat = [(f"{k} {i}", t) for k, ts in odd.items() for i, t in enumerate(ts)]
    out = {r["doc_id"]: r for r in quality.quality(docs_of(spark, [*rows, *((1000 + n, t) for n, (_, t) in enumerate(flat))])).collect()}
    assert np.mean([out[d]["kept"] for d, _ in rows]) > 0.97
    assert {k: (out[1000 + n]["base_failed"], out[1000 + n]["kept"]) for n, (k, _) in enumerate(flat)} == {k: (False, False) for k, _ in flat}


def test_quality_is_native(spark, rows):
    plan = quality.quality(docs_of(spark, rows))._jdf.queryExecution().toString() + licenses.scan_licenses(docs_of(spark, rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this. The above copyright notice and this permission notice shall be included in all copies. The software is provided \"as is\"."
    rows = [(1, mit), (2, "Bla. Licensed under the Apache License, Version 2.0.\nAll rights reserved."), (3, None), (4, "permission to think"), (5, "Licensed under CC BY-NC 4.0."), (6, "This work is licensed under the GNU General Public License, version 3."), (7, ""), (None, "Released under the MIT License.")]
    out = {r["doc_id"]: r["licences"] for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert out == {1: ["MIT"], 2: ["Apache-2.0", "Reserved"], 3: [], 4: [], 5: ["CC-BY-NC"], 6: ["GPL-3.0"], 7: [], None: ["MIT"]}


LICENCE_SENTENCES = {
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of it.",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose is granted.",
    "mit_notice": "The above copyright notice and this permission notice shall be included in copies.",
    "bsd_redistribution": "Redistribution and use in source and binary forms are permitted.",
    "bsd_source": "Redistributions of source code must retain the above copyright notice.",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice.",
    "bsd_endorse": "Neither the name of X nor others may be used to endorse or promote products.",
    "as_is": "This software is provided 'as is'.",
    "apache2_conditions": "You may not use this file except in compliance with the License.",
    "apache2_obtain": "You may obtain a copy of the License at",
    "apache2_limits": "Unless required by applicable law or agreed to in writing it is so.",
    "apache2": "Distributed under Apache 2.0.",
    "agpl3": "This is AGPLv3.",
    "lgpl3": "This is LGPLv3.",
    "lgpl2": "This is LGPL.",
    "gpl3": "This code is GPLv3.",
    "gpl2": "This code is GPLv2.",
    "gpl": "See the GNU General Public License.",
    "mpl2": "Under the Mozilla Public License.",
    "cc_by_nc_sa": "Texts are CC BY-NC-SA.",
    "cc_by_nc_nd": "Texts are CC BY-NC-ND.",
    "cc_by_nc": "Texts are Attribution-NonCommercial.",
    "cc_by_sa": "Available under CC BY-SA 4.0.",
    "cc_by_nd": "Texts are CC BY-ND.",
    "cc_by": "Texts are CC BY.",
    "cc0": "Texts are CC0.",
    "bsd3": "Code is BSD 3-Clause.",
    "bsd2": "Code is 2-clause BSD.",
    "mit": "Licensed under MIT.",
    "isc": "Under the ISC License.",
    "unlicense": "It was released into the public domain.",
    "reserved": "All rights reserved.",
}


def test_licenses_each_sentence(spark):
    """One sentence for each known one, some of them without a word of the SQL's filter."""
    assert set(LICENCE_SENTENCES) == {i for i, _ in licenses.SENTENCES} - {"spdx"}
    out = {r["doc_id"]: r["sentence_ids"] for r in licenses.scan_licenses(spark.createDataFrame(list(LICENCE_SENTENCES.items()), "doc_id string, text string")).collect()}
    assert out == {i: [i] for i in LICENCE_SENTENCES}


def test_licenses_spdx(spark):
    tag = "// SPDX-License-Identifier: "
    rows = {"Apache-2.0": (["Apache-2.0"], ""), "MIT */": (["MIT"], ""), "(MIT OR Apache-2.0) AND BSD-3-Clause": (["MIT", "BSD-3-Clause", "Apache-2.0"], ""), "GPL-2.0-or-later WITH Classpath-exception-2.0": (["GPL-2.0"], ""), "LGPL-2.1+": (["LGPL-2.1"], ""), "CC-BY-SA-4.0 for texts": (["CC-BY-SA"], ""), "MIT-0": ([], "<spdx>"), "": ([], "<spdx>")}
    out = {r["doc_id"]: (r["licences"], r["unmatched"]) for r in licenses.scan_licenses(spark.createDataFrame([(x, tag + x) for x in rows], "doc_id string, text string")).collect()}
    assert out == rows


WRAPPED = {
    "MIT": """MIT License

Copyright (c) 2020 X

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files, to deal in it,
subject to the following conditions:

The above copyright notice and this permission
notice shall be included in all copies or substantial portions.

THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND
THE AUTHOR DISCLAIMS ALL WARRANTIES""",
    "BSD-3-Clause": """Copyright (c) 2020, X
Redistribution and use in source and
binary forms, with or without modification, are permitted provided that the
following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above
   copyright notice.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS
AND CONTRIBUTORS "AS IS" AND ANY WARRANTIES ARE DISCLAIMED.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
}


def test_licenses_wrapped(spark):
    """Whole notices over several lines, plain and in comments, and lines without sentence ends that stay apart."""
    comment = lambda t, mark: "\n".join(f"{mark} {x}".rstrip() for x in t.split("\n"))
    rows = [(f"{k}{m}", comment(t, m) if m else t) for k, t in WRAPPED.items() for m in ("", "#", " *", "//")]
    apart = {"Licensed under CC BY 4.0\nAll rights reserved\nMIT License": ["cc_by", "reserved", "mit"], "GNU General Public License\n\n3 files": ["gpl"], "GNU General Public License\n3. Terms": ["gpl"]}
    out = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame([*rows, *((t, t) for t in apart)], "doc_id string, text string")).collect()}
    for k in WRAPPED:
        for m in ("", "#", " *", "//"):
            assert out[k + m]["licences"] == [k] and out[k + m]["unmatched"] == "", (k, m, out[k + m])
    assert {t: out[t]["sentence_ids"] for t in apart} == apart


@pytest.mark.parametrize("operator", [packing.pack_documents, jaccard.similarity_components, lines.dedup_lines, substrings.dedup_substrings, secrets.scan_secrets, licenses.scan_licenses])
def test_empty_tables(spark, rows, operator):
    assert operator(docs_of(spark, rows).limit(0)).isEmpty()
