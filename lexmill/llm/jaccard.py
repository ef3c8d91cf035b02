"""Operator 1: exact n-gram Jaccard join by PartEnum signatures.

A document's set has the hashes of its word shingles.  Sets are put in bands of about equal size; in
a band, a similarity of num/den or more leaves at most k shingles in which two sets differ.  The
domain of hashes is cut into n1 first-level parts of n2 second-level parts each, and a signature is
made for every way to leave out k2 of a part's n2: since n1 (k2 + 1) > k, two such sets must share
one.  Some first-level parts are added, so that enough signatures agree even without those over no
shingle at all, which are dropped; a set with too many of them keeps them.

Links are then found without listing all pairs of a group: sets that share a signature are first
compared with its smallest one only, within each lot of rows that a task signs and then between lots,
so that no signature gathers all its sets in one place.  Where members of a signature still lie in different components,
these are compared, in blocks, by a sketch that can only underestimate their difference, and what is
left exactly.  So every link between different components is seen, and components are exact.

Edge cases: a text with fewer words than a shingle is one shingle; without words, or null, the set is
empty and the row its own component; null ids are carried (their component is the smallest id that is
not null); rows with the same id stay apart as rows; an empty table gives an empty result.  Sets are
known by 64-bit hashes, shingles too.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import discard, drop_finished_shuffles, fields_of, materialise, packed
from ._words import Words, join, mix, slices, windows
from .components import connected_components

#: Members of one signature that are compared in one task; larger groups are dealt over pairs of blocks.
BLOCK = 700


@functools.lru_cache(64)
def bands(num: int, den: int, up_to: int) -> list[tuple[int, int, int]]:
    """(smallest, largest, k): sizes of each band, and in how many shingles two sets of it may differ.

    Sets of a band are also compared with those of the band below.
    """
    out, low = [], 1
    while low <= up_to:
        high = low * den // num
        out.append((low, high, 2 * high * (den - num) // (den + num)))
        low = high + 1
    return out


@functools.lru_cache(4096)
def layout(low: int, k: int) -> tuple[int, int, int, int]:
    """(n1, n2, k2, spare): two second-level parts of which one is left out where parts have many
    shingles, else two of four; spare first-level parts make up for those with none."""
    n2, k2 = (2, 1) if 2 * low >= 5 * (k + 1) else (4, 2)
    n1 = k // (k2 + 1) + 1
    empty = n1 * math.comb(n2, k2) * math.exp(-low * (n2 - k2) / (n1 * n2))
    spare = math.ceil(empty + 4 * math.sqrt(empty) + 1)
    return n1 + spare, n2, k2, spare


@functools.lru_cache(64)
def _subsets(n2: int, k2: int) -> np.ndarray:
    from itertools import combinations

    out = np.zeros((math.comb(n2, k2), n2), bool)
    for row, gone in zip(out, combinations(range(n2), k2), strict=True):
        row[:] = True
        row[list(gone)] = False
    return out


def signatures(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of a sorted set of 64-bit hashes, for its own band and the next."""
    n = len(shingles)
    bands_ = bands(num, den, max(64, 1 << (2 * n).bit_length()))
    own = next(j for j, b in enumerate(bands_) if b[1] >= n) if n < 64 else int(np.searchsorted(_highs(num, den, bands_[-1][1]), n))
    sums, out = np.zeros(n + 1, "u8"), []
    np.cumsum(mix(shingles), out=sums[1:])
    for j in (own, own + 1):
        low, _, k = bands_[j]
        if not k:  # only equal sets are this similar
            continue
        n1, n2, k2, spare = layout(int(low * num / den) if j else low, k)
        parts = n1 * n2
        cuts = np.arange(1, parts, dtype="u8") * np.uint64(2**64 // parts)
        edges = np.concatenate([[0], np.searchsorted(shingles, cuts), [n]])
        part_sum = (sums[edges[1:]] - sums[edges[:-1]]).reshape(n1, n2)
        part_n = np.diff(edges).reshape(n1, n2)
        subsets = _subsets(n2, k2)
        seeds = mix(np.uint64(j << 32) + np.arange(n1 * len(subsets), dtype="u8")).reshape(n1, -1)
        total = (part_sum[:, None, :] * subsets[None]).sum(axis=2, dtype="u8")
        full = (part_n[:, None, :] * subsets[None]).sum(axis=2) > 0
        found = mix(total + seeds)
        out.append(found[full] if (~full).any(axis=1).sum() <= spare else found.reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, "u8")


@functools.lru_cache(64)
def _highs(num: int, den: int, up_to: int) -> np.ndarray:
    return np.array([b[1] for b in bands(num, den, up_to)])


def sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of n/2 to n cells of the domain, one byte: 6 bits of its hashes' sum and 2 of their number."""
    cells = max(64, 1 << (len(shingles) // 2).bit_length())
    cut = np.searchsorted(shingles, np.arange(1, cells, dtype="u8") * np.uint64(2**64 // cells))
    sums = np.zeros(len(shingles) + 1, "u8")
    np.cumsum(mix(shingles), out=sums[1:])
    edges = np.concatenate([[0], cut, [len(shingles)]])
    return (((sums[edges[1:]] - sums[edges[:-1]]) & np.uint64(63)) << np.uint64(2) | (np.diff(edges) & 3).astype("u8")).astype("u1")


def fold(cells: np.ndarray, n: int) -> np.ndarray:
    """A sketch of n cells, from one of a multiple."""
    wide = cells.reshape(n, -1)
    return (((wide >> 2).sum(axis=1, dtype="u1") & 63) << 2 | (wide & 3).sum(axis=1, dtype="u1") & 3).astype("u1")


#: By the difference of two cells' numbers modulo 4, and whether the cells differ: shingles in only one at least.
_LEAST = np.array([[0, 1, 2, 1], [2, 1, 2, 1]], "u1")


def least_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many shingles two sets differ at least, by their sketches of as many cells."""
    return _LEAST[(a != b).astype("u1"), ((a & 3) - (b & 3)) & 3].sum(axis=-1, dtype="i8")


def shingle_sets(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text; words are lower-cased in A-Z."""
    data, begins = join(texts)
    words = Words(data, begins, lower=True)
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        h = words.hashes[a:b]
        yield np.unique(windows(h, min(size, len(h)))) if len(h) else h


def _set_id(shingles: np.ndarray) -> int:
    return int(mix(np.array([shingles.sum(dtype="u8") + np.uint64(len(shingles))], "u8")).view("i8")[0])


def _profile(size: int):
    """Row columns with n_shingles and node, and for the first of equal sets in a task its sketch, whole and folded by half."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            at = 0
            for texts in slices(batch.column("_text").to_pylist()):
                part = batch.slice(at, len(texts))
                at += len(texts)
                n, ids, fine, half = [], [], [], []
                for s in shingle_sets(texts, size):
                    node, cells = (_set_id(s), None) if len(s) else (None, None)
                    if node is not None and node not in seen:
                        seen.add(node)
                        cells = sketch(s)
                    n.append(len(s))
                    ids.append(node)
                    fine.append(None if cells is None else cells.tobytes())
                    half.append(None if cells is None else fold(cells, len(cells) // 2).tobytes())
                kept = [k for k, name in enumerate(part.schema.names) if name != "_text"]
                new = [pa.array(n, pa.int64()), pa.array(ids, pa.int64()), pa.array(fine, pa.binary()), pa.array(half, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in kept), *new], names=[*(part.schema.names[k] for k in kept), "n_shingles", "node", "fine", "half"])

    return run


def _combined(sigs: list[np.ndarray], nodes: list[int]) -> pa.RecordBatch:
    """One row (key = signature, smallest node) for each signature, and for those that several sets share here
    a row (key of its own, node, low = smallest node, signature) for each of them.  Nulls cost next to nothing
    in a shuffle file."""
    all_sig = np.concatenate([*sigs, np.zeros(0, "u8")]).view("i8")
    all_node = np.repeat(np.array(nodes, "i8"), [len(x) for x in sigs])
    order = np.lexsort((all_node, all_sig))
    sig, node = all_sig[order], all_node[order]
    begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])) if len(sig) else np.zeros(0, "i8")
    count = np.diff(np.append(begin, len(sig)))
    several = np.repeat(count > 1, count)
    # Rows of one set stay together, so that shuffle files compress well.
    one = np.sort(order[begin])
    none, sig, node = pa.nulls(len(one), pa.int64()), sig[several], node[several]
    low = pa.array(np.repeat(all_node[order[begin]], count)[several])
    own = mix(sig.view("u8") ^ mix(node.view("u8"))).view("i8")
    columns = [pa.array(np.concatenate([all_sig[one], own])), pa.array(np.concatenate([all_node[one], node])), pa.concat_arrays([none, low]), pa.concat_arrays([none, pa.array(sig)])]
    return pa.RecordBatch.from_arrays(columns, names=["key", "node", "low", "sig"])


def _sign(size: int, num: int, den: int, rows: int = 500_000):
    """Signatures of each distinct set in a task, combined by about so many rows: a signature that a third of
    all sets have makes only one row of each such lot meet in one place."""

    def run(batches):
        seen: set[int] = set()  # copies within a task are signed once
        sigs, nodes, held = [], [], 0
        for batch in batches:
            for part in slices(batch.column("_text").to_pylist()):
                for s in shingle_sets(part, size):
                    if len(s) and (node := _set_id(s)) not in seen:
                        seen.add(node)
                        sigs.append(signatures(s, num, den))
                        nodes.append(node)
                        held += len(sigs[-1])
                if held >= rows:
                    yield _combined(sigs, nodes)
                    sigs, nodes, held = [], [], 0
        yield _combined(sigs, nodes)

    return run


def _whole(size: int):
    """(node, data) once for each node in a task: the bytes of the set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch.column("_text").to_pylist(), 100):
                rows = []
                for s in shingle_sets(part, size):
                    if len(s) and (node := _set_id(s)) not in seen:
                        seen.add(node)
                        rows.append((node, s.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "data"])

    return run


def _may_link(n: np.ndarray, m: int, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of n and m shingles that differ in so many or more can reach num/den."""
    return ((den + num) * differ <= (den - num) * (n + m)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))


def _exact_filter(num: int, den: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("da"), batch.column("db"), strict=True):
                x, y = np.frombuffer(a.as_py(), "u8"), np.frombuffer(b.as_py(), "u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _near_pairs(num: int, den: int):
    """Pairs of members of a group, of different roots, whose sketches allow a link.

    Rows come sorted by group: (group, side, node, root, n, data); side 0 is compared with side 1, or
    with itself where all are 0.
    """

    def compare(group: pa.RecordBatch):
        side = group.column("side").to_numpy()
        node, root, n = (group.column(c).to_numpy() for c in ("node", "root", "n"))
        raw = [np.frombuffer(x.as_py(), "u1") for x in group.column("data")]
        size = np.array([len(x) for x in raw])
        one = not side.any()
        # Sketches of one size are compared at once, with those of each other size at the smaller one.
        stacks = {c: (np.flatnonzero(size == c), np.stack([raw[k] for k in np.flatnonzero(size == c)])) for c in np.unique(size).tolist()}
        for i in np.flatnonzero(side == 0).tolist():
            for c, (at, cells) in stacks.items():
                good = (side[at] == 1) if not one else (at > i)
                good &= (root[at] != root[i]) & (den * np.minimum(n[at], n[i]) >= num * np.maximum(n[at], n[i]))
                if good.any():
                    j, own = at[good], cells[good]
                    m = min(c, int(size[i]))
                    if c > m:
                        own = np.stack([fold(x, m) for x in own])
                    j = j[_may_link(n[j], int(n[i]), least_difference(own, fold(raw[i], m)), num, den)]
                    yield from ((int(node[i]), int(node[k])) for k in j)

    def run(batches):
        rest, seen = None, set()

        def out(group):
            if len(seen) > 1 << 18:
                seen.clear()
            # A pair that shares several signatures of a task is told once.
            pairs = [p for p in compare(group) if p not in seen] if group.num_rows > 1 else []
            seen.update(pairs)
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if not table:
                continue
            own = table[0]
            group = own.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield out(own.slice(a, b - a))
            rest = own.slice(edges[-1])
        if rest is not None and rest.num_rows:
            yield out(rest)

    return run


def similarity_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, block: int = BLOCK, pivots: int = 2) -> DataFrame:
    """docs' columns but text, with n_shingles and component_id, the smallest doc_id reachable by links.

    Two rows link when den * intersection >= num * union of their sets of ``size``-word shingles.  block and
    pivots (further rounds of stars) change the work and how it is dealt, never the result.
    """
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("_text"))
    keyed = packed(docs, ("n_shingles", "component_id")).select("_row", F.col("_row.doc_id").cast("long").alias("doc_id"), "_text", F.xxhash64("_text").alias("_key"))
    profile = materialise(keyed.mapInArrow(_profile(size), ", ".join([*fields_of(keyed, ("_text",)), "n_shingles long, node long, fine binary, half binary"])), "profile")

    # One shuffle of all signatures; those of a single set end here.  Rows combined before are spread.
    signed = text.mapInArrow(_sign(size, num, den), "key long, node long, low long, sig long")
    by_key = Window.partitionBy("key")
    shared = signed.withColumns({"first": F.min("node").over(by_key), "last": F.max("node").over(by_key)}).filter(F.col("low").isNotNull() | (F.col("first") != F.col("last")))
    shared = materialise(shared.select(F.coalesce("sig", "key").alias("sig"), "node", F.coalesce("low", "first").alias("pivot")).distinct(), "shared")
    del signed
    drop_finished_shuffles(spark)

    def near(dealt: DataFrame, data: str) -> DataFrame:
        """Pairs of dealt (group, side, node, root) that sketches don't rule out."""
        cells = profile.filter(F.col(data).isNotNull()).select("node", F.col("n_shingles").alias("n"), F.col(data).alias("data")).dropDuplicates(["node"])
        wide = dealt.join(cells, "node").select("group", "side", "node", "root", "n", "data")
        return materialise(wide.repartition("group").sortWithinPartitions("group").mapInArrow(_near_pairs(num, den), "a long, b long").distinct(), "near")

    def exact(pairs: DataFrame) -> DataFrame:
        """The pairs that link, by whole sets read again from the texts of one copy each."""
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        wanted = materialise(profile.filter("fine IS NOT NULL").select("node", "_key").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("_key").alias("_key")).select("_key").distinct(), "wanted")
        own = text.withColumn("_key", F.xxhash64("_text")).join(wanted, "_key", "left_semi").select("_text")
        sets = materialise(own.mapInArrow(_whole(size), "node long, data binary").dropDuplicates(["node"]), "sets")
        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("data").alias("da")), "a").join(sets.select(F.col("node").alias("b"), F.col("data").alias("db")), "b")
        links = materialise(both.mapInArrow(_exact_filter(num, den), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")), "links")
        discard(pairs, wanted, sets)
        drop_finished_shuffles(spark)
        return links

    def star_links(stars: DataFrame, data: str) -> DataFrame:
        """Links of (node, root) with their pivots (pivot, pivot_root): a pivot goes to every task that some
        of its members are dealt to, by its number of them."""
        stars = materialise(stars, "stars")
        tasks = stars.groupBy("pivot", "pivot_root").agg(F.ceil(F.count("*") / block).cast("int").alias("tasks"))
        members = stars.join(tasks.select("pivot", "tasks"), "pivot").select(F.xxhash64("pivot", F.pmod(F.xxhash64("node"), "tasks").cast("long")).alias("group"), F.lit(1).alias("side"), "node", "root")
        pivots = tasks.select("pivot", "pivot_root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks").cast("long") - 1)).alias("k")).select(F.xxhash64("pivot", "k").alias("group"), F.lit(0).alias("side"), F.col("pivot").alias("node"), F.col("pivot_root").alias("root"))
        found = near(members.union(pivots), data)
        discard(stars)
        drop_finished_shuffles(spark)
        return exact(found)

    def joined_by(roots: DataFrame, links: DataFrame) -> DataFrame:
        """roots with the components that links join; both go."""
        out = connected_components(roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).union(links))
        discard(roots, links)
        return out

    links = star_links(shared.filter("node <> pivot").select("node", F.col("node").alias("root"), "pivot", F.col("pivot").alias("pivot_root")).distinct(), "half")
    roots = connected_components(links)
    discard(links)

    def open_members(roots: DataFrame) -> DataFrame:
        """(sig, node, root, members) of signatures whose members are still in several components."""
        member = shared.select("sig", "node").distinct().join(roots, "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root"))
        open_ = member.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum1"), F.sum(F.xxhash64(F.lit(1), "node").cast("decimal(38,0)")).alias("sum2")).filter("low <> high")
        # Of signatures with the same members one is enough; two sums of hashes tell sets of members apart.
        open_ = open_.groupBy("low", "high", "members", "sum1", "sum2").agg(F.min("sig").alias("sig")).select("sig", "members")
        return materialise(member.join(open_, "sig"), "open")

    # Other pivots, chosen by hash, join most of what belongs together before members are compared with each other.
    member = open_members(roots)
    for k in range(pivots):
        order = F.struct(F.xxhash64("node", F.lit(k)), "node", "root")
        chosen = member.groupBy("sig").agg(F.min(order).alias("p")).select("sig", F.col("p.node").alias("pivot"), F.col("p.root").alias("pivot_root"))
        stars = member.join(chosen, "sig").filter("root <> pivot_root").select("node", "root", "pivot", "pivot_root").distinct()
        roots = joined_by(roots, star_links(stars, "fine"))
        discard(member)
        member = open_members(roots)
    # A member of block b meets every other block once; groups of one block meet themselves.
    member_ = member.withColumn("blocks", F.ceil(F.col("members") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = member_.withColumn("other", other).select(F.xxhash64("sig", F.least("own", "other"), F.greatest("own", "other")).alias("group"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "root")
    crossed = near(dealt, "fine")
    discard(shared, member)
    drop_finished_shuffles(spark)
    roots = joined_by(roots, exact(crossed))

    classed = profile.drop("fine", "half").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Only components of several rows take another row's id: few next to all rows, so no component meets in one task.
    first = classed.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("_first"), F.count("*").alias("n")).filter("n > 1").select("root", "_first")
    first = materialise(first, "first")
    return classed.join(first, "root", "left").withColumn("component_id", F.coalesce("_first", "doc_id")).select("_row.*", "n_shingles", "component_id")


#: DuckDB SQL of op1_jaccard_join: all pairs by shared shingles between distinct sets, components by recursion.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
tok AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS n FROM words),
runs AS (SELECT doc_id, n, i, x, lead(x, 1) OVER p AS y, lead(x, 2) OVER p AS z FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
shingle AS (SELECT DISTINCT doc_id, md5(concat_ws(' ', x, y, z)) AS s FROM runs WHERE i <= greatest(n - 2, 1)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, '' ORDER BY s)) AS k FROM shingle GROUP BY doc_id),
classes AS (SELECT k, n, min(doc_id) AS rep FROM sets GROUP BY k, n),
own AS (SELECT rep, n, s FROM shingle JOIN classes ON rep = doc_id),
edges AS (SELECT l.rep AS a, r.rep AS b FROM own l JOIN own r ON l.s = r.s AND l.rep <> r.rep AND 100 * least(l.n, r.n) >= 90 * greatest(l.n, r.n)
  GROUP BY l.rep, r.rep, l.n, r.n HAVING 100 * count(*) >= 90 * (l.n + r.n - count(*))),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN classes USING (k) LEFT JOIN roots ON a = rep
"""
