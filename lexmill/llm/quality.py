"""Operator 9: quality rules and robust multivariate outliers, with DataFrame functions only.

Each text's statistics become a vector of transformed shares.  Within every language and source a
minimum-covariance-determinant estimate (MCD) of centre and scatter is made: from several starts, on
medians and MADs, concentration steps take mean and covariance of the 75 % of rows that lie nearest so
far, which never raises the determinant; after two steps each group keeps the start of the least
determinant and goes on by itself until its determinant falls no more, then leaves the steps.  The 75 %
are exact: sketches only say between which distances the last of them must lie.  Rows
whose squared Mahalanobis distance from the centre is over the chi-square quantile of 0.999, with the
core's consistency factor, are rejected, besides those that fail the base rules.  The floors of the
scales let a text that is odd in one statistic alone pass that cutoff.
Only sums, quantile sketches and the few distances between those bounds are shuffled, and what is joined
back to the rows is a written table with one row for each group, which Spark broadcasts if its size allows: a
group of any size is spread, and a join makes no more rows than it reads.

Edge cases: a null or empty text has no words and fails the base rules; null languages and sources are
groups like any other; groups under ``min_group`` rows use their language's estimate, or the whole
table's, and where that is too small too nothing is rejected; equal rows and repeated ids stay rows of
their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialise

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
#: Least scale of each transformed statistic, for groups where most rows have the same value.
FLOORS = {"x_words": 0.5, "x_length": 0.3, "x_symbols": 0.5, "x_lines": 1.5, "x_repeat": 1.5}
NAMES = list(FLOORS)
P = len(NAMES)
#: Share of rows in a concentration step, weight of the unit matrix in each covariance.
CORE, RIDGE = 0.75, 0.1
#: Parts of a group's rows by one of which the rank of a sketched quantile may be off.
ACCURACY = 2000
#: Median of a chi-square variable of P = 5 degrees of freedom.
CHI_MEDIAN = 4.3515
#: The covariance of the CORE nearest rows of a normal sample is smaller than that of all rows by this:
#: CORE over the share of a chi-square variable of P + 2 degrees under the CORE quantile of one of P.
CONSISTENCY = 1.4121
#: 0.999 quantile of a chi-square variable of P degrees of freedom.
CUTOFF = 20.515


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many of an array of words lie in windows that it has twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, k: F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e["i"]))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        step = lambda a, i: F.struct((i + window).alias("end"), (a["n"] + i + window - F.greatest(a["end"], i)).alias("n"))
        total = F.aggregate(_let(pairs, twice), zero, step, lambda a: a["n"])
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), total).otherwise(F.lit(0))

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (window - 1))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, window)))
        return F.when(F.size(w) >= window, _let(hashes, covered)).otherwise(F.lit(0))

    return _let(F.transform(words, lambda x: F.xxhash64(x)), of_words).cast("long")


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the base statistics of every text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, SPACES, "")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    both = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))
    dup = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return docs.select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        _let(words, both).alias("w"), _let(lines, dup).alias("l"),
    ).select("doc_id", "lang", "source", "word_chars", "n_symbols", "w.*", "l.*")


def _vector(stats: DataFrame) -> DataFrame:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    return stats.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "x_words": F.log(words.cast("double")),
        "x_length": chars / words,
        "x_symbols": F.log1p(100 * F.col("n_symbols") / chars),
        "x_lines": F.log1p(100 * F.col("n_dup_lines") / lines),
        "x_repeat": F.log1p(100 * F.col("n_repeat_words") / words),
    })


def _cholesky(c: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Steps (name, expression) of the lower triangular factor of the matrix c, each over those before."""
    steps = []
    for i in range(P):
        for j in range(i + 1):
            rest = c[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            steps.append((f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}")))
    return steps


def _estimate(rows: DataFrame) -> DataFrame:
    """Mean m_i and Cholesky factor l_ij of the regularised covariance of z_i, by group."""
    pairs = [(i, j) for i in range(P) for j in range(i + 1)]
    sums = [F.avg(f"z{i}").alias(f"m{i}") for i in range(P)] + [F.avg(F.col(f"z{i}") * F.col(f"z{j}")).alias(f"c{i}{j}") for i, j in pairs]
    out = rows.groupBy("group").agg(*sums)
    c = {(i, j): (1 - RIDGE) * (F.col(f"c{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) + (RIDGE if i == j else 0.0) for i, j in pairs}
    for name, step in _cholesky(c):
        out = out.withColumn(name, step)
    return out.select("group", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i, j in pairs])


def _with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner", *more: str) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance, by forward substitution, and more columns of the estimate."""
    out = rows.join(estimate, "group", how)
    for i in range(P):
        rest = F.col(f"z{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"y{k}")
        out = out.withColumn(f"y{i}", rest / F.col(f"l{i}{i}"))
    d2 = sum((F.col(f"y{i}") * F.col(f"y{i}") for i in range(1, P)), F.col("y0") * F.col("y0"))
    return out.withColumn("d2", d2).select(*rows.columns, "d2", *more)


def core_edges(near: DataFrame) -> DataFrame:
    """group, edge: the least d2 that CORE of a group's rows don't exceed, exactly.

    Sketched quantiles twice their error to both sides of CORE hold the edge between them; the distances
    there are counted (equal ones are one row), with all lesser ones as one more count before them.
    """
    off = 2 / ACCURACY
    sketch = near.groupBy("group").agg(F.count("*").alias("n"), F.percentile_approx("d2", F.array(F.lit(CORE - off), F.lit(CORE + off)), F.lit(ACCURACY)).alias("ends"))
    ends = materialise(sketch.select("group", F.ceil(F.col("n") * CORE).alias("rank"), F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")), "ends")
    between = near.join(ends, "group").filter("d2 <= high").groupBy("group", "rank", F.when(F.col("d2") >= F.col("low"), F.col("d2")).alias("edge")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("group").orderBy(F.col("edge").asc_nulls_first()))
    return between.withColumn("upto", upto).filter("edge IS NOT NULL AND upto >= rank").groupBy("group").agg(F.min("edge").alias("edge"))


#: First distances of the starts, over the robustly scaled z: their squares, absolute values, largest value and
#: the squares of a squashed form, which outliers of different kinds distort in different ways.
STARTS = (
    lambda z: sum(x * x for x in z),
    lambda z: sum(F.abs(x) for x in z),
    lambda z: F.greatest(*[F.abs(x) for x in z]),
    lambda z: sum(F.tanh(x) * F.tanh(x) for x in z),
)


def _spread() -> Column:
    """The logarithm of an estimate's determinant."""
    return 2 * sum((F.log(F.col(f"l{i}{i}")) for i in range(1, P)), F.log("l00"))


def minimum_determinant(z: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """One row for each group of z (group, z_i), a scratch table: centre m_i and factor l_ij of the 75 % core with
    the least determinant found, and the middle of the distances from it.

    A start's steps are those of a group of its own.  A group goes on while its determinant falls by more
    than tolerance.  As no determinant is under that of RIDGE times the unit matrix, all come to rest.
    """

    def step(near: DataFrame, rows: DataFrame) -> DataFrame:
        edges = materialise(core_edges(near), "edges")
        return materialise(_estimate(near.join(edges, "group").filter("d2 <= edge").select(*rows.columns)), "estimate")

    zs = [F.col(f"z{i}") for i in range(P)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("start"), d(zs).alias("d2")) for k, d in enumerate(STARTS)])).alias("s")
    near = z.select("group", *zs, each).select(F.concat_ws("#", F.col("s.start"), "group").alias("group"), *zs, F.col("s.d2").alias("d2"))
    rows = near.drop("d2")
    estimate = step(near, rows)
    estimate = step(_with_distance(rows, estimate), rows)
    columns = [c for c in estimate.columns if c != "group"]
    own = estimate.withColumns({"spread": _spread(), "start": F.split_part("group", F.lit("#"), F.lit(1)), "group": F.regexp_replace("group", "^[0-9]+#", "")})
    best = own.groupBy("group").agg(F.min_by(F.struct(*columns), F.struct("spread", "start")).alias("best"), F.min("spread").alias("spread"))
    found = materialise(best.withColumn("falls", F.lit(True)), "best")
    while not (falling := found.filter("falls")).isEmpty():
        after = step(_with_distance(z, falling.select("group", "best.*")), z).select("group", F.struct(*columns).alias("after"), _spread().alias("now"))
        less = F.col("now") < F.col("spread")
        found = materialise(found.join(after, "group", "left").select(
            "group", F.when(less, F.col("after")).otherwise(F.col("best")).alias("best"), F.when(less, F.col("now")).otherwise(F.col("spread")).alias("spread"),
            F.coalesce(less & (F.col("spread") - F.col("now") > tolerance), F.lit(False)).alias("falls"),
        ), "best")
    estimate = found.select("group", "best.*")
    middle = _with_distance(z, estimate).groupBy("group").agg(F.percentile_approx("d2", F.lit(0.5), F.lit(ACCURACY)).alias("middle"))
    return materialise(estimate.join(middle, "group"), "centre")


def quality(docs: DataFrame, min_group: int = 50, cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, lang, source, the statistics, base_failed, distance (squared, scaled; null if none) and kept."""
    stats = materialise(_vector(text_statistics(docs)), "stats")
    # Groups with enough rows; smaller ones fall back to the language, then to the whole table.
    fine = F.struct(F.lit(2).alias("level"), "lang", "source")
    middle = F.struct(F.lit(1).alias("level"), "lang", F.lit(None).cast("string").alias("source"))
    coarse = F.struct(F.lit(0).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    sizes = materialise(stats.filter(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n")), "sizes")
    by_lang = sizes.groupBy(F.col("lang").alias("g_lang")).agg(F.sum("n").alias("n_lang"))
    n_all = sizes.agg(F.sum("n")).first()[0] or 0
    names = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("g_lang"))).drop("g_lang").withColumn("n_all", F.lit(n_all))
    names = names.withColumn("group", F.when(F.col("n") >= min_group, fine).when(F.col("n_lang") >= min_group, middle).when(F.col("n_all") >= min_group, coarse))
    names = materialise(names.select("lang", "source", F.to_json("group").alias("group")), "groups")
    keyed = stats.join(names.withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")

    own = keyed.filter(~F.col("base_failed") & F.col("group").isNotNull())
    half = materialise(own.groupBy("group").agg(*[F.percentile_approx(x, F.lit(0.5), F.lit(2000)).alias(f"half{i}") for i, x in enumerate(NAMES)]), "half")
    off = own.join(half, "group").select("group", *[F.abs(F.col(x) - F.col(f"half{i}")).alias(x) for i, x in enumerate(NAMES)])
    mad = off.groupBy("group").agg(*[F.percentile_approx(x, F.lit(0.5), F.lit(2000)).alias(f"mad{i}") for i, x in enumerate(NAMES)])
    scale = materialise(half.join(mad, "group").select("group", *[f"half{i}" for i in range(P)], *[F.greatest(1.4826 * F.col(f"mad{i}"), F.lit(f)).alias(f"scale{i}") for i, f in enumerate(FLOORS.values())]), "scale")
    z = own.join(scale, "group").select("group", *[((F.col(x) - F.col(f"half{i}")) / F.col(f"scale{i}")).alias(f"z{i}") for i, x in enumerate(NAMES)])
    centre = minimum_determinant(materialise(z, "z"))
    # A median distance of that of a normal sample at most, so that the cutoff means the same in each group.
    judged = keyed.join(scale, "group", "left").withColumns({f"z{i}": (F.col(x) - F.col(f"half{i}")) / F.col(f"scale{i}") for i, x in enumerate(NAMES)})
    judged = _with_distance(judged, centre, "left", "middle")
    distance = F.when(~F.col("base_failed"), F.col("d2") / CONSISTENCY * CHI_MEDIAN / F.greatest(F.col("middle") / CONSISTENCY, F.lit(CHI_MEDIAN)))
    judged = judged.withColumn("distance", distance)
    return judged.select(*stats.columns, "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).alias("kept"))
