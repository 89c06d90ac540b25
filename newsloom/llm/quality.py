"""Robust multivariate outliers as a quality rule, in DataFrame functions only.

Per text: word and symbol counts, repeated lines and repeated five-word windows. Per language and source: the minimum
covariance determinant estimate of a vector of transformed statistics, and rejection of rows whose Mahalanobis distance is
beyond a cutoff.

The estimate: of several starts (median and median deviations, correlations of spatial signs, correlations of hyperbolic
tangents, the inner half, and DRAWS sets of some DRAWN rows that a hash picks) each goes through concentration steps (keep the COVERAGE share of rows nearest to the estimate,
estimate again) until its determinant falls no more; the start of least determinant is taken, and estimated once more from the
rows within the 97.5 % quantile. Covariances are scaled to be consistent for normal rows and have the square of a least
deviation added to their diagonal.
The cutoff is the chi-square quantile of as many degrees of freedom as there are components at 1 - LEVEL: of normal rows, one in
10**10 is rejected.

The vectors are rounded to multiples of 1/1024 and the ranks of distances come from counts of rounded values, so sums and
quantiles don't depend on the order of rows, state per group is bounded, and a hot group is combined before each shuffle.

A group with fewer than MIN_ROWS rows that pass the base rule is judged by the estimate of its language (all its sources), and
if that has fewer, too, by the one of all rows; if all are fewer, there is no estimate and they are kept.

Defined results: null text has no words, counts of 0 and fails the base rule. Null language or source is a group of its own.
Rows that fail the base rule take no part in estimates. Repeated rows and ids are judged row by row. Empty table: no rows.
Other columns are kept, except that the names of statistics below are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import SPACES, forget, shared_dir, stored

#: Share of rows that the estimate is made from, share of normal rows that the cutoff rejects, least rows of a group, most
#: concentration steps, groups up to which a table of estimates is broadcast (some 500 bytes each and start).
COVERAGE, LEVEL, MIN_ROWS, STEPS, FEW = 0.75, 1e-10, 50, 50, 10_000
DRAWS, DRAWN = 6, 12
#: Least standard deviation of each component: below it differences aren't taken as odd.
VECTOR = (("v_words", 0.5), ("v_length", 0.08), ("v_symbols", 0.12), ("v_lines", 0.3), ("v_repeats", 0.3))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _words(text: Column) -> Column:
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))



def _joined(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.xxhash64(x, y))


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with COUNTS (long) of each whole text.

    Repeated windows: hashes of words are joined to hashes of two, four and five. The later of two equal windows has four pairs
    that stand before, so that most texts end with their pairs. Hashes of five are sorted with their places only where two
    are equal; a covered word is counted once, from the gaps between the places of repeated windows.
    """
    base = docs.drop(*(c for c in COUNTS if c in docs.columns and c != text))
    hashed = base.withColumn("__w", _words(F.col(text))).withColumn("__h", F.transform("__w", lambda x: F.xxhash64(x)))
    n = F.size("__h")
    two = hashed.withColumn("__2", F.when(n > 5, _joined(F.slice("__h", 1, n - 1), F.slice("__h", 2, n - 1))))
    again = F.size("__2") - F.size(F.array_distinct("__2")) >= 4
    four = two.withColumn("__4", F.when(again, _joined(F.slice("__2", 1, n - 4), F.slice("__2", 3, n - 4))))
    keys = four.withColumn("__k", F.when(F.size(F.array_distinct("__4")) < F.size("__4"), _joined(F.col("__4"), F.slice("__h", 5, n - 4))))
    odd = keys.withColumn("__s", F.when(F.size(F.array_distinct("__k")) < F.size("__k"), F.sort_array(F.transform("__k", lambda k, i: F.struct(k.alias("k"), i.alias("i"))))))
    twice = F.filter(
        "__s",
        lambda x, j: ((j > 0) & (F.get("__s", j - 1)["k"] == x["k"])) | F.coalesce(F.get("__s", j + 1)["k"] == x["k"], F.lit(False)),
    )
    places = odd.withColumn("__p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__p", lambda p, j: F.least(F.lit(5), F.coalesce(F.get("__p", j + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    content = F.coalesce(F.col(text), F.lit(""))
    lines = places.withColumn("__l", F.when(F.contains(content, F.lit("\n")), F.filter(F.split(content, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")))
    return lines.select(
        *base.columns,
        n.cast("long").alias("n_words"),
        F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count(content, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("__l") - F.size(F.array_distinct("__l")), F.lit(0)).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _grid(x: Column) -> Column:
    return F.round(x * 1024) / 1024


def _vector() -> list[Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        _grid(F.log(n)).alias("v_words"),
        _grid(F.log((F.col("word_chars") + 1) / n)).alias("v_length"),
        _grid(F.log1p(10 * F.col("n_symbols") / n)).alias("v_symbols"),
        _grid(F.log1p(100 * F.col("n_dup_lines") / (n + 20))).alias("v_lines"),
        _grid(F.log1p(10 * F.col("n_repeat_words") / n)).alias("v_repeats"),
    ]


def _above(x: float, df: int) -> float:
    """P(chi-square of df, odd, > x)."""
    out = math.erfc(math.sqrt(x / 2))
    for k in range(1, df, 2):
        out += (x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1)
    return out


def quantile(above: float, df: int = len(VECTOR)) -> float:
    """The chi-square value that a share `above` is beyond."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if _above(middle, df) > above else (low, middle)
    return high


def consistency(share: float, df: int = len(VECTOR)) -> float:
    """What the covariance of the inner `share` of normal rows is multiplied by."""
    return share / (1 - _above(quantile(1 - share, df), df + 2))


_NAMES = [c for c, _ in VECTOR]
_PAIRS = [(i, j) for i in range(len(VECTOR)) for j in range(i + 1)]
_KEY = ["k0", "k1"]


def _factored(sums: DataFrame, key: list[str], factor: float) -> DataFrame:
    """Means m{i}, inverse factors w{i}{j} and log determinants of the covariances of sums n, s{i}, q{i}{j}."""
    cov = {(i, j): F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n")) for i, j in _PAIRS}
    out = sums.select(*key, *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(len(VECTOR))], *[(c * factor + (VECTOR[i][1] ** 2 if i == j else 0)).alias(f"c{i}{j}") for (i, j), c in cov.items()])
    return _cholesky(out, key)


def _cholesky(covariances: DataFrame, key: list[str]) -> DataFrame:
    """Means, the inverse w{i}{j} of the Cholesky factor of c{i}{j}, and the log determinant. Each column uses those before it."""
    out = []
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out.append((F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")).alias(f"l{i}{j}"))
    for i, j in _PAIRS:
        solved = F.lit(1.0) if i == j else F.lit(0.0)
        for k in range(j, i):
            solved = solved - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
        out.append((solved / F.col(f"l{i}{i}")).alias(f"w{i}{j}"))
    means = [f"m{i}" for i in range(len(VECTOR))]
    size = sum((F.log(f"l{i}{i}") for i in range(1, len(VECTOR))), F.log("l00"))
    return covariances.select(*key, *means, *out, (2 * size).alias("size")).select(*key, *means, *[f"w{i}{j}" for i, j in _PAIRS], "size")


def _sums(values: list[Column]) -> list[Column]:
    return [F.count("*").alias("n"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(values)], *[F.sum(values[i] * values[j]).alias(f"q{i}{j}") for i, j in _PAIRS]]


def _distance(rows: DataFrame, models: DataFrame, how: str, kind: str = "inner") -> DataFrame:
    """rows, for each model of their key, with its columns besides the estimate and d2, the squared Mahalanobis distance."""
    solved = []
    for i in range(len(VECTOR)):
        parts = [F.col(f"w{i}{j}") * (F.col(_NAMES[j]) - F.col(f"m{j}")) for j in range(i + 1)]
        solved.append(F.pow(sum(parts[1:], parts[0]), F.lit(2.0)))
    more = [c for c in models.columns if c not in _KEY and c[0] not in "mw" and c != "size"]
    return rows.join(models.hint(how), _KEY, kind).select(*rows.columns, *more, sum(solved[1:], solved[0]).alias("d2"))


def _inner(rows: DataFrame, models: DataFrame, how: str, share: float) -> DataFrame:
    """Estimates of each model's inner `share` of rows, with ties of the rounded log distance: rows are summed up by distance first."""
    key = [*_KEY, "start"]
    far = _distance(rows, models, how).withColumn("level", F.round(F.log(F.col("d2") + 1e-9) * 32).cast("int"))
    shells = far.groupBy(*key, "level").agg(*_sums([F.col(c) for c in _NAMES]))
    group = Window.partitionBy(*key)
    before = F.coalesce(F.sum("n").over(group.orderBy("level").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = shells.withColumn("before", before).withColumn("whole", F.sum("n").over(group)).where(F.col("before") < share * F.col("whole"))
    sums = [c for c in shells.columns if c not in (*key, "level")]
    return _factored(kept.groupBy(*key).agg(*[F.sum(c).alias(c) for c in sums]), key, consistency(share))


def _starts(rows: DataFrame, how: str, folder: str) -> DataFrame:
    """(k0, k1, start, estimate): several first estimates of each key."""
    centre = stored(rows.groupBy(*_KEY).agg(*[F.percentile(c, F.lit(0.5)).alias(f"m{i}") for i, c in enumerate(_NAMES)]), folder)
    spread_of = rows.join(centre.hint(how), _KEY).groupBy(*_KEY)
    wide = [F.percentile(F.abs(F.col(c) - F.col(f"m{i}")), F.lit(0.5)).alias(f"r{i}") for i, c in enumerate(_NAMES)]
    scale = [F.sqrt(F.pow(F.col(f"r{i}") * 1.4826, 2) + VECTOR[i][1] ** 2).alias(f"d{i}") for i in range(len(VECTOR))]
    robust = stored(centre.join(spread_of.agg(*wide), _KEY).select(*_KEY, *[f"m{i}" for i in range(len(VECTOR))], *scale), folder)
    key = [*_KEY, "start"]
    plain = robust.select(*_KEY, F.lit(0).alias("start"), *[f"m{i}" for i in range(len(VECTOR))], *[(F.pow(F.col(f"d{i}"), 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    first = _cholesky(plain, key)
    near = rows.join(robust.hint(how), _KEY)
    near = near.select(*_KEY, *[((F.col(c) - F.col(f"m{i}")) / F.col(f"d{i}")).alias(f"z{i}") for i, c in enumerate(_NAMES)])
    length = F.sqrt(sum((F.pow(F.col(f"z{i}"), 2) for i in range(len(VECTOR))), F.lit(1e-12)))
    turned = near.select(*_KEY, F.explode(F.array(*[F.struct(F.lit(s).alias("start"), *[x.alias(f"u{i}") for i, x in enumerate(u)]) for s, u in ((1, [F.col(f"z{i}") / length for i in range(len(VECTOR))]), (2, [F.tanh(f"z{i}") for i in range(len(VECTOR))]))])).alias("u"))
    shape = turned.groupBy(*_KEY, F.col("u.start").alias("start")).agg(*_sums([F.col(f"u.u{i}") for i in range(len(VECTOR))]))
    centred = {(i, j): F.col(f"q{i}{j}") / F.col("n") - F.col(f"s{i}") / F.col("n") * (F.col(f"s{j}") / F.col("n")) + (0.01 if i == j else 0) for i, j in _PAIRS}
    other = shape.join(robust.hint(how), _KEY).select(*key, *[f"m{i}" for i in range(len(VECTOR))], *[(c * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"c{i}{j}") for (i, j), c in centred.items()])
    first = stored(first, folder)
    half = _inner(rows, first, how, 0.5).withColumn("start", F.lit(3))
    sizes = rows.groupBy(*_KEY).agg(F.count("*").alias("size"))
    drawn = rows.join(sizes.hint(how), _KEY).withColumn("start", F.explode(F.array(*[F.lit(4 + k) for k in range(DRAWS)])))
    drawn = drawn.where(F.pmod(F.xxhash64("start", *_NAMES), F.col("size")) < DRAWN).groupBy(*key).agg(*_sums([F.col(c) for c in _NAMES]))
    return stored(first.unionByName(_cholesky(other, key)).unionByName(half).unionByName(_factored(drawn, key, 1.0)), folder)


def estimates(rows: DataFrame, how: str, folder: str, coverage: float = COVERAGE, steps: int = STEPS) -> DataFrame:
    """(k0, k1, m0.., w00..): the minimum covariance determinant estimate of rows (k0, k1, vector) of each key."""
    key = [*_KEY, "start"]
    now = stored(_inner(rows, _starts(rows, how, folder), how, coverage).withColumn("falls", F.lit(True)), folder)
    values = [c for c in now.columns if c not in (*key, "falls")]
    for _ in range(steps):
        after = _inner(rows, now.where("falls").drop("falls"), how, coverage).select(*key, *[F.col(c).alias(f"{c}_") for c in values])
        falls = F.coalesce(F.col("size_") < F.col("size") - 1e-9, F.lit(False))
        before, now = now, stored(now.join(after.hint(how), key, "left").select(*key, *[F.when(falls, F.col(f"{c}_")).otherwise(F.col(c)).alias(c) for c in values], falls.alias("falls")), folder)
        forget(rows.sparkSession, before)
        if now.where("falls").isEmpty():
            break
    best = now.groupBy(*_KEY).agg(F.min_by(F.struct(*values), F.struct("size", "start")).alias("x")).select(*_KEY, "x.*")
    inside = _distance(rows, best.drop("size"), how).where(F.col("d2") <= quantile(0.025))
    again = _factored(inside.groupBy(*_KEY).agg(*_sums([F.col(c) for c in _NAMES])), _KEY, consistency(0.975))
    return stored(again.drop("size"), folder)


def _keys(sound: DataFrame, group: list[str], min_rows: int, folder: str) -> DataFrame:
    """(group, use, feeds): the key of the estimate that judges a group, and the keys of all estimates that it is part of."""
    sizes = stored(sound.groupBy(*[F.col(c).alias(k) for c, k in zip(group, ("g0", "g1"), strict=True)]).agg(F.count("*").alias("n")), folder)
    langs = sizes.groupBy("g0").agg(F.sum("n").alias("in_lang"), F.min("n").alias("least"))
    total = langs.agg(F.coalesce(F.sum("in_lang"), F.lit(0)).alias("n"), F.coalesce(F.min("in_lang"), F.lit(0)).alias("least")).first()
    own, lang, whole = (F.struct(F.lit(x).alias("k0") if isinstance(x, str) else x.alias("k0"), y.alias("k1")) for x, y in ((F.col("g0"), F.col("g1")), (F.col("g0"), F.lit("*")), ("*", F.lit("*"))))
    all_of = F.when(F.lit(total["least"] < min_rows <= total["n"]), whole)
    use = F.when(F.col("n") >= min_rows, own).when(F.col("in_lang") >= min_rows, lang).otherwise(all_of)
    feeds = F.array_compact(F.array(F.when(F.col("n") >= min_rows, own), F.when((F.col("least") < min_rows) & (F.col("in_lang") >= min_rows), lang), all_of))
    return stored(sizes.join(langs.hint("merge"), "g0").select(F.col("g0").alias(group[0]), F.col("g1").alias(group[1]), use.alias("use"), feeds.alias("feeds")), folder)


def verdicts(stats: DataFrame, group: list[str], coverage: float = COVERAGE, level: float = LEVEL, min_rows: int = MIN_ROWS, steps: int = STEPS) -> DataFrame:
    """stats (with COUNTS and two group columns of strings without nulls) with base_failed, d2 and kept. stats is read several times."""
    folder = shared_dir(stats.sparkSession)
    rows = stats.withColumn("base_failed", base_failed()).select("*", *_vector())
    sound = rows.where(~F.col("base_failed")).select(*group, *_NAMES)
    keys = _keys(sound, group, min_rows, folder)
    how = "broadcast" if keys.count() <= FEW else "merge"
    fed = stored(sound.join(keys.select(*group, "feeds").hint(how), group).select(F.explode("feeds").alias("k"), *_NAMES).select("k.*", *_NAMES), folder)
    model = estimates(fed, how, folder, coverage, steps)
    keyed = rows.join(keys.select(*group, "use.*").hint(how), group, "left")
    judged = _distance(keyed, model, how, "left")
    verdict = ~F.col("base_failed") & (F.coalesce(F.col("d2"), F.lit(0.0)) <= quantile(level))
    return judged.withColumn("kept", verdict).drop(*_NAMES, *_KEY)


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] = ("doc_id",), **options) -> DataFrame:
    """docs' `keep` columns with COUNTS, base_failed, d2 and kept. Statistics are computed once and stored."""
    keys = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")).alias(f"__g{i}") for i, c in enumerate((lang, source))]
    picked = docs.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], *keys, F.col(text).alias("__text"))
    stats = stored(counts(picked, "__text").drop("__text"))
    judged = verdicts(stats, ["__g0", "__g1"], **options)
    return judged.select(*[F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)], *COUNTS, "base_failed", "d2", "kept")
