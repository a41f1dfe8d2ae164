"""Quality rules from built-in functions, and robust multivariate outliers per language and source.

Base rules come first. Of what passes them, transformed statistic vectors are compared
with their group (language and source) by a minimum-covariance-determinant estimate:
several starts, each concentrated on the half of the group nearest to it until the
determinant falls no more; the smallest determinant wins, is scaled so that the median
distance is that of the chi-square law, and is fitted once more to all rows within the
97.5 % ellipsoid. A vector whose squared Mahalanobis distance exceeds the chi-square
``quantile`` is rejected.

Only DataFrame functions run: no Python on the executors. A group's fit is a handful of
sums, so a hot source is summed where its rows are; no group is ever collected. Fits are
broadcast only while there are few groups.

Nulls: a null text has no words and fails the base rules; null languages and sources form
groups of their own; a group with too few rows is judged by its language, then by all rows,
and by nothing if these are too few as well. Repeated rows count as often as they occur,
long texts are read whole, extra columns are carried along whatever their names, and an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ponding.llm.common import discard, materialize, table

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]+"
FEATURES = ("f_word", "f_symbol", "f_dup", "f_repeat", "f_upper")
P = len(FEATURES)


def chi_square_cdf(x: float, p: int) -> float:
    """Of ``p`` degrees of freedom (odd), in closed form."""
    out, term = math.erf(math.sqrt(x / 2)), math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, p, 2):
        out -= term
        term *= x / (k + 2)
    return out


def chi_square_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        low, high = ((low + high) / 2, high) if chi_square_cdf((low + high) / 2, p) < q else (low, (low + high) / 2)
    return high


#: The core of the last fit, and how much the scatter inside it falls short of the whole.
INNER = chi_square_quantile(0.975, P)
INNER_TO_WHOLE = 0.975 / chi_square_cdf(INNER, P + 2)
MEDIAN = chi_square_quantile(0.5, P)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def repeated_window_words(words: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the array.

    Where all hashes of windows differ there are none. Else windows are sorted by hash with
    their places; a place counts when a neighbour has its hash.
    """
    n = F.size(words)

    def covered(at: Column) -> Column:
        # Each window covers three words; overlaps count once.
        return F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3)))), F.lit(0), lambda acc, x: acc + x))

    def count(pairs: Column) -> Column:
        hits = F.filter(F.transform(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.when((F.get(pairs, i).h == F.get(pairs, i - 1).h) | ((i > 1) & (F.get(pairs, i - 2).h == F.get(pairs, i - 1).h)), F.get(pairs, i - 1).i)), lambda x: x.isNotNull())
        return let(F.sort_array(hits), covered)

    def repeats(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(placed, count))

    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(n < 4, F.lit(0)).otherwise(let(windows, repeats)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    both = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_window_words(w).alias("r")))
    out = df.withColumn("_w", both).withColumns(
        {
            "n_words": F.col("_w.n"),
            "word_chars": F.length(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", "")).cast("long"),
            "n_symbols": found(SYMBOLS),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": F.col("_w.r"),
            "n_upper": found("[A-Z]+"),
            "n_lines": found("\n+") + 1,
        }
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.drop("_w").withColumn("base_failed", failed)


def vectors(df: DataFrame) -> DataFrame:
    """Adds the transformed statistics: logs and square roots that make clean text near normal.

    Each has a pseudo-count, so that a statistic that is zero in clean text has a scale all the
    same, and one repeated line of a short text is not far out.
    """
    n, chars = F.col("n_words").cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    share = lambda part, whole, more=1.0: F.sqrt((F.col(part) + 0.5) / (whole + more))
    return df.withColumns(
        {
            "f_word": F.log((chars + 1) / (n + 1)),
            "f_symbol": share("n_symbols", chars),
            "f_dup": share("n_dup_lines", F.col("n_lines"), 4.0),
            "f_repeat": F.log((F.col("n_repeat_words") + 6) / (n + 50)),
            "f_upper": share("n_upper", chars),
        }
    )


def cholesky(p: int) -> dict[str, Column]:
    """The lower factor of the scatter s_ij as columns l_ij, in an order in which each needs only earlier ones."""
    out: dict[str, Column] = {}
    for j in range(p):
        for i in range(j, p):
            rest = F.col(f"s_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            out[f"l_{i}_{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}")
    return out


def levels(group: list[str], deepest: int) -> Column:
    """The keys under which a row is fitted: its group, then ever wider ones, down to all rows."""
    depth = len(group)
    return F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(g) if i < depth - k else F.lit(None).cast("string")).alias(g) for i, g in enumerate(group)]) for k in range(deepest + 1)])


#: Smallest scale of each statistic, squared and added to its variance: a statistic that hardly varies rejects nothing by itself.
FLOOR = (0.05, 0.02, 0.06, 0.4, 0.03)
LOWER = [(i, j) for j in range(P) for i in range(j, P)]
FIT_COLUMNS = [*[f"m_{i}" for i in range(P)], *[f"l_{i}_{j}" for i, j in LOWER]]


def with_distance(rows: DataFrame, fits: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Each row with each fit of its keys: the fits' other columns and d2, the squared Mahalanobis distance (null without a fit)."""
    more = [c for c in fits.columns if c not in keys and c not in FIT_COLUMNS]
    renamed = fits.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *more, *FIT_COLUMNS)
    out = rows.join(F.broadcast(renamed) if few else renamed, [rows[k].eqNullSafe(renamed[f"_g_{k}"]) for k in keys], "left")
    for i, f in enumerate(FEATURES):
        rest = F.col(f) - F.col(f"m_{i}")
        for k in range(i):
            rest = rest - F.col(f"l_{i}_{k}") * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", rest / F.col(f"l_{i}_{i}"))
    total = F.col("z_0") * F.col("z_0")
    for i in range(1, P):
        total = total + F.col(f"z_{i}") * F.col(f"z_{i}")
    return out.select(*rows.columns, *more, total.alias("d2"))


SUMS = ["n", *[f"a_{i}" for i in range(P)], *[f"b_{i}_{j}" for i, j in LOWER]]


def sums(values: list[Column]) -> list[Column]:
    """What a fit is made of: the count, sums and products of the values; one partial aggregation."""
    return [F.count(F.lit(1)).alias("n"), *[F.sum(v).alias(f"a_{i}") for i, v in enumerate(values)], *[F.sum(values[i] * values[j]).alias(f"b_{i}_{j}") for i, j in LOWER]]


def scatter(fit: DataFrame, factor: Column | float = 1.0) -> DataFrame:
    """m_i and s_ij from the sums, the scatter times ``factor`` plus the floor."""
    fit = fit.withColumns({f"m_{i}": F.col(f"a_{i}") / F.col("n") for i in range(P)})
    return fit.withColumns({f"s_{i}_{j}": F.lit(factor) * (F.col(f"b_{i}_{j}") / F.col("n") - F.col(f"m_{i}") * F.col(f"m_{j}")) + F.lit(FLOOR[i] ** 2 if i == j else 0.0) for i, j in LOWER})


def factored(fit: DataFrame, keys: list[str]) -> DataFrame:
    """keys, m_i, l_ij and the log of the determinant of the scatter s_ij."""
    for name, value in cholesky(P).items():
        fit = fit.withColumn(name, value)
    log_det = F.lit(0.0)
    for i in range(P):
        log_det = log_det + 2 * F.log(f"l_{i}_{i}")
    return fit.select(*keys, *FIT_COLUMNS, log_det.alias("log_det"))


def starts_of(rows: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Three starts for each group: medians with quartile scales, and with these the correlations of hyperbolic tangents and of spatial signs."""
    q = [F.percentile_approx(f, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"q_{i}") for i, f in enumerate(FEATURES)]
    quartiles = rows.groupBy(*keys).agg(*q)
    at = lambda i, k: F.get(f"q_{i}", F.lit(k))
    quartiles = materialize(quartiles.select(*keys, *[at(i, 1).alias(f"m_{i}") for i in range(P)], *[F.sqrt(F.pow((at(i, 2) - at(i, 0)) / 1.349, F.lit(2.0)) + FLOOR[i] ** 2).alias(f"c_{i}") for i in range(P)]), "quartiles")
    named = quartiles.select(*[F.col(k).alias(f"_g_{k}") for k in keys], *[c for c in quartiles.columns if c not in keys])
    z = rows.join(F.broadcast(named) if few else named, [rows[k].eqNullSafe(named[f"_g_{k}"]) for k in keys]).select(*keys, *[((F.col(f) - F.col(f"m_{i}")) / F.col(f"c_{i}")).alias(f"z_{i}") for i, f in enumerate(FEATURES)])
    norm = F.lit(1e-12)
    for i in range(P):
        norm = norm + F.col(f"z_{i}") * F.col(f"z_{i}")
    z = z.withColumn("norm", F.sqrt(norm))
    products = [F.sum(f(i) * f(j)).alias(f"{name}_{i}_{j}") for name, f in (("t", lambda i: F.tanh(f"z_{i}")), ("u", lambda i: F.col(f"z_{i}") / F.col("norm"))) for i, j in LOWER]
    both = quartiles.withColumnsRenamed({k: f"_g_{k}" for k in keys}).join(z.groupBy(*keys).agg(*products), [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys])
    out = None
    for start, name in enumerate((None, "t", "u")):
        # Correlations are drawn in a little, so that the scatter can be factored however few rows there are.
        r = lambda i, j: F.lit(0.0) if name is None else F.coalesce(F.try_divide(0.99 * F.col(f"{name}_{i}_{j}"), F.sqrt(F.col(f"{name}_{i}_{i}") * F.col(f"{name}_{j}_{j}"))), F.lit(0.0))  # noqa: B023, E731
        own = both.withColumn("start", F.lit(start)).withColumns({f"s_{i}_{j}": F.col(f"c_{i}") * F.col(f"c_{j}") * (F.lit(1.0) if i == j else r(i, j)) for i, j in LOWER})
        own = factored(own, [*keys, "start"])
        out = own if out is None else out.unionByName(own)
    return out


def concentrated(rows: DataFrame, fit: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """For each start the fit of the half of its group that is nearest to it.

    Distances are counted in steps of a sixteenth power of two, so one pass over the rows gives
    both where the half ends and the sums inside it.
    """
    by = [*keys, "start"]
    near = with_distance(rows, fit, keys, few).where(F.col("d2").isNotNull())
    steps = near.groupBy(*by, F.floor(16 * F.log2(F.col("d2") + 1e-6)).alias("step")).agg(*sums([F.col(f) for f in FEATURES]))
    w = Window.partitionBy(*by)
    inner = steps.withColumns({"before": F.sum("n").over(w.orderBy("step")) - F.col("n"), "all": F.sum("n").over(w)}).where(2 * F.col("before") < F.col("all"))
    return factored(scatter(inner.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])), by)


def robust_fits(rows: DataFrame, keys: list[str], few: bool, gain: float = 1e-2) -> DataFrame:
    """rows: keys and features. The reweighted minimum-covariance-determinant fit of every group.

    A start goes on while its log determinant falls by ``gain``; that is bounded from below, so all come to rest.
    """
    by = [*keys, "start"]
    fit = materialize(starts_of(rows, keys, few).withColumns({"log_det": F.lit(1e9), "moving": F.lit(True)}), "fit")
    while fit.where("moving").limit(1).count():
        moving = fit.where("moving").drop("log_det", "moving")
        new = concentrated(rows, moving, keys, few).withColumnsRenamed({k: f"_g_{k}" for k in by} | {c: f"new_{c}" for c in [*FIT_COLUMNS, "log_det"]})
        both = fit.join(new, [fit[k].eqNullSafe(new[f"_g_{k}"]) for k in by], "left")
        better = F.coalesce(F.col("new_log_det") < F.col("log_det") - gain, F.lit(False))
        old, fit = fit, materialize(both.select(*by, *[F.when(better, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in [*FIT_COLUMNS, "log_det"]], better.alias("moving")), "fit")
        discard(old)
    best = fit.groupBy(*keys).agg(F.min_by(F.struct(*FIT_COLUMNS), F.struct("log_det", "start")).alias("b")).select(*keys, "b.*")
    best = materialize(best, "best")
    median = with_distance(rows, best, keys, few).groupBy(*keys).agg((F.percentile_approx("d2", F.lit(0.5), F.lit(1000)) / MEDIAN).alias("wide"))
    wide = median.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    # A group whose inner half doesn't vary keeps the floor as its scale.
    scaled = best.join(wide, [best[k].eqNullSafe(wide[f"_g_{k}"]) for k in keys]).withColumn("wide", F.sqrt(F.greatest("wide", F.lit(1.0))))
    scaled = materialize(scaled.select(*keys, *[(F.col(c) * F.col("wide") if c.startswith("l_") else F.col(c)).alias(c) for c in FIT_COLUMNS]), "scaled")
    inner = with_distance(rows, scaled, keys, few).where(F.col("d2") <= INNER)
    return materialize(factored(scatter(inner.groupBy(*keys).agg(*sums([F.col(f) for f in FEATURES])), INNER_TO_WHOLE), keys).drop("log_det"), "fits")


def judged_at(rows: DataFrame, group: list[str], least: int) -> DataFrame:
    """Each group of the rows with the level at which it is judged: the first with ``least`` rows; null where all are too few."""
    sizes = rows.groupBy(*group).count()
    level, depth = F.lit(None).cast("int"), len(group)
    for k in range(depth, -1, -1):
        total = F.sum("count").over(Window.partitionBy(*[F.col(g) for g in group[: depth - k]])) if k < depth else F.sum("count").over(Window.partitionBy(F.lit(0)))
        level = F.when(total >= least, F.lit(k)).otherwise(level)
    return sizes.select(*group, level.alias("level"))


def verdicts(df: DataFrame, group: tuple[str, ...] = ("lang", "source"), least: int = 100, quantile: float = 0.999, broadcast_groups: int = 20_000, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns with the statistics, base_failed, kept and distance2 (null for rows that fail the base rules).

    ``quantile``: of the chi-square law; rows beyond it go. Groups under ``least`` rows are
    judged by the fit of their language, then of everything.
    """
    keys = [f"g_{i}" for i in range(len(group))]
    boxed = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *[F.col(f"`{g}`").cast("string").alias(k) for g, k in zip(group, keys, strict=True)], F.col("text").cast("string").alias("_text"))
    rows = vectors(statistics(boxed, "_text")).drop("_text")
    if "text" in carry:
        slim = materialize(rows.drop("row"), "vectors")
    else:
        slim = rows = materialize(rows, "vectors")
    good = slim.where(~F.col("base_failed"))
    assigned = materialize(judged_at(good, keys, least), "levels")
    n, deepest = assigned.agg(F.count(F.lit(1)), F.max("level")).first()
    few, by = n <= broadcast_groups, ["level", *keys]
    spread = good.select(F.explode(levels(keys, deepest or 0)).alias("k"), *FEATURES).select("k.*", *FEATURES)
    if deepest:
        # Wider levels are fitted only where a group needs them.
        wanted = assigned.select(F.explode(levels(keys, deepest)).alias("k"), F.col("level").alias("own")).where("k.level = own").select("k.*").distinct().withColumnsRenamed({k: f"_g_{k}" for k in by})
        spread = spread.join(F.broadcast(wanted) if few else wanted, [spread[k].eqNullSafe(wanted[f"_g_{k}"]) for k in by], "left_semi")
    fits = robust_fits(spread, by, few)
    # Every group with the fit of its level.
    groups = assigned.select(*[F.col(k).alias(f"own_{k}") for k in keys], F.explode(levels(keys, deepest or 0)).alias("k"), F.col("level").alias("own")).where("k.level = own").select(*[f"own_{k}" for k in keys], "k.*")
    named = fits.withColumnsRenamed({k: f"_g_{k}" for k in by})
    groups = groups.join(named, [groups[k].eqNullSafe(named[f"_g_{k}"]) for k in by]).select(*[F.col(f"own_{k}").alias(k) for k in keys], *FIT_COLUMNS)
    out = with_distance(rows, groups, keys, few)
    distance = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi_square_quantile(quantile, P), F.lit(True))
    return out.select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), distance.alias("distance2"))


def op7_robust_outliers(spark, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that the rules and the outlier test keep, with their own columns."""
    inner = docs.select("text", "lang", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_own"))
    return verdicts(inner, carry=("_own", "text")).where("kept").select("_own.*")
