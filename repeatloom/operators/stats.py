"""Descriptive statistics, histograms and regressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Most different values that are looked through in one place, and pieces in which more of them are cut.
HELD, PIECES = 10_000, 32


def percentiles(df: DataFrame, x: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a column by linear interpolation; null without values.

    Rows are counted by value, and of the different values those around the wanted place
    are narrowed down to HELD by counts between approximate borders, which only decide how
    fast this goes. It runs jobs; neither a task nor the driver holds more of the values.
    """
    counts = df.select(F.col(x).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n")).cache()
    rows = counts.orderBy("v").limit(HELD + 1).collect()
    if len(rows) <= HELD:
        total = sum(n for _, n in rows)
        out = [_at(rows, 0, share * (total - 1)) if total else None for share in shares]
    else:
        different, total = counts.agg(F.count("*"), F.sum("n")).first()
        out = [_percentile(counts, different, share * (total - 1)) for share in shares]
    counts.unpersist()
    return out


def _percentile(counts: DataFrame, different: int, place: float) -> float:
    """The value at a place, from 0, among values ``v`` that occur ``n`` times each."""
    lower, upper, below = math.floor(place), math.ceil(place), 0
    while different > HELD:
        borders = sorted(set(counts.agg(F.percentile_approx("v", [i / PIECES for i in range(1, PIECES)], 10_000)).first()[0]))
        under = [F.struct(F.coalesce(F.sum(F.when(F.col("v") < b, F.col("n"))), F.lit(0)), F.count(F.when(F.col("v") < b, 1))) for b in borders]
        cuts = [(b, below + n, k) for b, (n, k) in zip(borders, counts.agg(*under).first())]
        first = max((c for c in cuts if c[1] <= lower), key=lambda c: c[1:], default=(None, below, 0))
        last = min((c for c in cuts if c[1] > upper), key=lambda c: c[1:], default=(None, 0, different))
        for cut, kept in ((first[0], F.col("v") >= F.lit(first[0])), (last[0], F.col("v") < F.lit(last[0]))):
            counts = counts.where(kept) if cut is not None else counts
        below, different = first[1], last[2] - first[2]
    return _at(counts.orderBy("v").collect(), below, place)


def _at(rows: list, below: int, place: float) -> float:
    """The value at a place among those of ``rows`` (v, n), in order, before which ``below`` others come."""
    lower, upper, found = math.floor(place), math.ceil(place), []
    for v, n in rows:
        found += [v] * ((below <= lower < below + n) + (lower != upper and below <= upper < below + n))
        below += n
    return found[0] if found[0] == found[-1] else (upper - place) * found[0] + (place - lower) * found[1]


def describe(df: DataFrame, x: str) -> DataFrame:
    """n, mean, median, sd (n - 1), min, max, q1 and q3 (linear interpolation) of a column."""
    q1, median, q3 = (F.lit(q).cast("double") for q in percentiles(df, x, [0.25, 0.5, 0.75]))
    row = df.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))
    return row.select("n", "mean", median.alias("median"), "sd", "min", "max", q1.alias("q1"), q3.alias("q3"))


def histogram(df: DataFrame, x: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 1, n) with empty bins; values outside are dropped, the last bin is closed."""
    bin_ = F.least(F.width_bucket(F.col(x).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins)), F.lit(bins)).cast("long")
    n = df.where(F.col(x).between(low, high)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).withColumnRenamed("id", "bin")
    return every.join(n, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, limits: tuple[float, float, float, float], bins: int) -> DataFrame:
    """(x_bin, y_bin, n) of the points within limits; a range without width has no bins."""
    x0, x1, y0, y1 = limits
    if not (x0 < x1 and y0 < y1):
        return df.sparkSession.createDataFrame([], "x_bin long, y_bin long, n long")
    bucket = lambda c, a, b: F.least(F.width_bucket(F.col(c).cast("double"), F.lit(float(a)), F.lit(float(b)), F.lit(bins)), F.lit(bins)).cast("long")
    inside = df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))
    return inside.groupBy(bucket(x, x0, x1).alias("x_bin"), bucket(y, y0, y1).alias("y_bin")).agg(F.count("*").alias("n"))


def percentile_limits(df: DataFrame, x: str, low: float, high: float) -> DataFrame:
    """low and high: the percentiles of a column at two shares."""
    a, b = (F.lit(q).cast("double") for q in percentiles(df, x, [low, high]))
    return df.sparkSession.range(1).select(a.alias("low"), b.alias("high"))


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, slope, intercept, r of y on x over rows where both are known."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(x, y).alias("r"))


def power_law(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, exponent, factor, r of y = factor * x ** exponent over positive pairs; null for two or fewer."""
    logs = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.ln(x).alias("lx"), F.ln(y).alias("ly"))
    fit = regression(logs, "lx", "ly")
    enough = lambda c: F.when(F.col("n") > 2, c)
    return fit.select("n", enough(F.col("slope")).alias("exponent"), enough(F.exp("intercept")).alias("factor"), enough(F.col("r")).alias("r"))


def p_value(r: float, n: int) -> float:
    """Two-sided p of a correlation, by the regularised incomplete beta function of Student's t."""
    df = n - 2
    if df < 1:
        return math.nan
    if abs(r) >= 1:
        return 0.0
    a, b, x = df / 2, 0.5, 1 - r * r
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * _beta_fraction(b, a, 1 - x) / b
    return front * _beta_fraction(a, b, x) / a


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d)
            c = 1 + top / c
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out
