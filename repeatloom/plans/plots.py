"""The data of scatter plots and heat maps of copy numbers: limits, fits, curves and bins, nothing is drawn."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import histogram_2d, p_value, percentiles, power_law, regression

# Fixed pairs: what is plotted against what.
PAIRS = [
    ("cons_len", "mean_hap1"), ("cons_len", "mean_hap2"), ("cons_len", "var_hap1"), ("cons_len", "var_hap2"),
    ("mean_hap1", "var_hap1"), ("mean_hap2", "var_hap2"), ("cons_x_hap1", "var_hap1"), ("cons_x_hap2", "var_hap2"),
]
NUMBERS = ["cons_len", "mean_hap1", "mean_hap2", "var_hap1", "var_hap2"]


@dataclass(frozen=True)
class Setting:
    """chart: scatter or heat; fit: linear or power; limits as shares; curve: over what x the fit is drawn, at how many points."""

    chart: str
    fit: str
    low: float
    high: float
    curve: str
    points: int


# Fixed settings of the eight plots.
SETTINGS = {
    "scatter_linear": Setting("scatter", "linear", 0.01, 0.99, "data", 200),
    "scatter_linear_iqr": Setting("scatter", "linear", 0.25, 0.75, "limits", 300),
    "scatter_power": Setting("scatter", "power", 0.01, 0.99, "positive_limits", 300),
    "scatter_power_iqr": Setting("scatter", "power", 0.25, 0.75, "limits_positive", 300),
    "heat_linear": Setting("heat", "linear", 0.01, 0.99, "limits", 300),
    "heat_linear_iqr": Setting("heat", "linear", 0.25, 0.75, "limits", 300),
    "heat_power": Setting("heat", "power", 0.01, 0.99, "limits_positive", 300),
    "heat_power_iqr": Setting("heat", "power", 0.25, 0.75, "limits_positive", 300),
}
BINS = 80


def with_products(summary: DataFrame) -> DataFrame:
    """Adds cons_x_hap1 and cons_x_hap2: the lengths of the haplotypes."""
    return summary.withColumns({f"cons_x_hap{h}": F.col("cons_len") * F.col(f"mean_hap{h}") for h in (1, 2)})


def fitted(table: DataFrame, x: str, y: str, s: Setting) -> dict:
    """Limits of both axes, the fit (a and b of a + b x, or of a x**b) over all data, its r and p, and the ends of its curve."""
    both = table.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    limits = lambda c, of=both: percentiles(of, c, [s.low, s.high])
    out = dict(zip(("x_low", "x_high", "y_low", "y_high"), (*limits(x), *limits(y))))
    positive = both.where((F.col(x) > 0) & (F.col(y) > 0))
    if s.fit == "linear":
        row = regression(both, x, y).first()
        out |= {"n": row.n, "a": row.intercept, "b": row.slope, "r": row.r}
    else:
        row = power_law(both, x, y).first()
        out |= {"n": row.n, "a": row.factor, "b": row.exponent, "r": row.r}
    out["p"] = p_value(row.r, row.n) if row.r is not None and row.n > 2 else None
    if s.curve == "data":
        ends = both.agg(F.min(x), F.max(x)).first()
    elif s.curve == "limits":
        ends = out["x_low"], out["x_high"]
    elif s.curve == "positive_limits":
        ends = tuple(limits(x, positive))
    else:
        least = positive.agg(F.min(x)).first()[0]
        ends = (max(out["x_low"], least) if least is not None else None), out["x_high"]
    return out | {"curve_low": ends[0], "curve_high": ends[1]}


def curve(spark: SparkSession, fit: dict, s: Setting) -> DataFrame:
    """(i, x, y): the fit at evenly spaced points of its range; none without a fit."""
    if fit["a"] is None or fit["b"] is None or fit["curve_low"] is None:
        return spark.createDataFrame([], "i long, x double, y double")
    x = F.lit(float(fit["curve_low"])) + F.col("id") * F.lit((fit["curve_high"] - fit["curve_low"]) / (s.points - 1))
    y = F.lit(fit["a"]) + F.lit(fit["b"]) * F.col("x") if s.fit == "linear" else F.lit(fit["a"]) * F.pow("x", F.lit(fit["b"]))
    return spark.range(s.points).select(F.col("id").alias("i"), x.alias("x")).withColumn("y", y)


def bins(table: DataFrame, x: str, y: str, fit: dict, s: Setting, n: int = BINS) -> DataFrame:
    """The points within the limits (x, y), or their counts in n by n bins (x_bin, y_bin, n)."""
    limits = tuple(fit[k] for k in ("x_low", "x_high", "y_low", "y_high"))
    if None in limits:
        return table.sparkSession.createDataFrame([], "x_bin long, y_bin long, n long" if s.chart == "heat" else f"{x} double, {y} double")
    if s.chart == "heat":
        return histogram_2d(table, x, y, limits, n)
    return table.select(x, y).where(F.col(x).between(*limits[:2]) & F.col(y).between(*limits[2:]))


def matrix(table: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The fits of all settings and pairs, a row for each: setting, x, y, limits, n, a, b, r, p and the curve's ends."""
    rows = [(name, x, y, *(f := fitted(table, x, y, SETTINGS[name])).values()) for name in names or SETTINGS for x, y in PAIRS]
    keys = "x_low double, x_high double, y_low double, y_high double, n long, a double, b double, r double, p double, curve_low double, curve_high double"
    return table.sparkSession.createDataFrame([tuple(float(v) if isinstance(v, int) and i != 7 else v for i, v in enumerate(r)) for r in rows], f"setting string, x string, y string, {keys}")
