"""Straight line against smooth curve on a time series: an ordered forward holdout, fitted from moments.

The curve is a natural cubic regression spline over evenly spaced knots, straight beyond
them, with a penalty on its second derivative chosen by generalised cross-validation.
Between two knots every basis function is a cubic, so its cross-products are sums of
powers of time: one aggregation by knot interval brings a few numbers for each of them to
the driver, however long the series is, and the rest is algebra on a matrix of KNOTS rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.types import finite, lenient_date, strict_number
from .series import with_ordinal

#: The least numbers of rows, of training rows, holdout rows and different values; share of training rows; most knots.
LEAST_ROWS, LEAST_TRAINING, LEAST_HOLDOUT, LEAST_VALUES, TRAINING_SHARE, KNOTS = 15, 10, 3, 3, 0.8, 10
#: Penalties that are tried.
PENALTIES = 10.0 ** np.arange(-8, 8.01, 0.25)
#: Ranges of time in which the series is numbered.
RANGES = 4096


@dataclass
class Moments:
    """Per knot interval the sums of t^0..t^6 and of y * t^0..t^3, t from the interval's knot, in units of the training span."""

    powers: np.ndarray
    products: np.ndarray
    squares: float

    @property
    def n(self) -> float:
        return float(self.powers[:, 0].sum())


def _second_derivatives(k: int) -> tuple[np.ndarray, np.ndarray]:
    """From a natural spline's values at k knots to its second derivatives there, and the penalty: the integral of their square."""
    h = 1 / (k - 1)
    d, b = np.zeros((k - 2, k)), np.zeros((k - 2, k - 2))
    for i in range(k - 2):
        d[i, i : i + 3] = 1 / h, -2 / h, 1 / h
        b[i, i] = 2 * h / 3
        if i + 1 < k - 2:
            b[i, i + 1] = b[i + 1, i] = h / 6
    inner = np.linalg.solve(b, d)
    return np.vstack([np.zeros(k), inner, np.zeros(k)]), d.T @ inner


def _cubics(k: int) -> np.ndarray:
    """For each interval the coefficients of t^0..t^3, in rows, as linear functions of the values at the knots."""
    h = 1 / (k - 1)
    curve, _ = _second_derivatives(k)
    unit = np.eye(k)
    out = np.empty((k - 1, 4, k))
    for c in range(k - 1):
        a, b, left, right = unit[c], unit[c + 1], curve[c], curve[c + 1]
        out[c] = a, (b - a) / h - h / 6 * (2 * left + right), left / 2, (right - left) / (6 * h)
    return out


@dataclass
class Spline:
    values: np.ndarray
    penalty: float
    degrees: float
    score: float

    def cubics(self) -> np.ndarray:
        return _cubics(len(self.values)) @ self.values

    def predict(self, u: Column) -> Column:
        """The curve at u, in units of the training span: cubic inside, straight outside."""
        k, c = len(self.values), self.cubics()
        h = 1 / (k - 1)
        cell = F.greatest(F.lit(0), F.least(F.lit(k - 2), F.floor(u / h).cast("int")))
        t = u - cell * h
        at = lambda p: F.get(F.array(*(F.lit(float(x)) for x in c[:, p])), cell)
        inside = at(0) + t * (at(1) + t * (at(2) + t * at(3)))
        end = c[-1, 1] + h * (2 * c[-1, 2] + 3 * h * c[-1, 3])
        return F.when(u < 0, float(c[0, 0]) + u * float(c[0, 1])).when(u > 1, float(self.values[-1]) + (u - 1) * float(end)).otherwise(inside)


def fit_spline(m: Moments) -> Spline:
    """The penalised least squares fit of the least cross-validation score n * RSS / (n - degrees)^2; the largest such penalty on ties."""
    k = len(m.powers) + 1
    cubics, (_, s) = _cubics(k), _second_derivatives(k)
    gram, right = np.zeros((k, k)), np.zeros(k)
    for c in range(k - 1):
        gram += cubics[c].T @ m.powers[c][np.add.outer(np.arange(4), np.arange(4))] @ cubics[c]
        right += cubics[c].T @ m.products[c]
    best = None
    for penalty in PENALTIES[::-1] * m.n:
        inverse = np.linalg.pinv(gram + penalty * s, hermitian=True)
        values = inverse @ right
        degrees = float(np.trace(inverse @ gram))
        rss = max(0.0, m.squares - 2 * values @ right + values @ gram @ values)
        score = m.n * rss / (m.n - degrees) ** 2 if m.n > degrees else np.inf
        if best is None or score < best.score * (1 - 1e-9):
            best = Spline(values, float(penalty), degrees, float(score))
    return best


def moments(rows: DataFrame, u: str, value: str, knots: int) -> Moments:
    """rows with u in 0 to 1: sums by knot interval, knots - 1 rows for the driver."""
    h = 1 / (knots - 1)
    cell = F.least(F.lit(knots - 2), F.floor(F.col(u) / h).cast("int"))
    t = F.col(u) - F.col("cell") * h
    power = lambda p: F.lit(1.0) if p == 0 else F.pow(t, p)
    sums = [F.sum(power(p)).alias(f"p{p}") for p in range(7)] + [F.sum(F.col(value) * power(p)).alias(f"y{p}") for p in range(4)] + [F.sum(F.col(value) * F.col(value)).alias("yy")]
    out = Moments(np.zeros((knots - 1, 7)), np.zeros((knots - 1, 4)), 0.0)
    for r in rows.withColumn("cell", cell).groupBy("cell").agg(*sums).collect():
        out.powers[r.cell] = [r[f"p{p}"] for p in range(7)]
        out.products[r.cell] = [r[f"y{p}"] for p in range(4)]
        out.squares += r.yy
    return out


def _numbered(df: DataFrame, time: str, value: str) -> DataFrame:
    """at (numbers as they are, dates as days) and value of the complete rows."""
    kind = df.schema[time].dataType
    numeric = isinstance(kind, T.NumericType)
    days = F.to_date(F.col(time)) if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else lenient_date(F.col(time))
    at = finite(F.col(time).cast("double")) if numeric else F.unix_date(days).cast("double")
    number = finite(F.col(value).cast("double")) if isinstance(df.schema[value].dataType, T.NumericType) else strict_number(F.col(value))
    return df.select(at.alias("at"), number.alias("value"))


def trend_competition(df: DataFrame, time: str, value: str) -> DataFrame:
    """One row: status (succeeded or ineligible), reason, the sizes of the split, and slope, degrees, holdout errors of line and curve, and their mean difference in absolute error (curve less line).

    The line and the curve learn from the first 80 % of the rows in order of time and are judged on the rest.
    """
    spark = df.sparkSession
    all_rows = _numbered(df, time, value)
    rows = all_rows.filter("at IS NOT NULL AND value IS NOT NULL")
    facts = all_rows.agg(F.count_if(F.col("at").isNotNull() & F.col("value").isNotNull()).alias("n"), F.count(F.lit(1)).alias("all")).first()
    spread = rows.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.stddev_samp("value").alias("sd")).first()
    n, training = facts.n, int(np.floor(facts.n * TRAINING_SHARE))
    names = "status string, reason string, observed_rows long, dropped_rows long, training_rows long, holdout_rows long, slope double, degrees double, penalty double, linear_mae double, linear_rmse double, smooth_mae double, smooth_rmse double, mean_difference double"

    def row(reason: str | None, *figures) -> DataFrame:
        return spark.createDataFrame([("ineligible" if reason else "succeeded", reason, n, facts.all - n, *(figures or [None] * 10))], names)

    if n < LEAST_ROWS:
        return row("too few complete rows")
    if not rows.groupBy("at").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").isEmpty():
        return row("several rows of one time")
    # different values up to the number that is asked for
    if rows.select("value").distinct().limit(LEAST_VALUES).count() < LEAST_VALUES or not spread.sd:
        return row("the value hardly varies")
    if training < LEAST_TRAINING or n - training < LEAST_HOLDOUT:
        return row("too few rows to split")
    ranges = F.least(F.lit(RANGES - 1), F.floor((F.col("at") - spread.low) / (spread.high - spread.low) * RANGES))
    cut = with_ordinal(rows, ["at"], ranges, "i").filter(F.col("i").isin(training - 1, training)).agg(F.min("at").alias("last"), F.max("at").alias("first")).first()
    span = cut.last - spread.low
    placed = rows.withColumn("u", (F.col("at") - spread.low) / span)
    early, late = placed.filter(F.col("at") <= cut.last), placed.filter(F.col("at") >= cut.first)

    m = moments(early, "u", "value", min(KNOTS, max(4, training // 2)))
    curve = fit_spline(m)
    line = early.agg(F.covar_pop("u", "value") / F.var_pop("u"), F.avg("u"), F.avg("value")).first()
    straight = F.lit(line[2]) + F.lit(line[0]) * (F.col("u") - F.lit(line[1]))
    off = late.select((F.col("value") - straight).alias("a"), (F.col("value") - curve.predict(F.col("u"))).alias("b"))
    figures = off.agg(F.avg(F.abs("a")), F.sqrt(F.avg(F.col("a") * F.col("a"))), F.avg(F.abs("b")), F.sqrt(F.avg(F.col("b") * F.col("b"))), F.avg(F.abs("b") - F.abs("a"))).first()
    return row(None, training, n - training, line[0] / span, curve.degrees, curve.penalty, *figures)
