"""What a series looks like, and which methods suit it."""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.series import SeriesFrame, to_matrix
from .blocklength import optimal_block_length
from .engine import run_points

DEPENDENT, UNIT_ROOT = 0.2, 0.95


@dataclass(frozen=True)
class Diagnosis:
    n_obs: int
    n_series: int
    lag1_autocorr: float
    dependent: bool
    nonstationary: bool
    recommended_methods: tuple[str, ...]
    notes: tuple[str, ...]


def lag1(x: np.ndarray) -> float:
    """Largest absolute lag-1 correlation over columns; constant columns count as zero."""
    found = [0.0]
    for v in x.T:
        a, b = v[:-1], v[1:]
        if a.std() > 0 and b.std() > 0:
            found.append(abs(float(np.corrcoef(a, b)[0, 1])))
    return max(found)


def adf(x: np.ndarray) -> tuple[float, int, float]:
    """Augmented Dickey-Fuller test with a constant: (statistic, lags, p-value); lags by AIC over a common sample.

    The p-value is by MacKinnon's (1994) response surface. A series too short for the test, or constant, is a ValueError.
    """
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    if most < 0 or np.ptp(x) == 0:
        raise ValueError("the series is constant or too short for the test")
    step = np.diff(x)

    def design(lags: int, skip: int) -> tuple[np.ndarray, np.ndarray]:
        return np.column_stack([np.ones(len(step) - skip), x[skip:-1], *[step[skip - j : len(step) - j] for j in range(1, lags + 1)]]), step[skip:]

    z, y = design(most, most)
    best, lags = math.inf, 0
    for k in range(most + 1):
        e = y - z[:, : k + 2] @ np.linalg.lstsq(z[:, : k + 2], y, rcond=None)[0]
        aic = len(y) * math.log(max(float(e @ e) / len(y), 1e-300)) + 2 * (k + 2)
        if aic < best:
            best, lags = aic, k
    z, y = design(lags, lags)
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    e = y - z @ beta
    error = math.sqrt(float(e @ e) / (len(y) - z.shape[1]) * np.linalg.pinv(z.T @ z)[1, 1])
    if error == 0:
        raise ValueError("the series is a recursion without noise")
    return (t := float(beta[1]) / error), lags, mackinnon(t)


# MacKinnon (1994), a constant and one variable: range, where the surfaces meet, and their coefficients.
TAU_LEAST, TAU_MEETS, TAU_MOST = -18.83, -1.61, 2.74
TAU_SMALL, TAU_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def mackinnon(tau: float) -> float:
    """p-value of the Dickey-Fuller statistic."""
    if tau >= TAU_MOST:
        return 1.0
    if tau <= TAU_LEAST:
        return 0.0
    return NormalDist().cdf(sum(c * tau**i for i, c in enumerate(TAU_SMALL if tau <= TAU_MEETS else TAU_LARGE)))


def has_unit_root(x: np.ndarray, r: float) -> bool:
    """Whether the test keeps a unit root, at 5 %, in a column of x (n, d); without a test, whether the lag-1 correlation r is near one."""
    for v in x.T:
        if np.ptp(v) == 0:
            continue
        try:
            if adf(v)[2] > 0.05:
                return True
        except ValueError:
            return r > UNIT_ROOT
    return False


def adf_frame(series: SeriesFrame) -> DataFrame:
    """series_id, dim, statistic, lags, p_value for every column of every series; null where there is no test."""
    nothing = (math.nan, 0, math.nan)

    def call(x: np.ndarray) -> np.ndarray:
        out = []
        for v in x.T:
            try:
                out.append(adf(v))
            except ValueError:
                out.append(nothing)
        return np.array(out, float)

    found = F.col("found")
    fine = ~F.isnan(found[0])
    return run_points(series, call).select("series_id", "dim", F.when(fine, found[0]).alias("statistic"), F.when(fine, found[1].cast("int")).alias("lags"), F.when(fine, found[2]).alias("p_value"))


def recommend(r: float, columns: int, unit: bool) -> tuple[bool, bool, list[str]]:
    dependent = r > DEPENDENT
    methods = ["ResidualBootstrap(model=ARIMA(...))", "SieveAR"] if unit else ["StationaryBlock", "MovingBlock", "SieveAR"] if dependent else ["IID", "MovingBlock"]
    return dependent, unit, (["ResidualBootstrap(model=VAR(...))"] if columns > 1 else []) + methods


def diagnose(X: object) -> Diagnosis:
    x, _ = to_matrix(X)
    r = lag1(x)
    dependent, unit, methods = recommend(r, x.shape[1], has_unit_root(x, r))
    notes = ["near a unit root: difference, or use the sieve"] if unit else [f"serial dependence, lag-1 correlation {r:.2f}"] if dependent else ["little serial dependence"]
    if x.shape[1] > 1:
        notes.append("several columns: VAR models how they move together; block methods keep rows whole")
    if dependent and not unit:
        notes.append(f"automatic block length: {optimal_block_length(x, 'stationary')}")
    return Diagnosis(len(x), x.shape[1], r, dependent, unit, tuple(methods), tuple(notes))


def lag1_frame(rows: DataFrame) -> DataFrame:
    """rows (series_id, t, v) -> series_id, n_obs, lag1: the absolute lag-1 correlation."""
    lagged = rows.withColumn("p", F.lag("v").over(Window.partitionBy("series_id").orderBy("t")))
    r = F.corr(F.when(F.col("p").isNotNull(), F.col("v")), F.col("p"))
    return lagged.groupBy("series_id").agg(F.count("*").alias("n_obs"), F.coalesce(F.abs(F.nanvl(r, F.lit(None))), F.lit(0.0)).alias("lag1"))


def diagnose_frame(rows: DataFrame) -> DataFrame:
    """series_id, n_obs, lag1, dependent, nonstationary, recommended (the first recommended method); by the lag-1 rule alone, in aggregates.

    adf_frame() has the test that diagnose() uses, for every series of a panel.
    """
    dependent, unit = F.col("lag1") > DEPENDENT, F.col("lag1") > UNIT_ROOT
    first = F.when(unit, "ResidualBootstrap(model=ARIMA(...))").when(dependent, "StationaryBlock").otherwise("IID")
    return lag1_frame(rows).select("series_id", "n_obs", "lag1", dependent.alias("dependent"), unit.alias("nonstationary"), first.alias("recommended"))


def autocovariance_frame(rows: DataFrame, lags: int) -> DataFrame:
    """series_id, k, r: autocovariances of lags 0..lags, divided by n, in one ordering of each series."""
    of = Window.partitionBy("series_id")
    c = rows.withColumns({"c": F.col("v") - F.avg("v").over(of), "n": F.count("*").over(of)})
    line = of.orderBy("t")
    past = F.array(*[F.lag("c", k).over(line) for k in range(lags + 1)])
    pairs = c.withColumn("past", past).select("series_id", "n", "c", F.posexplode("past").alias("k", "p"))
    return pairs.groupBy("series_id", "n", "k").agg((F.sum(F.col("c") * F.col("p")) / F.col("n")).alias("r")).where("r is not null").select("series_id", F.col("k").cast("int").alias("k"), "r")
