"""Classical intervals from replicate statistics: percentile, basic, studentized and BCa; as DataFrames and as arrays."""

from __future__ import annotations


from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Codes, MethodConfigError
from ..specs import IID, OBSERVATION_METHODS, MethodSpec, StationaryBlock
from .blocklength import optimal_block_length
from .reduce import Statistic

KINDS = ("percentile", "basic", "studentized", "bca")
NORMAL = NormalDist()
TIE = 1e-12  # of a series' largest number: sums of the same values in another order differ by less, and are ties


def check_alpha(alpha: float) -> None:
    if not 0 < alpha < 1:
        raise MethodConfigError("alpha must be in (0, 1)", code=Codes.INVALID_PARAMETER, given=alpha)


# ---- arrays -----------------------------------------------------------------------------------------------------------


def percentile_interval(statistics: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    check_alpha(alpha)
    low, high = np.quantile(np.asarray(statistics, float), [alpha / 2, 1 - alpha / 2], axis=0)
    return low, high


def basic_interval(statistics: np.ndarray, estimate: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    low, high = percentile_interval(statistics, alpha)
    return 2 * np.asarray(estimate) - high, 2 * np.asarray(estimate) - low


def jackknife_statistics(x: np.ndarray, statistic: Callable) -> np.ndarray:
    """The statistic without each row in turn; statistic: values -> number or array."""
    return np.array([np.asarray(statistic(np.delete(x, i, axis=0)), float) for i in range(len(x))])


def block_jackknife_se(x: np.ndarray, statistic: Callable, block_length: int) -> np.ndarray:
    """Standard error from leaving out each whole block in turn; rows after the last whole block always stay."""
    g = len(x) // block_length
    if g < 2:
        raise ValueError("at least two whole blocks are needed")
    left = np.array([np.asarray(statistic(np.delete(x, np.s_[j * block_length : (j + 1) * block_length], axis=0)), float) for j in range(g)])
    return np.sqrt((g - 1) / g * ((left - left.mean(axis=0)) ** 2).sum(axis=0))


def block_jackknife_errors(values: np.ndarray, indices: np.ndarray | None, what: Statistic, block_length: int, was_1d: bool = True) -> np.ndarray:
    """(B, k): block_jackknife_se() of each replicate of values (B, n, d); means by block sums, in one pass."""
    count, n, d = values.shape
    g = n // block_length
    if g < 2:
        raise ValueError("at least two whole blocks are needed")
    if what.name == "mean":
        sums = values[:, : g * block_length].reshape(count, g, block_length, d).sum(axis=2)
        left = (values.sum(axis=1)[:, None] - sums) / (n - block_length)
    else:
        cut = [np.s_[j * block_length : (j + 1) * block_length] for j in range(g)]
        left = np.stack([what.rows(np.delete(values, c, axis=1), None if indices is None else np.delete(indices, c, axis=1), was_1d) for c in cut], axis=1)
    return np.sqrt((g - 1) / g * ((left - left.mean(axis=1, keepdims=True)) ** 2).sum(axis=1))


def studentized_interval(statistics: np.ndarray, errors: np.ndarray, estimate: np.ndarray, error: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    check_alpha(alpha)
    if (np.asarray(errors) <= 0).any() or (np.asarray(error) <= 0).any():
        raise ValueError("standard errors must be positive")
    low, high = np.quantile((np.asarray(statistics) - estimate) / errors, [alpha / 2, 1 - alpha / 2], axis=0)
    return np.asarray(estimate) - high * error, np.asarray(estimate) - low * error


def jackknife_acceleration(left_out: np.ndarray) -> np.ndarray:
    d = left_out.mean(axis=0) - left_out
    below = 6 * (d**2).sum(axis=0) ** 1.5
    return np.where(below > 0, (d**3).sum(axis=0) / np.where(below > 0, below, 1), 0.0)


def bca_levels(share: float, acceleration: float, alpha: float) -> tuple[float, float]:
    """Levels to read off; share: of replicates below the estimate, ties (TIE) half."""
    if not 0 < share < 1:
        raise ValueError("all replicates lie on one side of the estimate")
    z0 = NORMAL.inv_cdf(share)
    out = []
    for level in (alpha / 2, 1 - alpha / 2):
        z = z0 + NORMAL.inv_cdf(level)
        out.append(NORMAL.cdf(z0 + z / (1 - acceleration * z)))
    return out[0], out[1]


def bca_interval(statistics: np.ndarray, estimate: np.ndarray, acceleration: np.ndarray, alpha: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    check_alpha(alpha)
    s = np.asarray(statistics, float)
    columns, e, a = s.reshape(len(s), -1), np.ravel(estimate), np.ravel(acceleration)
    pairs = []
    for j in range(columns.shape[1]):
        scale = max(np.abs(columns[:, j]).max(), abs(e[j]))
        near = TIE * scale if np.isfinite(scale) else 0.0
        share = ((columns[:, j] < e[j] - near).sum() + (columns[:, j] <= e[j] + near).sum()) / 2 / len(s)
        pairs.append(np.quantile(columns[:, j], bca_levels(share, a[j], alpha)))
    low, high = np.array(pairs).T
    return low.reshape(s.shape[1:]), high.reshape(s.shape[1:])


def se_length(method: MethodSpec, x: np.ndarray, given: int | None) -> int:
    """Block length for standard errors: the given one; IID: 1; the spec's; else automatic."""
    if given is not None:
        return given
    if isinstance(method, IID):
        return 1
    length = getattr(method, "block_length", "auto")
    return length if isinstance(length, int) else optimal_block_length(x, "stationary" if isinstance(method, StationaryBlock) else "circular")


def check_kind(kind: str, method: MethodSpec, alpha: float) -> None:
    check_alpha(alpha)
    if kind not in KINDS:
        raise MethodConfigError(f"kind must be one of {KINDS}", code=Codes.INVALID_PARAMETER, given=kind)
    if kind == "bca" and not isinstance(method, IID):
        raise MethodConfigError("BCa is defined for IID only: its acceleration leaves out single rows", code=Codes.UNSUPPORTED_MODEL_FEATURE)
    if kind == "studentized" and not isinstance(method, OBSERVATION_METHODS):
        raise MethodConfigError("studentized intervals need a method that resamples observations", code=Codes.UNSUPPORTED_MODEL_FEATURE)


# ---- DataFrames: statistics (series_id, b, theta double), estimates (series_id, point) -------------------------------------


def _ends(alpha: float) -> Column:
    return F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))


def percentile_frame(statistics: DataFrame, alpha: float = 0.05) -> DataFrame:
    """series_id, lower, upper."""
    check_alpha(alpha)
    q = statistics.groupBy("series_id").agg(F.percentile("theta", _ends(alpha)).alias("q"))
    return q.select("series_id", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def basic_frame(statistics: DataFrame, estimates: DataFrame, alpha: float = 0.05) -> DataFrame:
    q = percentile_frame(statistics, alpha).join(estimates, "series_id")
    return q.select("series_id", (2 * F.col("point") - F.col("upper")).alias("lower"), (2 * F.col("point") - F.col("lower")).alias("upper"), "point")


def block_jackknife_means(rows: DataFrame, length: int) -> DataFrame:
    """rows (group columns..., t, v) -> se of the mean per group of all columns but t and v, by whole blocks left out in turn."""
    keys = [c for c in rows.columns if c not in ("t", "v")]
    blocks = rows.groupBy(*keys, F.expr(f"t div {length}").alias("block")).agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    of = Window.partitionBy(*keys)
    blocks = blocks.withColumns({"total": F.sum("s").over(of), "n": F.sum("c").over(of)}).where(F.col("c") == length)
    left = blocks.withColumn("left", (F.col("total") - F.col("s")) / (F.col("n") - length))
    g = F.count("*")
    return left.groupBy(*keys).agg(F.when(g >= 2, F.sqrt((g - 1) * F.var_pop("left"))).alias("se"))


def studentized_frame(statistics: DataFrame, estimates: DataFrame, alpha: float = 0.05) -> DataFrame:
    """statistics with a column se; estimates with a column se. A series with an se that is null or not positive is an error."""
    check_alpha(alpha)
    ratio = statistics.join(estimates.select("series_id", "point", F.col("se").alias("se0")), "series_id")
    fine = (F.col("se") > 0) & (F.col("se0") > 0)
    t = F.when(fine, (F.col("theta") - F.col("point")) / F.col("se")).otherwise(F.raise_error(F.lit("standard errors must be positive")))
    q = ratio.groupBy("series_id", "point", "se0").agg(F.percentile(t, _ends(alpha)).alias("q"))
    return q.select("series_id", (F.col("point") - F.col("q")[1] * F.col("se0")).alias("lower"), (F.col("point") - F.col("q")[0] * F.col("se0")).alias("upper"), "point")


def acceleration_of_means(rows: DataFrame) -> DataFrame:
    """rows (series_id, t, v) -> series_id, acceleration of the mean: leave-one-out means in closed form."""
    of = Window.partitionBy("series_id")
    d = rows.withColumn("d", (F.col("v") - F.avg("v").over(of)) / (F.count("*").over(of) - 1))
    below = 6 * F.pow(F.sum(F.col("d") * F.col("d")), 1.5)
    return d.groupBy("series_id").agg(F.when(below > 0, F.sum(F.col("d") * F.col("d") * F.col("d")) / F.when(below > 0, below)).otherwise(0.0).alias("acceleration"))


def quantile_at(ordered: Column, level: Column) -> Column:
    """Linear quantile of a sorted array at a level that may differ by row."""
    h = level * (F.size(ordered) - 1)
    low = F.floor(h).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return a + (b - a) * (h - low)


def bca_frame(statistics: DataFrame, estimates: DataFrame, accelerations: DataFrame, alpha: float = 0.05) -> DataFrame:
    """series_id, lower, upper, point; one array of a series' replicate statistics is sorted, its levels come from a vectorised function."""
    check_alpha(alpha)

    @F.pandas_udf("array<double>")
    def levels(share: pd.Series, acceleration: pd.Series) -> pd.Series:
        return pd.Series([list(bca_levels(s, a, alpha)) for s, a in zip(share, acceleration, strict=True)])

    met = statistics.join(estimates, "series_id")
    per = met.groupBy("series_id", "point").agg(F.sort_array(F.collect_list("theta")).alias("s")).join(accelerations, "series_id")
    scale = F.greatest(F.abs(F.get("s", F.lit(0))), F.abs(F.get("s", F.size("s") - 1)), F.abs("point"))
    near = F.when(scale < float("inf"), TIE * scale).otherwise(0.0)
    below, upto = F.filter("s", lambda x: x < F.col("point") - near), F.filter("s", lambda x: x <= F.col("point") + near)
    per = per.withColumn("share", (F.size(below) + F.size(upto)) / 2 / F.size("s"))
    per = per.withColumn("l", levels("share", "acceleration"))
    return per.select("series_id", quantile_at(F.col("s"), F.col("l")[0]).alias("lower"), quantile_at(F.col("s"), F.col("l")[1]).alias("upper"), "point")


def jackknife_frame(rows: DataFrame) -> DataFrame:
    """rows (series_id, t, v) -> series_id, t, left_mean, left_var: mean and variance without row t, in closed form."""
    of = Window.partitionBy("series_id")
    n = F.count("*").over(of)
    mean = F.avg("v").over(of)
    dev = rows.withColumns({"n": n, "mean": mean, "ss": F.var_pop("v").over(of) * n})
    d = F.col("v") - F.col("mean")
    left = F.col("mean") - d / (F.col("n") - 1)
    return dev.select("series_id", "t", left.alias("left_mean"), ((F.col("ss") - d * d * F.col("n") / (F.col("n") - 1)) / (F.col("n") - 1)).alias("left_var"))


