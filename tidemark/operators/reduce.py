"""Statistics of replicates: named, quantiles, or any function; over DataFrames and inside kernels."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Codes, MethodConfigError
from ..specs import CircularBlock, MethodSpec

NAMES = ("mean", "var", "std", "median")


@dataclass(frozen=True)
class Statistic:
    """name: one of NAMES, "quantile" (with q) or "call" (with call: values (n,) or (n, d), indices (n,) or None -> number or array)."""

    name: str
    q: float | None = None
    call: Callable | None = None
    vectorized: bool = False

    def column(self, v: Column) -> Column:
        """The aggregate that gives the statistic; var and std divide by n."""
        if self.name == "mean":
            return F.avg(v)
        if self.name in ("var", "std"):
            return (F.var_pop if self.name == "var" else F.stddev_pop)(v)
        if self.name in ("median", "quantile"):
            return F.percentile(v, F.lit(0.5 if self.name == "median" else self.q))
        raise MethodConfigError("a callable has no aggregate", code=Codes.INVALID_PARAMETER)

    def rows(self, values: np.ndarray, indices: np.ndarray | None = None, was_1d: bool = True) -> np.ndarray:
        """(B, k) from values (B, n, d)."""
        if self.name != "call":
            f = {"mean": np.mean, "var": np.var, "std": np.std, "median": np.median}.get(self.name)
            return f(values, axis=1) if f else np.quantile(values, self.q, axis=1)
        shaped = values[:, :, 0] if was_1d else values
        if self.vectorized:
            out = np.asarray(self.call(shaped, indices), float)
            if out.ndim == 0 or len(out) != len(values):
                raise ValueError("a vectorized statistic must return a row for each replicate")
        else:
            out = np.array([np.asarray(self.call(shaped[b], None if indices is None else indices[b]), float) for b in range(len(values))])
        return out.reshape(len(values), -1)


def statistic_of(given: object, *, vectorized: bool = False, open_level: bool = False) -> Statistic:
    """A Statistic from a name, ("quantile", q) or a callable; open_level: q may not be 0 or 1."""
    if isinstance(given, Statistic):
        return given
    if callable(given):
        return Statistic("call", call=given, vectorized=vectorized)
    if isinstance(given, str) and given in NAMES:
        return Statistic(given)
    if isinstance(given, tuple) and len(given) == 2 and given[0] == "quantile" and isinstance(given[1], (int, float)) and 0 <= given[1] <= 1 and not (open_level and given[1] in (0, 1)):
        return Statistic("quantile", float(given[1]))
    raise MethodConfigError(f"statistic must be one of {NAMES}, ('quantile', q) or a callable", code=Codes.INVALID_PARAMETER, given=repr(given))


def reduce_frame(replicates: DataFrame, statistic: Statistic) -> DataFrame:
    """(series_id, b, dim, theta) from replicates (series_id, b, x array): one group-by, partial sums first."""
    long = replicates.select("series_id", "b", F.posexplode("x").alias("dim", "v"))
    return long.groupBy("series_id", "b", "dim").agg(statistic.column(F.col("v")).alias("theta"))


PIECE = 1 << 16  # observations in a piece of a series


def block_sum_means(rows: DataFrame, starts: DataFrame, method: MethodSpec) -> DataFrame:
    """(series_id, b, theta): means of block replicates without gathering them; no series is ever in one row or task.

    rows (series_id, t, v), starts (series_id, b, k, start, n, length). A block's sum is a difference of two prefix sums, so
    two look-ups a block take the place of one per value; the last block is cut to what is left of n. Prefix sums are kept
    by pieces of a series: sums within the piece, and what all earlier pieces add up to. Look-ups meet pieces in a join on
    (series, piece), which neither a long series nor a short one makes uneven, and are summed where they meet; it is one by
    sorting, since Spark's estimates know nothing of how many look-ups there are and would broadcast them.
    """
    rows = rows.select("series_id", "t", "v", F.expr(f"t div {PIECE}").cast("int").alias("piece"))
    whole, of = Window.partitionBy("_s"), Window.partitionBy("series_id", "piece")
    sums = rows.groupBy(F.col("series_id").alias("_s"), F.col("piece").alias("_p")).agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    sums = sums.withColumn("mean", F.sum("s").over(whole) / F.sum("c").over(whole))
    earlier = F.sum(F.col("s") - F.col("c") * F.col("mean")).over(whole.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("_s", "_p", "mean", F.coalesce(earlier, F.lit(0.0)).alias("before"))
    # centred by the piece's own mean, so that sums stay small
    own = rows.withColumn("m", F.avg("v").over(of))
    own = own.withColumn("q", F.sum(F.col("v") - F.col("m")).over(of.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)))
    line = F.transform(F.sort_array(F.collect_list(F.struct("t", "q"))), lambda x: x["q"])
    own = own.groupBy("series_id", "piece").agg(F.first("m").alias("m"), line.alias("q"))
    pieces = own.join(sums, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p"))).select("_s", "_p", "mean", "before", "m", "q")
    size = F.least(F.col("length"), F.col("n") - F.col("k") * F.col("length"))
    end = F.col("start") + size
    at = lambda place, sign: F.struct(place.cast("int").alias("at"), F.lit(sign).alias("sign"))
    looks = [at(F.least(end, F.col("n")) - 1, 1.0), at(F.col("start") - 1, -1.0)]
    if isinstance(method, CircularBlock):
        looks.append(at(F.when(end > F.col("n"), end - F.col("n")).otherwise(0) - 1, 1.0))
    each = starts.select("series_id", "b", "n", F.explode(F.array(*looks)).alias("e")).where("e.at >= 0").select("series_id", "b", "n", "e.at", "e.sign", F.expr(f"e.at div {PIECE}").cast("int").alias("piece"))
    met = each.join(pieces.hint("merge"), F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("piece") == F.col("_p")))
    place = F.col("at") - F.col("piece") * PIECE
    upto = F.col("before") + F.get("q", place) + (place + 1) * (F.col("m") - F.col("mean"))
    found = met.select("series_id", "b", "n", "mean", (F.col("sign") * upto).alias("s"))
    return found.groupBy("series_id", "b").agg((F.first("mean") + F.sum("s") / F.first("n")).alias("theta"))


def replicate_quantiles(statistics: DataFrame, levels: list[float]) -> DataFrame:
    """(series_id, dim, q array): exact quantiles over replicates, all levels in one pass."""
    return statistics.groupBy("series_id", "dim").agg(F.percentile("theta", F.array(*[F.lit(x) for x in levels])).alias("q"))
