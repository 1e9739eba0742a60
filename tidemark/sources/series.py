"""Series: (series_id, slot, t, v) or, for several columns, (series_id, slot, t, x), from any DataFrame or array.

t is the rank of a row in its series, from 0; slot is the integer by which random streams tell series apart. One aggregate
pass checks values and lengths; nothing is collected but its counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import Codes, InputDataError, MethodConfigError

MIN_OBSERVATIONS = 3


def active_session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def slot_of(series_id: Column, kind: str) -> Column:
    """32 bits: the id itself if it is an integer, else a hash of it; a pure function of the id, so no ranking of all series."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return series_id.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.xxhash64(series_id).bitwiseAND(F.lit(0xFFFFFFFF))


@dataclass(frozen=True)
class SeriesFrame:
    """rows: series_id, slot, t, x (array<double>); width: columns of x; was_1d: x stands for a plain number.

    known: (series, shortest, longest), where a check has counted them already.
    """

    rows: DataFrame
    width: int
    was_1d: bool
    known: tuple[int, int, int] | None = None

    @cached_property
    def extent(self) -> tuple[int, int, int]:
        """(series, shortest, longest): one aggregate pass at most, however often it is asked."""
        if self.known is not None:
            return self.known
        found = self.sizes().agg(F.count("*"), F.min("n"), F.max("n")).first()
        return found[0], found[1] or 0, found[2] or 0

    def scalar(self) -> DataFrame:
        """series_id, slot, t, v; the first column of x."""
        return self.rows.select("series_id", "slot", "t", F.col("x")[0].alias("v"))

    def long(self) -> DataFrame:
        """series_id, slot, t, dim, v: one row per column, so that several columns are plain group keys."""
        return self.rows.select("series_id", "slot", "t", F.posexplode("x").alias("dim", "v"))

    def sizes(self) -> DataFrame:
        return self.rows.groupBy("series_id", "slot").agg(F.count("*").cast("int").alias("n"))


def from_frame(df: DataFrame, values: str | Sequence[str], *, order: str | Sequence[str], series: str | Sequence[str] | None = None, exog: Sequence[str] = (), check: bool = True, min_obs: int = MIN_OBSERVATIONS, spread: int = 0) -> SeriesFrame:
    """Series of df: values by rank of `order` (which must be a total order, or ties are broken by the values) within `series`.

    Raises for nulls, NaN, infinities and series shorter than min_obs, unless check is False. exog columns come last in x.
    spread: for series too long to be sorted by one task, the number of ranges of the first order column (a number, date or
    time) that are sorted apart; ranks are then place in the range plus what the series has in earlier ranges.
    """
    columns = [values] if isinstance(values, str) else list(values)
    order = [order] if isinstance(order, str) else list(order)
    keys = [] if series is None else [series] if isinstance(series, str) else list(series)
    if not columns:
        raise InputDataError("no value column", code=Codes.INVALID_SHAPE)
    kinds = dict(df.dtypes)
    for c in [*columns, *exog]:
        if kinds.get(c) is None or kinds[c].startswith(("string", "struct", "map", "timestamp", "date", "binary")):
            raise InputDataError(f"column {c} is not numeric", code=Codes.INVALID_SHAPE, column=c, type=kinds.get(c))
    if not keys:
        key, slot = F.lit(0).cast("long"), F.lit(0).cast("long")
    elif len(keys) == 1:
        key, slot = F.col(keys[0]), slot_of(F.col(keys[0]), kinds[keys[0]])
    else:
        key, slot = F.struct(*keys), slot_of(F.struct(*keys), "struct")
    x = F.array(*[F.col(c).cast("double") for c in [*columns, *exog]])
    rows = df.select(key.alias("series_id"), slot.alias("slot"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], x.alias("x"))
    line = [f"_o{i}" for i in range(len(order))] + ["x"]
    if spread > 1:
        rows = _ranked_by_ranges(rows, line, kinds[order[0]], spread)
    else:
        rank = Window.partitionBy("series_id").orderBy(*line)
        rows = rows.withColumn("t", (F.row_number().over(rank) - 1).cast("int")).select("series_id", "slot", "t", "x")
    known = None
    if check:
        bad = F.count_if(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
        found = rows.groupBy("series_id").agg(F.count("*").alias("n"), bad.alias("bad")).agg(F.min("n"), F.sum("bad"), F.max("n"), F.count("*")).first()
        if found[1]:
            raise InputDataError(f"{found[1]} rows hold a null, NaN or infinity", code=Codes.NONFINITE_INPUT, rows=found[1])
        if found[0] is None or found[0] < min_obs:
            raise InputDataError(f"a series has fewer than {min_obs} observations", code=Codes.TOO_FEW_OBSERVATIONS, shortest=found[0] or 0)
        known = found[3], found[0], found[2]
    return SeriesFrame(rows, len(columns) + len(exog), len(columns) == 1 and not exog and isinstance(values, str), known)


def _ranked_by_ranges(rows: DataFrame, line: list[str], kind: str, ranges: int) -> DataFrame:
    """series_id, slot, t, x of rows (series_id, slot, x and the columns of line): no task sorts more than one range of a series.

    The ranges' ends are quantiles of the first column of line over all rows: numbers, so that a recomputed task deals rows
    as before. Rows with equal values stay in one range.
    """
    from pyspark.ml.feature import Bucketizer

    first = F.col(line[0]).cast("timestamp") if kind.startswith(("date", "timestamp")) else F.col(line[0])
    rows = rows.withColumn("_at", F.coalesce(first.cast("double"), F.lit(float("-inf"))))  # nulls come first, as in a sort
    ends = rows.where("_at > double('-inf') and not isnan(_at)").approxQuantile("_at", [i / ranges for i in range(1, ranges)], 0.1 / ranges)
    splits = [float("-inf"), *sorted(set(ends) or {0.0}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_at", outputCol="_range", handleInvalid="keep").transform(rows)
    before = rows.groupBy(F.col("series_id").alias("_s"), F.col("_range").alias("_r")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_s").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("_s", "_r", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("series_id", "_range").orderBy(*line))
    met = rows.withColumn("_own", own).join(before, F.col("series_id").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    return met.select("series_id", "slot", (F.col("_before") + F.col("_own") - 1).cast("int").alias("t"), "x")


def to_matrix(X: object, name: str = "X", min_obs: int = MIN_OBSERVATIONS) -> tuple[np.ndarray, bool]:
    """(n, d) doubles from an array, list, or pandas, Polars or Arrow frame or column; whether it had one dimension."""
    for how in ("to_numpy", "to_pandas"):
        if not isinstance(X, np.ndarray) and hasattr(X, how):
            X = getattr(X, how)()
    try:
        a = np.asarray(X, dtype=np.float64)
    except (TypeError, ValueError) as e:
        raise InputDataError(f"{name} is not numeric", code=Codes.INVALID_SHAPE) from e
    if a.ndim not in (1, 2) or (a.ndim == 2 and a.shape[1] == 0):
        raise InputDataError(f"{name} must have one or two dimensions", code=Codes.INVALID_SHAPE, shape=a.shape)
    if not np.isfinite(a).all():
        raise InputDataError(f"{name} holds NaN or infinity", code=Codes.NONFINITE_INPUT)
    if len(a) < min_obs:
        raise InputDataError(f"{name} has fewer than {min_obs} observations", code=Codes.TOO_FEW_OBSERVATIONS, n=len(a))
    return np.ascontiguousarray(a.reshape(len(a), -1)), a.ndim == 1


def to_exog(exog: object, n: int) -> np.ndarray:
    z, _ = to_matrix(exog, "exog", 0)
    if len(z) != n:
        raise InputDataError("exog must have a row for each observation", code=Codes.EXOG_LENGTH_MISMATCH, rows=len(z), n=n)
    return z


def offsets(indptr: object, total: int) -> np.ndarray:
    """Checked CSR offsets: from 0, rising, to total; no empty series."""
    p = np.asarray(indptr)
    if p.ndim != 1 or len(p) < 2 or not np.issubdtype(p.dtype, np.integer) or p[0] != 0 or (np.diff(p) <= 0).any() or p[-1] != total:
        raise InputDataError("indptr must rise from 0 to the number of rows, without empty series", code=Codes.INVALID_SHAPE)
    return p.astype(np.int64)


def to_panel(panel: object, indptr: object = None) -> tuple[list[np.ndarray], bool]:
    """Series of one width each from a list of arrays, or from a flat array and its offsets."""
    if indptr is not None:
        flat, was_1d = to_matrix(panel, "panel", 1)
        p = offsets(indptr, len(flat))
        return [flat[a:b] for a, b in zip(p[:-1], p[1:], strict=True)], was_1d
    if not isinstance(panel, (list, tuple)) or not len(panel):
        raise InputDataError("a panel is a list of series, or a flat array with indptr", code=Codes.INVALID_SHAPE)
    found = [to_matrix(s, f"series {i}", 1) for i, s in enumerate(panel)]
    if len({m.shape[1] for m, _ in found}) > 1:
        raise InputDataError("all series must have the same number of columns", code=Codes.INVALID_SHAPE)
    return [m for m, _ in found], all(one for _, one in found)


def from_arrays(series: Sequence[np.ndarray], spark: SparkSession | None = None, was_1d: bool = False) -> SeriesFrame:
    """A small in-memory panel as a SeriesFrame; series_id is the place in the list."""
    spark = spark or active_session()
    sizes, width = [len(m) for m in series], series[0].shape[1]
    flat = np.concatenate([np.asarray(m, float) for m in series])
    x = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * width), pa.array(flat.ravel()))
    ids = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    t = pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))
    rows = spark.createDataFrame(pa.table({"series_id": ids, "slot": ids, "t": t, "x": x}), "series_id long, slot long, t int, x array<double>")
    return SeriesFrame(rows, series[0].shape[1], was_1d, (len(sizes), min(sizes), max(sizes)))


def output_type(dtype: str) -> str:
    """Spark's name of the type in which replicate values are returned."""
    if dtype not in ("float64", "float32"):
        raise MethodConfigError("dtype must be 'float64' or 'float32'", code=Codes.INVALID_PARAMETER, given=dtype)
    return "double" if dtype == "float64" else "float"
