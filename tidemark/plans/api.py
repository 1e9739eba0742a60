"""Entry points: replicates, their statistics, and confidence intervals of one series or of a panel of any size."""

from __future__ import annotations

import math
import platform
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Codes, DegenerateBlockBootstrapWarning, MethodConfigError, OOBUnavailableError
from ..operators import engine, intervals, reduce, resample
from ..operators.blocklength import block_lengths, optimal_block_length
from ..sources.series import SeriesFrame, active_session, from_arrays, output_type, to_exog, to_matrix, to_panel
from ..specs import IID, OBSERVATION_METHODS, CircularBlock, MethodSpec, MovingBlock, NonOverlappingBlock, StationaryBlock, TaperedBlock
from .metadata import MethodMetadata, metadata_for, register_metadata


@dataclass(frozen=True)
class RunMetadata:
    method: str
    params: dict[str, str]
    n_bootstraps: int
    stream: str
    dtype: str
    seed_entropy: str
    versions: dict[str, str]
    references: tuple[str, ...]
    warnings: tuple[str, ...] = ()

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (self.method, self.params, self.n_bootstraps, self.stream, self.dtype, self.seed_entropy, self.versions, list(self.references), list(self.warnings))
        return spark.createDataFrame([row], "method string, params map<string,string>, n_bootstraps int, stream string, dtype string, seed_entropy string, versions map<string,string>, references array<string>, warnings array<string>")


def _provenance(job: engine.Job, dtype: str, notes: list[str]) -> RunMetadata:
    import pyspark

    versions = {"python": platform.python_version(), "numpy": np.__version__, "pyspark": pyspark.__version__}
    params = {k: repr(v) for k, v in vars(job.method).items()}
    return RunMetadata(job.method.kind, params, job.n_bootstraps, job.stream, dtype, str(job.entropy[0] if job.entropy else job.seed), versions, metadata_for(job.method).references, tuple(notes))


@dataclass(frozen=True)
class Bootstrap:
    """Replicates: frame (series_id, b, t, idx, x, status), lazy; rows with a status stand for series that were skipped."""

    frame: DataFrame
    metadata: RunMetadata
    was_1d: bool = True
    counts: Callable[[], DataFrame] | None = None  # in-bag counts straight from the indices, where there are some

    @property
    def failed(self) -> DataFrame:
        return self.frame.where("status is not null").select("series_id", "status").distinct()

    def _ordered(self) -> Iterator:
        return self.frame.where("status is null").orderBy("series_id", "b", "t").toLocalIterator()

    def values(self) -> np.ndarray:
        """(B, n) or (B, n, d) of one small series, on the driver."""
        rows = list(self._ordered())
        if not rows:
            return np.empty((0, 0))
        b = len({r["b"] for r in rows})
        out = np.array([r["x"] for r in rows], np.float32 if self.metadata.dtype == "float32" else np.float64).reshape(b, len(rows) // b, -1)
        return out[:, :, 0] if self.was_1d else out

    def indices(self) -> np.ndarray | None:
        """(B, n) of one small series, on the driver; None for model-based methods."""
        rows = list(self._ordered())
        if not rows or rows[0]["idx"] is None:
            return None
        b = len({r["b"] for r in rows})
        return np.array([r["idx"] for r in rows], np.int32).reshape(b, -1)

    def inbag_counts(self) -> DataFrame:
        """series_id, b, t, n_inbag: how often each replicate holds each observation; no value is gathered for it."""
        if self.counts is None:
            raise OOBUnavailableError("model-based replicates have no observation indices", code=Codes.OOB_UNAVAILABLE, method=self.metadata.method)
        return self.counts()

    def out_of_bag(self) -> DataFrame:
        return self.inbag_counts().where("n_inbag = 0").drop("n_inbag")


@dataclass(frozen=True)
class Reduced:
    """Statistics: frame (series_id, b, theta array, status), lazy."""

    frame: DataFrame
    metadata: RunMetadata

    def long(self) -> DataFrame:
        """series_id, b, dim, theta."""
        return self.frame.where("status is null").select("series_id", "b", F.posexplode("theta").alias("dim", "theta"))

    def quantile(self, *levels: float) -> DataFrame:
        """series_id, dim, q array: exact quantiles over replicates."""
        return reduce.replicate_quantiles(self.long(), list(levels))

    @property
    def statistics(self) -> np.ndarray | None:
        """(B,) or (B, k) of one series, on the driver; None if it was skipped."""
        rows = self.frame.orderBy("b").collect()
        if rows[0]["status"] is not None:
            return None
        out = np.array([r["theta"] for r in rows])
        return out[:, 0] if out.shape[1] == 1 else out


def _series(X: object, exog: object = None) -> tuple[SeriesFrame, int]:
    if isinstance(X, SeriesFrame):
        if exog is not None and not isinstance(exog, int):
            raise MethodConfigError("with a SeriesFrame, exog is the number of its last columns that are regressors", code=Codes.UNSUPPORTED_EXOG)
        return X, int(exog or 0)
    x, was_1d = to_matrix(X)
    if exog is None:
        return from_arrays([x], was_1d=was_1d), 0
    z = to_exog(exog, len(x))
    return from_arrays([np.column_stack([x, z])], was_1d=was_1d), z.shape[1]


def _notes(series: SeriesFrame, method: MethodSpec) -> list[str]:
    """Warns, once, of blocks that are as long as a series."""
    length = getattr(method, "block_length", None)
    if not isinstance(method, OBSERVATION_METHODS) or isinstance(method, (IID, StationaryBlock)) or not isinstance(length, int):
        return []
    shortest = series.extent[1]
    if 0 < shortest <= length:
        note = f"block length {length} with {shortest} observations: each replicate is one block"
        warnings.warn(DegenerateBlockBootstrapWarning(note), stacklevel=4)
        return [note]
    return []


def _tasks(series: SeriesFrame, n_bootstraps: int) -> int:
    """Chunks of replicates per series: more where there are few series than cores."""
    cores = series.rows.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n_bootstraps, math.ceil(cores / max(1, series.extent[0]))))


def bootstrap(X: object, *, method: MethodSpec, n_bootstraps: int = 999, random_state: object = None, exog: object = None, dtype: str = "float64", stream: str = "seedseq") -> Bootstrap:
    """Replicates of one series (array, frame) or of every series of a SeriesFrame.

    stream: "seedseq", a generator for each replicate, spawned from random_state; or "counter", a pure function of seed,
    series, replicate and place, which any engine can repeat.
    """
    out = output_type(dtype)
    series, n_exog = _series(X, exog)
    engine.check_before(method, series.width, n_exog)
    job = engine.make_job(method, n_bootstraps, random_state, stream, panel=isinstance(X, SeriesFrame), exog=n_exog, was_1d=series.was_1d or series.width - n_exog == 1, clamp=isinstance(X, SeriesFrame))
    notes = _notes(series, method)
    tasks = _tasks(series, n_bootstraps)
    counts = (lambda: engine.run_counts(series, job, tasks)) if isinstance(method, OBSERVATION_METHODS) else None
    return Bootstrap(engine.run_values(series, job, out, tasks), _provenance(job, dtype, notes), series.was_1d, counts)


def bootstrap_frame(series: SeriesFrame, method: MethodSpec, n_bootstraps: int, seed: int = 0) -> DataFrame:
    """(series_id, b, t, idx, x) by DataFrame operators alone: index frame, then a join on (series_id, idx). Counter stream."""
    sizes = with_lengths(series, method)
    idx = resample.index_frame(sizes, method, n_bootstraps, seed)
    if not isinstance(method, TaperedBlock):
        return resample.gathered(series.rows, idx)
    means = series.rows.select("series_id", F.posexplode("x").alias("dim", "v")).groupBy("series_id", "dim").agg(F.avg("v").alias("m")).groupBy("series_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("mean"))
    lengths = sizes.select("series_id", "length", resample.taper_scale(method, F.col("length")).alias("scale"))
    # what a series needs goes with its observations, of which there are fewer than places in replicates
    rows = series.rows.join(means, "series_id").join(lengths, "series_id").select("series_id", "t", F.struct("x", "mean", "length", "scale").alias("x"))
    got = resample.gathered(rows, idx).select("series_id", "b", "t", "idx", "x.*")
    weight = F.coalesce(resample.taper_column(method, F.pmod("t", "length"), F.col("length")) / F.col("scale"), F.lit(1.0))
    return got.withColumn("w", weight).select("series_id", "b", "t", "idx", F.zip_with("x", "mean", lambda x, m: m + F.col("w") * (x - m)).alias("x"))


def with_lengths(series: SeriesFrame, method: MethodSpec, clamp: bool = True) -> DataFrame:
    """series_id, slot, n, length: "auto" resolved per series, and lengths cut to n."""
    sizes = series.sizes()
    if isinstance(method, IID):
        return sizes.withColumn("length", F.lit(1))
    if method.block_length != "auto":
        fixed = F.least(F.lit(int(method.block_length)), F.col("n"))
        if not clamp:
            fixed = F.when(F.col("n") < method.block_length, F.raise_error(F.lit(Codes.BLOCK_LENGTH_GT_N)).cast("int")).otherwise(fixed)
        return sizes.withColumn("length", fixed)
    which = "b_stationary" if isinstance(method, StationaryBlock) else "b_circular"
    per = series.long().select(F.struct("series_id", "dim").alias("series_id"), "t", "v")
    auto = block_lengths(per).groupBy(F.col("series_id.series_id").alias("series_id")).agg(F.max(F.ceil(which)).cast("int").alias("length"))
    return sizes.join(auto, "series_id").withColumn("length", F.greatest(F.lit(1), F.least("length", "n")))


def bootstrap_reduce(X: object, *, method: MethodSpec, statistic: object, n_bootstraps: int = 999, random_state: object = None, exog: object = None, stream: str = "seedseq", vectorized: bool = False) -> Reduced:
    """A statistic of each replicate, of which no more are held at a time than a kernel works on.

    statistic: "mean", "var", "std", "median", ("quantile", q), or a callable (values, indices) -> number or array.
    """
    what = reduce.statistic_of(statistic, vectorized=vectorized)
    series, n_exog = _series(X, exog)
    engine.check_before(method, series.width, n_exog)
    job = engine.make_job(method, n_bootstraps, random_state, stream, panel=isinstance(X, SeriesFrame), exog=n_exog, was_1d=series.was_1d or series.width - n_exog == 1, clamp=isinstance(X, SeriesFrame))
    notes = _notes(series, method)
    if stream == "counter" and series.extent[2] > LONG and isinstance(method, OBSERVATION_METHODS) and what.name != "call":
        frame = _long_statistics(series, method, what, n_bootstraps, job.seed)
    else:
        frame = engine.run_statistics(series, job, what, _tasks(series, n_bootstraps))
    return Reduced(frame, _provenance(job, "float64", notes))


#: Observations beyond which a series isn't packed into one row, with the counter stream and a named statistic.
LONG = 1 << 22


def _long_statistics(series: SeriesFrame, method: MethodSpec, what: reduce.Statistic, n_bootstraps: int, seed: int) -> DataFrame:
    """As engine.run_statistics(), for series of any length, by DataFrame operators: block means by prefix sums, all else by a join.

    Quantiles over a replicate hold its distinct values, so they ask for memory as long as a series has many.
    """
    if what.name == "mean" and isinstance(method, (MovingBlock, CircularBlock, NonOverlappingBlock)):
        starts = resample.start_frame(with_lengths(series, method), method, n_bootstraps, seed)
        columns = [reduce.block_sum_means(series.rows.select("series_id", "t", F.col("x")[j].alias("v")), starts, method).withColumn("dim", F.lit(j)) for j in range(series.width)]
        long = columns[0]
        for c in columns[1:]:
            long = long.unionByName(c)
    else:
        long = reduce.reduce_frame(bootstrap_frame(series, method, n_bootstraps, seed), what)
    theta = F.transform(F.sort_array(F.collect_list(F.struct("dim", "theta"))), lambda s: s["theta"])
    return long.groupBy("series_id", "b").agg(theta.alias("theta")).select("series_id", "b", "theta", F.lit(None).cast("string").alias("status"))


def bootstrap_reduce_panel(panel: object, *, indptr: object = None, method: MethodSpec, statistic: object, n_bootstraps: int = 999, random_state: object = None, stream: str = "counter", vectorized: bool = False) -> Reduced:
    """As bootstrap_reduce(), for a SeriesFrame, a list of series, or a flat array with offsets: ragged, any number of series."""
    if not isinstance(panel, SeriesFrame):
        arrays, was_1d = to_panel(panel, indptr)
        panel = from_arrays(arrays, was_1d=was_1d)
    return bootstrap_reduce(panel, method=method, statistic=statistic, n_bootstraps=n_bootstraps, random_state=random_state, stream=stream, vectorized=vectorized)


def bootstrap_iter(X: object, *, method: MethodSpec, n_bootstraps: int = 999, random_state: object = None, exog: object = None, stream: str = "seedseq", chunk: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(values, indices) of `chunk` replicates at a time of one series, in order; nothing for a series that is skipped.

    Each chunk is worked out by tasks, as bootstrap() would, when it is asked for; the driver holds one chunk.
    """
    series, n_exog = _series(X, exog)
    if series.extent[0] > 1:
        raise MethodConfigError("bootstrap_iter takes one series", code=Codes.INVALID_SHAPE, series=series.extent[0])
    engine.check_before(method, series.width, n_exog)
    job = engine.make_job(method, n_bootstraps, random_state, stream, exog=n_exog, was_1d=series.was_1d or series.width - n_exog == 1, clamp=False)
    for first in range(0, n_bootstraps, chunk):
        count = min(chunk, n_bootstraps - first)
        part = engine.run_values(series, replace(job, n_bootstraps=count), "double", _tasks(series, count), first)
        rows = part.select("b", "t", "idx", "x", "status").orderBy("b", "t").toArrow()
        if not len(rows) or rows.column("status")[0].as_py() is not None:
            return
        values = rows.column("x").combine_chunks().flatten().to_numpy().reshape(count, len(rows) // count, -1)
        idx = None if rows.column("idx").null_count else rows.column("idx").to_numpy().astype(np.int32).reshape(count, -1)
        yield (values[:, :, 0] if series.was_1d else values), idx


def register_method(kind: type, metadata: MethodMetadata, replicate: Callable, *, prepare: Callable | None = None, reduce: Callable | None = None) -> None:
    """A method of one's own: its record, and functions that run in tasks, as engine.Custom describes them.

    replicate makes values; prepare, if given, fits once a series and chunk of replicates what replicate then gets in the
    series' place; reduce, if given, makes statistics without values, and may return None for those that it can't.
    """
    register_metadata(kind, metadata)
    engine.CUSTOM[kind] = engine.Custom(replicate, prepare, reduce)


def conf_int(X: object, statistic: object, *, method: MethodSpec, kind: str = "percentile", alpha: float = 0.05, n_bootstraps: int = 999, random_state: object = None, stream: str = "seedseq", se_statistic: Callable | None = None, se_block_length: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, point) of a statistic of one series; kinds: percentile, basic, studentized, bca."""
    if isinstance(X, (list, tuple)) or getattr(X, "ndim", 1) > 2:
        raise MethodConfigError("conf_int takes one series, as an array or frame; a list or three dimensions may mean a panel: conf_int_panel", code=Codes.INVALID_PARAMETER)
    intervals.check_kind(kind, method, alpha)
    what = reduce.statistic_of(statistic, open_level=True)
    x, was_1d = to_matrix(X)
    shown = x[:, 0] if was_1d else x
    observed = isinstance(method, OBSERVATION_METHODS)
    point = what.rows(x[None], np.arange(len(x))[None] if observed else None, was_1d)[0]
    plain = lambda v: what.rows(v.reshape(1, len(v), -1), None, was_1d)[0]
    run = lambda s: bootstrap_reduce(X, method=method, statistic=s, n_bootstraps=n_bootstraps, random_state=random_state, stream=stream)
    squeeze = lambda *a: tuple(np.squeeze(v) if np.size(v) == 1 else v for v in a)
    if kind == "studentized":
        length = intervals.se_length(method, x, se_block_length)
        error = se_statistic or (lambda v, _: intervals.block_jackknife_se(v, plain, length))
        k = len(point)
        both = run(lambda v, i: np.concatenate([what.rows(v.reshape(1, len(v), -1), None if i is None else i[None], was_1d)[0], np.ravel(error(v, i))])).statistics
        low, high = intervals.studentized_interval(both[:, :k], both[:, k:], point, np.ravel(error(shown, np.arange(len(x)))), alpha)
        return squeeze(low, high, point)
    acceleration = intervals.jackknife_acceleration(intervals.jackknife_statistics(x, plain)) if kind == "bca" else None
    statistics = run(what).statistics
    if statistics is None:
        raise MethodConfigError("the model was skipped as unstable", code=Codes.UNSTABLE_MODEL)
    statistics = statistics.reshape(n_bootstraps, -1)
    if kind == "bca":
        low, high = intervals.bca_interval(statistics, point, acceleration, alpha)
    elif kind == "basic":
        low, high = intervals.basic_interval(statistics, point, alpha)
    else:
        low, high = intervals.percentile_interval(statistics, alpha)
    return squeeze(low, high, point)


def _with_errors(what: reduce.Statistic, se_statistic: Callable | None, length: int | None, was_1d: bool) -> Callable:
    """A vectorized statistic: k numbers of each replicate, then their k standard errors."""

    def call(values: np.ndarray, indices: np.ndarray | None) -> np.ndarray:
        v = values.reshape(len(values), values.shape[1], -1)
        theta = what.rows(v, indices, was_1d)
        if se_statistic is None:
            return np.concatenate([theta, intervals.block_jackknife_errors(v, indices, what, length, was_1d)], axis=1)
        shown = v[:, :, 0] if was_1d else v
        return np.concatenate([theta, [np.ravel(np.asarray(se_statistic(shown[b], None if indices is None else indices[b]), float)) for b in range(len(v))]], axis=1)

    return call


def conf_int_panel(panel: object, statistic: object, *, indptr: object = None, method: MethodSpec, kind: str = "percentile", alpha: float = 0.05, n_bootstraps: int = 999, seed: int = 0, se_statistic: Callable | None = None, se_block_length: int | None = None) -> DataFrame:
    """series_id, dim, lower, upper, point for every series and every number that the statistic gives (a column each, for named ones).

    panel: a SeriesFrame, a list of series, or a flat array with offsets. dim is left out where there can only be one: a
    named statistic of one column. Studentized errors: se_statistic, or a block jackknife with se_block_length or else the
    method's own length (IID: 1). BCa needs IID.
    """
    intervals.check_kind(kind, method, alpha)
    what = reduce.statistic_of(statistic, open_level=True)
    if not isinstance(panel, SeriesFrame):
        arrays, one = to_panel(panel, indptr)
        panel = from_arrays(arrays, was_1d=one)
    was_1d = panel.was_1d or panel.width == 1
    single = panel.width == 1 and what.name != "call"
    key = F.col("series_id") if single else F.struct("series_id", "dim")
    run = lambda s: bootstrap_reduce_panel(panel, method=method, statistic=s, n_bootstraps=n_bootstraps, random_state=seed)
    observed = isinstance(method, OBSERVATION_METHODS)
    identity = lambda x: np.arange(len(x))[None] if observed else None
    plain = lambda v: what.rows(v.reshape(1, len(v), -1), None, was_1d)[0]
    found = lambda i: F.col("found")[i]
    if kind == "studentized":
        length = se_block_length or (1 if isinstance(method, IID) else method.block_length if isinstance(method.block_length, int) else None)
        if length is None and se_statistic is None:
            raise MethodConfigError("a studentized panel needs se_block_length, se_statistic, or a method with a block length of its own", code=Codes.INVALID_PARAMETER)
        both = _with_errors(what, se_statistic, length, was_1d)
        points = engine.run_points(panel, lambda x: both(x[None, :, 0] if was_1d else x[None], identity(x)).reshape(2, -1).T)
        points = points.select(key.alias("series_id"), found(0).alias("point"), found(1).alias("se"))
        k = F.expr("cast(size(theta) div 2 as int)")
        pairs = F.posexplode(F.arrays_zip(F.slice("theta", F.lit(1), k).alias("theta"), F.slice("theta", k + 1, k).alias("se"))).alias("dim", "e")
        theta = run(reduce.Statistic("call", call=both, vectorized=True)).frame.where("status is null").select("series_id", "b", pairs)
        out = intervals.studentized_frame(theta.select(key.alias("series_id"), "b", "e.theta", "e.se"), points, alpha)
    else:
        theta = run(what).long().select(key.alias("series_id"), "b", "theta")
        long = panel.long().select(key.alias("series_id"), "t", "v") if what.name != "call" else None
        if kind == "bca" and what.name == "mean":
            points, acceleration = long.groupBy("series_id").agg(what.column(F.col("v")).alias("point")), intervals.acceleration_of_means(long)
        elif kind == "bca":
            both = engine.run_points(panel, lambda x: np.column_stack([what.rows(x[None], identity(x), was_1d)[0], intervals.jackknife_acceleration(intervals.jackknife_statistics(x, plain))]))
            points, acceleration = both.select(key.alias("series_id"), found(0).alias("point")), both.select(key.alias("series_id"), found(1).alias("acceleration"))
        elif long is not None:
            points = long.groupBy("series_id").agg(what.column(F.col("v")).alias("point"))
        else:
            points = engine.run_points(panel, lambda x: what.rows(x[None], identity(x), was_1d).T).select(key.alias("series_id"), found(0).alias("point"))
        if kind == "bca":
            out = intervals.bca_frame(theta, points, acceleration, alpha)
        elif kind == "basic":
            out = intervals.basic_frame(theta, points, alpha)
        else:
            out = intervals.percentile_frame(theta, alpha).join(points, "series_id")
    ids = ["series_id"] if single else ["series_id.series_id", "series_id.dim"]
    return out.select(*ids, "lower", "upper", "point")


__all__ = ["Bootstrap", "Reduced", "bootstrap", "bootstrap_iter", "bootstrap_reduce", "bootstrap_reduce_panel", "conf_int", "conf_int_panel", "metadata_for", "optimal_block_length", "active_session"]
