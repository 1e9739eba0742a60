"""The kernel path: one task works through whole replicates of whole series in numpy and returns values or statistics.

Series are packed into one row each (their values in order), so a task takes many small series or a part of one large
series' replicates; replicates are dealt in chunks, whose size bounds memory and is no part of the result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Codes, MethodConfigError, ModelStabilityError, TidemarkError
from ..sources.series import SeriesFrame
from ..specs import OBSERVATION_METHODS, CircularBlock, IID, MethodSpec, NonOverlappingBlock, ResidualBootstrap, SieveAR, StationaryBlock, TaperedBlock
from . import models, resample
from .blocklength import optimal_block_length
from .reduce import Statistic

CELLS = 1 << 18  # values that a kernel holds at a time, about
BATCH = 20_000  # statistics that go back to Spark at a time, or one series' if it has more


@dataclass(frozen=True)
class Custom:
    """A method registered from outside; prepared: what prepare makes of a series' values (n, d), once, or the values themselves.

    replicate: (spec, prepared, slot, first, count) -> values (count, n, d). reduce: (spec, prepared, slot, first, count,
    statistic) -> statistics (count, k), or None to have replicates made and reduced as usual.
    """

    replicate: Callable
    prepare: Callable | None = None  # (spec, x, slot) -> anything; a ModelStabilityError is treated as that of a model
    reduce: Callable | None = None

    def prepared(self, spec: MethodSpec, x: np.ndarray, slot: int) -> object:
        return x if self.prepare is None else self.prepare(spec, x, slot)


CUSTOM: dict[type, Custom] = {}


@dataclass(frozen=True)
class Job:
    """All that a task needs to know. exog: the last so many columns of x are regressors."""

    method: MethodSpec
    n_bootstraps: int
    stream: str  # counter or seedseq
    seed: int
    entropy: tuple | None = None  # of the root: entropy, spawn_key, children spawned
    panel: bool = False  # seedseq streams are spawned per slot first
    exog: int = 0
    was_1d: bool = True
    clamp: bool = True  # blocks longer than a series are cut to it; else an error
    custom: Custom | None = None

    def root(self, slot: int) -> np.random.SeedSequence:
        entropy, key, spawned = self.entropy
        root = np.random.SeedSequence(entropy, spawn_key=key, n_children_spawned=spawned)
        return resample.child(root, slot) if self.panel else root

    def indices(self, length: int, n: int, slot: int, first: int, count: int) -> np.ndarray:
        """(count, n) indices of replicates first, first + 1, ... of a series of n observations."""
        if self.stream == "counter":
            return resample.counter_indices(self.method, length, n, self.seed, slot, first, count)
        return resample.seedseq_indices(self.method, length, n, self.root(slot), first, count)

    def length(self, x: np.ndarray) -> int:
        method = self.method
        if isinstance(method, IID):
            return 1
        if method.block_length == "auto":
            return resample.block_length(type(method)(optimal_block_length(x, "stationary" if isinstance(method, StationaryBlock) else "circular")), len(x), warn=False)
        if not self.clamp and not isinstance(method, StationaryBlock):
            resample.check_length(method.block_length, len(x))
        return resample.block_length(method, len(x), warn=False)


def make_job(method: MethodSpec, n_bootstraps: int, random_state: object, stream: str, **more: object) -> Job:
    more["custom"] = CUSTOM.get(type(method))
    if not isinstance(method, (*OBSERVATION_METHODS, ResidualBootstrap, SieveAR)) and not more["custom"]:
        raise MethodConfigError(f"no such method: {method!r}", code=Codes.UNKNOWN_METHOD)
    if not isinstance(n_bootstraps, int) or isinstance(n_bootstraps, bool) or n_bootstraps < 1:
        raise MethodConfigError("n_bootstraps must be an integer of 1 or more", code=Codes.INVALID_PARAMETER, given=n_bootstraps)
    if stream not in ("seedseq", "counter"):
        raise MethodConfigError("stream must be 'seedseq' or 'counter'", code=Codes.INVALID_PARAMETER, given=stream)
    if stream == "counter":
        return Job(method, n_bootstraps, stream, resample.seed64(random_state), **more)
    root = resample.root_of(random_state)
    return Job(method, n_bootstraps, "seedseq", 0, (root.entropy, root.spawn_key, root.n_children_spawned), **more)


def chunks_of(job: Job, x: np.ndarray, slot: int, first: int, count: int) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(first replicate, values (B, n, d), indices (B, n) or None) of replicates first..first + count - 1."""
    size = max(1, CELLS // max(1, x.size))
    values, exog = (x[:, : x.shape[1] - job.exog], x[:, x.shape[1] - job.exog :]) if job.exog else (x, None)
    if job.custom:
        ready = job.custom.prepared(job.method, x, slot)
        for b in range(first, first + count, size):
            yield b, np.asarray(job.custom.replicate(job.method, ready, slot, b, min(size, first + count - b)), float).reshape(min(size, first + count - b), len(x), -1), None
        return
    if isinstance(job.method, OBSERVATION_METHODS):
        if exog is not None:
            raise MethodConfigError("resampling observations takes no exog", code=Codes.UNSUPPORTED_EXOG)
        length = job.length(values)
        for b in range(first, first + count, size):
            n = min(size, first + count - b)
            idx = job.indices(length, len(x), slot, b, n)
            yield b, resample.tapered(values, idx, job.method, length) if isinstance(job.method, TaperedBlock) else values[idx], idx
        return
    ctx = models.prepare(values, job.method, exog)
    for b in range(first, first + count, size):
        n = min(size, first + count - b)
        yield b, models.paths(ctx, *_drawn(job, ctx, slot, b, n)), None


def _drawn(job: Job, ctx: models.Prepared, slot: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Innovations and first values of some replicates, from the job's stream."""
    if job.stream == "counter":
        return models.counter_draws(ctx, job.seed, slot, first, count)
    drawn = [models.draw(ctx, g) for g in resample.generators(job.root(slot), first, count)]
    return np.stack([d[0] for d in drawn]), np.stack([d[1] for d in drawn])


def means_by_blocks(job: Job, x: np.ndarray, slot: int, first: int, count: int) -> np.ndarray:
    """(count, d) means of block replicates from prefix sums; nothing is gathered but two sums a block."""
    n, length = len(x), job.length(x)
    starts = resample.counter_starts(job.method, length, n, job.seed, slot, first, count)
    wrapped = isinstance(job.method, CircularBlock)
    mean = x.mean(axis=0)
    upto = np.zeros((n + (length if wrapped else 0) + 1, x.shape[1]))
    np.cumsum(np.concatenate([x, x[:length]] if wrapped else [x]) - mean, axis=0, out=upto[1:])
    whole, rest = divmod(n, length)
    total = np.zeros((count, x.shape[1]))
    sums = upto[length:] - upto[:-length]
    for k in range(whole):
        total += sums[starts[:, k]]
    if rest:
        total += upto[starts[:, whole] + rest] - upto[starts[:, whole]]
    return mean + total / n


def means_by_segments(job: Job, x: np.ndarray, slot: int, first: int, count: int) -> np.ndarray:
    """(count, d) means of stationary replicates, two prefix sums a segment."""
    n = len(x)
    begin, start = resample.segment_table(job.length(x), n, job.seed, slot, first, count)
    size = np.diff(np.minimum(begin, n), axis=1, append=n)
    mean = x.mean(axis=0)
    upto = np.zeros((2 * n + 1, x.shape[1]))
    np.cumsum(np.concatenate([x, x]) - mean, axis=0, out=upto[1:])
    return mean + (upto[start + size] - upto[start]).sum(axis=1) / n


def moments_by_steps(job: Job, statistic: Statistic, x: np.ndarray, slot: int, first: int, count: int) -> np.ndarray | None:
    """(count, d) means, variances or deviations of AR and VAR paths, step by step; None for other models."""
    values, exog = (x[:, : x.shape[1] - job.exog], x[:, x.shape[1] - job.exog :]) if job.exog else (x, None)
    ctx = models.prepare(values, job.method, exog)
    if ctx.kind == "arima":
        return None
    size, out = max(1, CELLS // max(1, x.size)), []
    for b in range(first, first + count, size):
        mean, var = models.path_moments(ctx, *_drawn(job, ctx, slot, b, min(size, first + count - b)), statistic.name != "mean")
        out.append(mean if statistic.name == "mean" else var if statistic.name == "var" else np.sqrt(var))
    return np.concatenate(out)


def statistics_of(job: Job, statistic: Statistic, x: np.ndarray, slot: int, first: int, count: int) -> np.ndarray:
    """(count, k) statistics of replicates, values held by chunks only."""
    if job.custom and job.custom.reduce:
        own = job.custom.reduce(job.method, job.custom.prepared(job.method, x, slot), slot, first, count, statistic)
        if own is not None:
            return np.asarray(own, float).reshape(count, -1)
    if statistic.name == "mean" and job.stream == "counter" and isinstance(job.method, StationaryBlock):
        return means_by_segments(job, x, slot, first, count)
    fast = statistic.name == "mean" and job.stream == "counter" and isinstance(job.method, OBSERVATION_METHODS) and not isinstance(job.method, (IID, StationaryBlock, TaperedBlock))
    if fast and not (isinstance(job.method, NonOverlappingBlock) and job.length(x) > len(x)):
        return means_by_blocks(job, x, slot, first, count)
    if statistic.name in ("mean", "var", "std") and isinstance(job.method, (ResidualBootstrap, SieveAR)) and not job.custom:
        moments = moments_by_steps(job, statistic, x, slot, first, count)
        if moments is not None:
            return moments
    return np.concatenate([statistic.rows(v, i, job.was_1d) for _, v, i in chunks_of(job, x, slot, first, count)])


def packed(series: SeriesFrame, n_bootstraps: int, tasks: int | None = None, start: int = 0) -> DataFrame:
    """(series_id, slot, x array of rows, first, count): one row for each series and chunk of replicates, from `start` on."""
    x = F.col("x")[0] if series.width == 1 else F.col("x")  # one column: plain numbers, no array a row
    rows = series.rows.groupBy("series_id", "slot").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", x.alias("x")))), lambda s: s["x"]).alias("x"))
    chunk = max(1, math.ceil(n_bootstraps / (tasks or 1)))
    firsts = [(start + a, min(chunk, n_bootstraps - a)) for a in range(0, n_bootstraps, chunk)]
    if len(firsts) == 1:
        return rows.select("series_id", "slot", "x", F.lit(start).alias("first"), F.lit(n_bootstraps).alias("count"))
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(c).alias("count")) for a, c in firsts]))
    return rows.select("series_id", "slot", "x", each.alias("c")).select("series_id", "slot", "x", "c.*").repartition("series_id", "first")


def _matrix(cell: pa.Scalar, width: int) -> np.ndarray:
    values = cell.values.flatten() if width > 1 else cell.values
    return values.to_numpy(zero_copy_only=False).reshape(-1, width)


def _skips(method: MethodSpec) -> bool:
    model = method.model if isinstance(method, ResidualBootstrap) else method
    return getattr(model, "stability_policy", "raise") == "skip"


def run_statistics(series: SeriesFrame, job: Job, statistic: Statistic, tasks: int | None = None) -> DataFrame:
    """(series_id, b, theta array, status): status is null, or the code of why a series was skipped (then b and theta are null)."""
    width, skips = series.width, _skips(job.method)
    id_type = series.rows.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: list[tuple[int, int, np.ndarray]] = []
            rows = 0
            for i in range(batch.num_rows):
                x, slot, first, count = _matrix(batch.column(2)[i], width), batch.column(1)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                try:
                    done.append((i, first, statistics_of(job, statistic, x, slot, first, count)))
                except ModelStabilityError as e:
                    if not skips:
                        raise
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([None], pa.int32()), pa.array([None], pa.list_(pa.float64())), pa.array([e.code])], names)
                    continue
                rows += count
                if rows >= BATCH:
                    yield together(batch.column(0), done)
                    done, rows = [], 0
            if done:
                yield together(batch.column(0), done)

    def together(ids: pa.Array, done: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        """Statistics of several series in one batch, since a batch each would cost more than many a small series."""
        counts = [len(theta) for _, _, theta in done]
        theta = np.concatenate([t for _, _, t in done])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(theta) + 1, dtype=np.int32) * theta.shape[1]), pa.array(theta.ravel()))
        b = np.concatenate([np.arange(first, first + n, dtype=np.int32) for (_, first, _), n in zip(done, counts, strict=True)])
        return pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat([i for i, _, _ in done], counts))), pa.array(b), lists, pa.nulls(len(theta), pa.string())], names)

    names = ["series_id", "b", "theta", "status"]
    return packed(series, job.n_bootstraps, tasks).mapInArrow(run, f"series_id {id_type}, b int, theta array<double>, status string")


def run_values(series: SeriesFrame, job: Job, dtype: str = "double", tasks: int | None = None, start: int = 0) -> DataFrame:
    """(series_id, b, t, idx, x array, status): all values of all replicates from `start` on; idx is null for model-based methods."""
    width, skips = series.width, _skips(job.method)
    id_type = series.rows.schema["series_id"].dataType.simpleString()
    kind = np.float64 if dtype == "double" else np.float32
    names = ["series_id", "b", "t", "idx", "x", "status"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, slot, first, count = _matrix(batch.column(2)[i], width), batch.column(1)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                own = batch.column(0).slice(i, 1)
                try:
                    for b, values, idx in chunks_of(job, x, slot, first, count):
                        n_b, n, d = values.shape
                        lists = pa.ListArray.from_arrays(pa.array(np.arange(n_b * n + 1, dtype=np.int32) * d), pa.array(values.ravel().astype(kind)))
                        at = pa.array(idx.ravel().astype(np.int32)) if idx is not None else pa.nulls(n_b * n, pa.int32())
                        yield pa.RecordBatch.from_arrays([own.take(pa.array(np.zeros(n_b * n, np.int64))), pa.array(np.repeat(np.arange(b, b + n_b, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), n_b)), at, lists, pa.nulls(n_b * n, pa.string())], names)
                except ModelStabilityError as e:
                    if not skips:
                        raise
                    none = [pa.nulls(1, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.from_numpy_dtype(kind)))]
                    yield pa.RecordBatch.from_arrays([own, *none, pa.array([e.code])], names)

    return packed(series, job.n_bootstraps, tasks, start).mapInArrow(run, f"series_id {id_type}, b int, t int, idx int, x array<{dtype}>, status string")


def run_counts(series: SeriesFrame, job: Job, tasks: int | None = None) -> DataFrame:
    """(series_id, b, t, n_inbag long): how often each replicate holds each observation, counted where its indices are drawn."""
    width = series.width
    id_type = series.rows.schema["series_id"].dataType.simpleString()
    names = ["series_id", "b", "t", "n_inbag"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, slot, first, count = _matrix(batch.column(2)[i], width), batch.column(1)[i].as_py(), batch.column(3)[i].as_py(), batch.column(4)[i].as_py()
                n, length = len(x), job.length(x)
                size = max(1, CELLS // n)
                for b in range(first, first + count, size):
                    k = min(size, first + count - b)
                    idx = job.indices(length, n, slot, b, k)
                    found = np.bincount((idx + np.arange(k)[:, None] * n).ravel(), minlength=k * n)
                    own = batch.column(0).slice(i, 1).take(pa.array(np.zeros(k * n, np.int64)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.repeat(np.arange(b, b + k, dtype=np.int32), n)), pa.array(np.tile(np.arange(n, dtype=np.int32), k)), pa.array(found.astype(np.int64))], names)

    return packed(series, job.n_bootstraps, tasks).mapInArrow(run, f"series_id {id_type}, b int, t int, n_inbag long")


def run_points(series: SeriesFrame, call: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(series_id, dim, found array<double>): call(x) of each series' values (n, d), a row of numbers for each dimension."""
    width = series.width
    id_type = series.rows.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.asarray(call(_matrix(x, width)), float) for x in batch.column(1)]
            if not found:
                continue
            rows = np.concatenate(found)
            dims = [len(f) for f in found]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), dims))), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in dims])), lists], ["series_id", "dim", "found"])

    return packed(series, 1).select("series_id", "x").mapInArrow(run, f"series_id {id_type}, dim int, found array<double>")


def check_before(method: MethodSpec, width: int, exog: int) -> None:
    """Errors that don't depend on the data come from the driver, before any task starts."""
    if isinstance(method, OBSERVATION_METHODS):
        if exog:
            raise MethodConfigError("resampling observations takes no exog", code=Codes.UNSUPPORTED_EXOG)
    elif isinstance(method, (ResidualBootstrap, SieveAR)):
        models.check_method(method, width - exog, bool(exog))


__all__ = ["Job", "TidemarkError", "check_before", "make_job", "run_counts", "run_points", "run_statistics", "run_values", "statistics_of"]
