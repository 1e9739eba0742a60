"""Automatic block length by the spectral plug-in rule of Politis and White (2004; corrected by Patton et al., 2009)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT = 64  # up to so many lags are multiplied out


def autocovariances(x: np.ndarray, lags: int) -> np.ndarray:
    """R(0..lags), divided by n."""
    c = x - x.mean()
    if lags <= DIRECT:
        return np.array([c[: len(c) - k] @ c[k:] for k in range(lags + 1)]) / len(c)
    size = 1 << (len(c) + lags).bit_length()
    return np.fft.irfft(np.abs(np.fft.rfft(c, size)) ** 2, size)[: lags + 1] / len(c)


def flat_top(x: np.ndarray) -> np.ndarray:
    a = np.abs(x)
    return np.where(a <= 0.5, 1.0, np.where(a <= 1, 2 * (1 - a), 0.0))


def _bounds(n: int) -> tuple[int, int, float]:
    """(lags in a quiet run, most lags, what counts as correlation)."""
    run = int(max(5, math.sqrt(math.log10(n))))
    return run, min(math.ceil(math.sqrt(n)) + run, n - 1), 2 * math.sqrt(math.log10(n) / n)


def tuning_lag(r: np.ndarray, n: int) -> int:
    run, most, limit = _bounds(n)
    if r[0] <= 0:
        return 1
    loud = np.abs(r[1 : most + 1] / r[0]) >= limit
    quiet = np.convolve(~loud, np.ones(run), "valid") == run if len(loud) >= run else np.empty(0, bool)
    if quiet.any():
        m = int(np.argmax(quiet)) + 1  # the first lag of the quiet run
    else:
        m = int(np.flatnonzero(loud)[-1]) + 1 if loud.any() else 1
    return max(1, min(2 * m, most))


def plug_in(x: np.ndarray) -> tuple[float, float]:
    """Lengths for the stationary and the circular bootstrap of one column."""
    return tuned(x)[1:]


def tuned(x: np.ndarray) -> tuple[int, float, float]:
    """The tuning lag, and the lengths of plug_in()."""
    n = len(x)
    if n < 4:
        return 1, 1.0, 1.0
    r = autocovariances(x, _bounds(n)[1])
    m = tuning_lag(r, n)
    k = np.arange(-m, m + 1)
    w, rk = flat_top(k / m), r[np.abs(k)]
    g, spectrum = float((w * np.abs(k) * rk).sum()), float((w * rk).sum())
    top = math.ceil(min(3 * math.sqrt(n), n / 3))
    out = []
    for scale in (2.0, 4.0 / 3.0):
        d = scale * spectrum**2
        out.append(1.0 if d <= 0 or abs(g) <= 1e-12 else min(max((2 * g * g / d) ** (1 / 3) * n ** (1 / 3), 1.0), float(top)))
    return m, out[0], out[1]


def optimal_block_length(x: np.ndarray, kind: str = "circular") -> int:
    """The largest over the columns of x (n, d), rounded up, within 1..n; kind: "stationary", or any other method's."""
    which = 0 if kind == "stationary" else 1
    longest = max(plug_in(x[:, j])[which] for j in range(x.shape[1]))
    return int(min(max(math.ceil(longest), 1), len(x)))


def block_lengths(rows: DataFrame) -> DataFrame:
    """rows (series_id, t, v) -> series_id, n, m, b_stationary, b_circular: tuned() of each series, whatever its length.

    A series is packed into one array, and many arrays make one batch of a kernel; its autocovariances, of which the rule
    asks for about sqrt(n), come from one Fourier transform where they are many, so the work is n log n and no row is
    multiplied.
    """
    line = F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda s: s["v"].cast("double"))
    id_type = rows.schema["series_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series = [x.values.to_numpy(zero_copy_only=False) for x in batch.column(1)]
            found = [tuned(x) for x in series]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in series], pa.int32()), pa.array([f[0] for f in found], pa.int32()), *[pa.array([f[j] for f in found], pa.float64()) for j in (1, 2)]], ["series_id", "n", "m", "b_stationary", "b_circular"])

    return rows.groupBy("series_id").agg(line.alias("x")).mapInArrow(run, f"series_id {id_type}, n int, m int, b_stationary double, b_circular double")
