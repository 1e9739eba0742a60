"""Forecast intervals of an AR model by resampled residuals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Codes, MethodConfigError
from ..functions import philox
from ..sources.series import SeriesFrame, to_matrix
from ..specs import AR
from . import models, resample
from .engine import _matrix, packed
from .intervals import check_alpha


def _future(x: np.ndarray, fit: models.Fit, e: np.ndarray) -> np.ndarray:
    """(B, horizon) values after x from innovations e (B, horizon)."""
    past = [np.full(len(e), v) for v in x[-fit.order :]]
    for h in range(e.shape[1]):
        past.append(fit.const + e[:, h] + sum(c * past[-1 - j] for j, c in enumerate(fit.lags)))
    return np.stack(past[fit.order :], axis=1)


def forecast_intervals(X: object, *, model: AR, horizon: int, n_bootstraps: int = 999, alpha: float = 0.05, random_state: object = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, median) of each of the next `horizon` steps of one series."""
    _check(model, horizon, alpha)
    x = to_matrix(X)[0][:, 0]
    fit = models.fit_ar(x, model.order)
    models.check_stability(fit.lags)
    e = fit.residuals - fit.residuals.mean()
    idx = np.array([g.integers(0, len(e), size=horizon) for g in resample.generators(resample.root_of(random_state), 0, n_bootstraps)])
    low, high, mid = np.quantile(_future(x, fit, e[idx]), [alpha / 2, 1 - alpha / 2, 0.5], axis=0)
    return low, high, mid


def _check(model: object, horizon: int, alpha: float) -> None:
    check_alpha(alpha)
    if type(model) is not AR or horizon < 1:
        raise MethodConfigError("forecasts need an AR model and a horizon of 1 or more", code=Codes.INVALID_PARAMETER)


def forecast_frame(series: SeriesFrame, model: AR, horizon: int, n_bootstraps: int = 999, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """series_id, h (from 1), lower, upper, median, for every series; draws are of the counter stream."""
    _check(model, horizon, alpha)
    id_type, width = series.rows.schema["series_id"].dataType.simpleString(), series.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x, slot = _matrix(batch.column(2)[i], width)[:, 0], batch.column(1)[i].as_py()
                fit = models.fit_ar(x, model.order)
                models.check_stability(fit.lags)
                e = fit.residuals - fit.residuals.mean()
                idx = philox.draws(seed, philox.RESIDUAL, slot, 0, n_bootstraps, horizon, len(e))
                low, high, mid = np.quantile(_future(x, fit, e[idx]), [alpha / 2, 1 - alpha / 2, 0.5], axis=0)
                own = batch.column(0).slice(i, 1).take(pa.array(np.zeros(horizon, np.int64)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.arange(1, horizon + 1, dtype=np.int32)), pa.array(low), pa.array(high), pa.array(mid)], ["series_id", "h", "lower", "upper", "median"])

    return packed(series, n_bootstraps).select("series_id", "slot", "x").mapInArrow(run, f"series_id {id_type}, h int, lower double, upper double, median double")


def ar1_frame(rows: DataFrame) -> DataFrame:
    """rows (series_id, t, v) -> series_id, const, phi, n: least squares of an AR(1), as aggregates over a lag."""
    from pyspark.sql import Window

    lag = rows.select("series_id", "v", F.lag("v").over(Window.partitionBy("series_id").orderBy("t")).alias("p")).where("p is not null")
    return lag.groupBy("series_id").agg(F.regr_intercept("v", "p").alias("const"), F.regr_slope("v", "p").alias("phi"), F.count("*").alias("n"))
