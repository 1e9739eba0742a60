"""Adaptive conformal inference over a stream, and series made of a stream by event time.

A series' state is bounded: its calibration scores, and a level (ACI) or a level, a regret and a rate for each expert (AgACI).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.conformal import AGACI_GAMMAS, SENTINEL_CAP, BoaState, aci_step
from ..specs import AgACI


def online_aci(scores: DataFrame, alpha: float = 0.1, gamma: float = 0.05, calibration: int = 50) -> DataFrame:
    """Streaming scores (series_id, pos, r) -> series_id, pos, width, level, in append mode.

    The first `calibration` scores of a series calibrate it and give no row. Within a micro-batch rows are taken by pos;
    between batches they must come in order, as a partitioned log keeps them. State is bounded: `calibration` numbers and
    a level for each series.
    """
    id_type, pos_type = dict(scores.dtypes)["series_id"], dict(scores.dtypes)["pos"]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, level = (list(state.get[0]), state.get[1]) if state.exists else ([], alpha)
        rows = pd.concat(list(frames)).sort_values("pos")
        out = []
        ordered = np.sort(known) if len(known) >= calibration else None
        for pos, r in zip(rows["pos"], rows["r"].abs(), strict=True):
            if ordered is None:
                known.append(float(r))
                ordered = np.sort(known) if len(known) >= calibration else None
                continue
            width, used, level = aci_step(ordered, level, float(r), alpha, gamma)
            out.append((key[0], pos, width, used))
        state.update((known, float(level)))
        yield pd.DataFrame(out, columns=["series_id", "pos", "width", "level"])

    return scores.select("series_id", "pos", "r").groupBy("series_id").applyInPandasWithState(run, f"series_id {id_type}, pos {pos_type}, width double, level double", "known array<double>, level double", "append", GroupStateTimeout.NoTimeout)


def online_agaci(residuals: DataFrame, alpha: float = 0.1, spec: AgACI | None = None, calibration: int = 50) -> DataFrame:
    """Streaming signed residuals (series_id, pos, r) -> series_id, pos, lower, upper, in append mode: AgACI one row at a time.

    The first `calibration` rows of a series calibrate it and give no row; order is as for online_aci(). An expert that
    covers everything gets the spec's infinite_sentinel or, where there is none, ten times the widest finite width or
    residual that the series has shown so far; the batch function, which knows the whole series, takes the widest of all.
    """
    spec = spec or AgACI()
    steps = np.asarray(AGACI_GAMMAS if spec.gammas is None else spec.gammas, float)
    id_type, pos_type = dict(residuals.dtypes)["series_id"], dict(residuals.dtypes)["pos"]
    k = len(steps)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, levels, widest, sums = (list(state.get[0]), np.array(state.get[1]), state.get[2], np.array(state.get[3])) if state.exists else ([], np.full(k, alpha), 0.0, np.zeros(4 * k))
        ends = [BoaState(k, tau, spec.boa_regret_constant) for tau in (alpha / 2, 1 - alpha / 2)]
        for i, end in enumerate(ends):
            end.regret, end.energy = sums[2 * i * k : (2 * i + 1) * k].copy(), sums[(2 * i + 1) * k : (2 * i + 2) * k].copy()
        rows = pd.concat(list(frames)).sort_values("pos")
        ordered = np.sort(known) if len(known) >= calibration else None
        out = []
        for pos, r in zip(rows["pos"], rows["r"], strict=True):
            if ordered is None:
                known.append(abs(float(r)))
                ordered = np.sort(known) if len(known) >= calibration else None
                continue
            widths = np.empty(k)
            for j, gamma in enumerate(steps):
                widths[j], _, levels[j] = aci_step(ordered, levels[j], abs(float(r)), alpha, gamma)
            finite = np.isfinite(widths)
            widest = max([widest, *widths[finite]])
            widths[~finite] = min(10 * (widest or 1.0), SENTINEL_CAP) if spec.infinite_sentinel is None else spec.infinite_sentinel
            out.append((key[0], pos, -ends[0].step(-widths, float(r)), ends[1].step(widths, float(r))))
            widest = max(widest, abs(float(r)))
        sums = np.concatenate([x for end in ends for x in (end.regret, end.energy)])
        state.update((known, levels.tolist(), float(widest), sums.tolist()))
        yield pd.DataFrame(out, columns=["series_id", "pos", "lower", "upper"])

    return residuals.select("series_id", "pos", "r").groupBy("series_id").applyInPandasWithState(run, f"series_id {id_type}, pos {pos_type}, lower double, upper double", "known array<double>, levels array<double>, widest double, sums array<double>", "append", GroupStateTimeout.NoTimeout)


def windowed_series(events: DataFrame, value: str, *, time: str, series: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Streaming events -> series_id, start (of the window), v (mean), n, in append mode: a series of windows of event time.

    A window is given once the watermark, the latest time seen less `delay`, has passed its end; events for windows that
    the watermark of the batch before had passed are dropped, and state holds open windows alone. Rows without a time, a value or a series take no part.
    """
    rows = events.select(F.col(series).alias("series_id"), F.col(time).alias("_time"), F.col(value).cast("double").alias("v")).where("_time is not null and v is not null and series_id is not null")
    windows = rows.withWatermark("_time", delay).groupBy("series_id", F.window("_time", width).alias("w")).agg(F.avg("v").alias("v"), F.count("*").alias("n"))
    return windows.select("series_id", F.col("w.start").alias("start"), "v", "n")
