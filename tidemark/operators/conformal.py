"""Conformal prediction: the out-of-bag ensemble, and calibrators with fixed, sliding, weighted and adaptive widths."""

from __future__ import annotations

import copy
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Codes, MethodConfigError, OOBUnavailableError
from ..specs import ACI, OBSERVATION_METHODS, AgACI, CalibratorSpec, MethodSpec, NexCP, SlidingWindow, Static
from .engine import make_job

# The grid of step sizes of Zaffran et al. (2022).
AGACI_GAMMAS = (0.0, 5e-6, 5e-5, *(k * 1e-4 for k in range(1, 10)), *(k * 1e-3 for k in range(1, 10)), *(k * 1e-2 for k in range(1, 10)))
SENTINEL_CAP = 1e150


def _scores(values: object, name: str = "scores") -> np.ndarray:
    a = np.asarray(values, float).ravel()
    if not len(a) or not np.isfinite(a).all():
        raise ValueError(f"{name} must be finite and not empty")
    return a


def static_halfwidths(residuals: object, alpha: float = 0.1, size: int | None = None) -> np.ndarray:
    r = np.abs(_scores(residuals))
    return np.full(size or len(r), np.quantile(r, 1 - alpha))


def sliding_window_halfwidths(residuals: object, alpha: float = 0.1, window: int | None = None, size: int | None = None) -> np.ndarray:
    """Quantile of the last `window` residuals up to each row; rows beyond the residuals use the last window."""
    r = np.abs(_scores(residuals))
    w = window or min(len(r), 50)
    widths = np.array([np.quantile(r[max(0, t - w + 1) : t + 1], 1 - alpha) for t in range(len(r))])
    at = np.minimum(np.arange(size or len(r)), len(r) - 1)
    return widths[at]


def nexcp_quantile(residuals: object, alpha: float = 0.1, decay: float = 0.99) -> float:
    """Weighted quantile: the smallest score at which the weights of scores up to it reach 1 - alpha of the total; the latest weighs 1."""
    r = np.abs(_scores(residuals))
    weights = decay ** np.arange(len(r) - 1, -1, -1.0)
    order = np.argsort(r, kind="stable")
    upto = np.cumsum(weights[order])
    return float(r[order][min(np.searchsorted(upto, (1 - alpha) * upto[-1]), len(r) - 1)])


def _linear(ordered: np.ndarray, level: float) -> float:
    h = level * (len(ordered) - 1)
    low = int(h)
    if low >= len(ordered) - 1:
        return float(ordered[-1])
    a, b, f = ordered[low], ordered[low + 1], h - low
    return float(a + (b - a) * f if f < 0.5 else b - (b - a) * (1 - f))


def aci_step(ordered: np.ndarray, level: float, score: float, alpha: float, gamma: float) -> tuple[float, float, float]:
    """(half-width, level used, next level): the width is set before the score is seen; a miss lowers the level."""
    used = min(max(level, 0.0), 1.0)
    q = np.inf if used <= 0 else 0.0 if used >= 1 else _linear(ordered, 1 - used)
    return q, used, level + gamma * (alpha - (score > q))


def aci_halfwidths(calibration: object, scores: object, alpha: float = 0.1, gamma: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Adaptive conformal inference (Gibbs and Candes, 2021): half-widths and the levels that gave them."""
    ordered, level = np.sort(np.abs(_scores(calibration, "calibration"))), alpha
    out = []
    for s in np.abs(_scores(scores)):
        q, used, level = aci_step(ordered, level, s, alpha, gamma)
        out.append((q, used))
    widths, levels = np.array(out).T
    return widths, levels


class BoaState:
    """Bernstein online aggregation of experts under pinball loss (Wintenberger, 2017): regrets and learning rates."""

    def __init__(self, experts: int, tau: float, constant: float = 2.2) -> None:
        self.tau, self.constant = tau, constant
        self.regret, self.energy = np.zeros(experts), np.zeros(experts)

    def weights(self) -> np.ndarray:
        w = np.ones(len(self.regret))
        on = self.energy > 0
        if on.any():
            log = self.regret[on] / np.sqrt(self.energy[on]) - 0.5 * np.log(self.energy[on])
            share = np.exp(log - log.max())
            w[on] = on.sum() * share / share.sum()
        return w / w.sum()

    def step(self, offers: np.ndarray, seen: float) -> float:
        """The aggregate of the offers, given before seen is used."""
        given = float(offers @ self.weights())
        loss = (float(seen < given) - self.tau) * (given - offers)
        self.energy += self.constant * loss**2
        on = self.energy > 0
        self.regret[on] += loss[on] - loss[on] ** 2 / np.sqrt(self.energy[on])
        return given


class Bounds(NamedTuple):
    lower: np.ndarray
    upper: np.ndarray


def agaci_bounds(calibration: object, residuals: object, alpha: float = 0.1, gammas: object = None, boa_regret_constant: float = 2.2, infinite_sentinel: float | None = None, require_signed: bool = True) -> Bounds:
    """Aggregated ACI (Zaffran et al., 2022): an ACI expert for each step size, two aggregations for the two ends.

    residuals are signed. Experts that cover everything get a finite width, ten times the widest other or the largest
    residual, so that results scale with the data.
    """
    signed = _scores(residuals, "residuals")
    steps = np.asarray(AGACI_GAMMAS if gammas is None else gammas, float).ravel()
    if not len(steps) or not np.isfinite(steps).all() or (steps < 0).any() or not 0 < alpha < 1 or boa_regret_constant <= 0:
        raise ValueError("gammas must be finite and 0 or more, alpha in (0, 1), boa_regret_constant positive")
    if require_signed and len(signed) >= 8 and (signed >= 0).all():
        raise ValueError("residuals must be signed; none is negative")
    experts = np.column_stack([aci_halfwidths(calibration, signed, alpha, g)[0] for g in steps])
    finite = experts[np.isfinite(experts)]
    scale = max(finite.max(initial=0.0), np.abs(signed).max()) or 1.0
    experts[~np.isfinite(experts)] = min(10 * scale, SENTINEL_CAP) if infinite_sentinel is None else infinite_sentinel
    low, high = BoaState(len(steps), alpha / 2, boa_regret_constant), BoaState(len(steps), 1 - alpha / 2, boa_regret_constant)
    ends = [(-low.step(-e, s), high.step(e, s)) for e, s in zip(experts, signed, strict=True)]
    return Bounds(*np.array(ends).T)


# ---- DataFrames: residuals (series_id, pos, r) ----------------------------------------------------------------------------


def static_frame(residuals: DataFrame, alpha: float = 0.1) -> DataFrame:
    """series_id, width."""
    return residuals.groupBy("series_id").agg(F.percentile(F.abs("r"), F.lit(1 - alpha)).alias("width"))


def sliding_frame(residuals: DataFrame, alpha: float = 0.1, window: int = 50) -> DataFrame:
    """series_id, pos, width."""
    past = Window.partitionBy("series_id").orderBy("pos").rowsBetween(1 - window, 0)
    return residuals.select("series_id", "pos", F.percentile(F.abs("r"), F.lit(1 - alpha)).over(past).alias("width"))


def nexcp_frame(residuals: DataFrame, alpha: float = 0.1, decay: float = 0.99) -> DataFrame:
    """series_id, width."""
    of = Window.partitionBy("series_id")
    w = residuals.withColumn("s", F.abs("r")).withColumn("w", F.pow(F.lit(decay), F.max("pos").over(of) - F.col("pos")))
    w = w.withColumns({"upto": F.sum("w").over(of.orderBy("s", "pos").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("w").over(of)})
    return w.where(F.col("upto") >= (1 - alpha) * F.col("all")).groupBy("series_id").agg(F.min("s").alias("width"))


def aci_frame(calibration: DataFrame, scores: DataFrame, alpha: float = 0.1, gamma: float = 0.05) -> DataFrame:
    """calibration (series_id, r), scores (series_id, pos, r) -> series_id, pos, width, level, by a fold over each series' scores."""

    def step(a: Column, s: Column) -> Column:
        used = F.least(F.greatest(a["level"], F.lit(0.0)), F.lit(1.0))
        h = (1 - used) * (F.size("cs") - 1)
        low = F.floor(h).cast("int")
        x, y = F.get("cs", low), F.get("cs", F.least(low + 1, F.size("cs") - 1))
        q = F.when(used <= 0, float("inf")).when(used >= 1, 0.0).otherwise(x + (y - x) * (h - low))
        new = a["level"] + gamma * (alpha - F.when(s["s"] > q, 1.0).otherwise(0.0))
        return F.struct(new.alias("level"), F.concat(a["out"], F.array(F.struct(s["pos"].alias("pos"), q.alias("width"), used.alias("level")))).alias("out"))

    cs = calibration.groupBy("series_id").agg(F.sort_array(F.collect_list(F.abs("r"))).alias("cs"))
    line = scores.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.abs("r").alias("s")))).alias("line"))
    start = F.struct(F.lit(float(alpha)).alias("level"), F.expr(f"cast(array() as array<struct<pos:{dict(scores.dtypes)['pos']},width:double,level:double>>)").alias("out"))
    return cs.join(line, "series_id").select("series_id", F.explode(F.aggregate("line", start, step, lambda a: a["out"])).alias("e")).select("series_id", "e.*")


def agaci_frame(calibration: DataFrame, residuals: DataFrame, alpha: float = 0.1, spec: AgACI | None = None) -> DataFrame:
    """calibration (series_id, r), residuals (series_id, pos, r signed) -> series_id, pos, lower, upper; a task a series."""
    spec = spec or AgACI()
    id_type, pos_type = dict(residuals.dtypes)["series_id"], dict(residuals.dtypes)["pos"]

    def run(cal: pd.DataFrame, res: pd.DataFrame) -> pd.DataFrame:
        res = res.sort_values("pos")
        if not len(cal) or not len(res):
            return pd.DataFrame({"series_id": [], "pos": [], "lower": [], "upper": []})
        found = agaci_bounds(cal["own_r"], res["r"], alpha, spec.gammas, spec.boa_regret_constant, spec.infinite_sentinel, spec.require_signed)
        return pd.DataFrame({"series_id": res["series_id"], "pos": res["pos"], "lower": found.lower, "upper": found.upper})

    # new names on both sides: they may stem from one DataFrame
    known = calibration.select(F.col("series_id").alias("own_id"), F.col("r").alias("own_r")).groupBy("own_id")
    return known.cogroup(residuals.toDF(*residuals.columns).select("series_id", "pos", "r").groupBy("series_id")).applyInPandas(run, f"series_id {id_type}, pos {pos_type}, lower double, upper double")


# ---- the ensemble ---------------------------------------------------------------------------------------------------------


class LeastSquares:
    """A regressor with fit and predict; anything that has both, and can be copied, will do in its place."""

    def fit(self, X: np.ndarray, y: np.ndarray) -> LeastSquares:
        self.coef = np.linalg.lstsq(np.column_stack([np.ones(len(X)), X]), y, rcond=None)[0]
        return self

    def predict(self, X: np.ndarray) -> np.ndarray:
        return np.column_stack([np.ones(len(X)), X]) @ self.coef


def require_oob(method: MethodSpec) -> None:
    if not isinstance(method, OBSERVATION_METHODS):
        raise OOBUnavailableError("out-of-bag rows need a method that resamples observations", code=Codes.OOB_UNAVAILABLE, method=repr(method))


@dataclass
class Ensemble:
    """oob (series_id, t, y, pred, n_out; pred is null for a row that is in every bag) and members (series_id, b, model pickled)."""

    oob: DataFrame
    members: DataFrame
    exog: int

    def residuals(self) -> DataFrame:
        """series_id, t, pos, r: signed, rows without a prediction left out, pos counted over the rest."""
        rows = self.oob.where("pred is not null").withColumn("r", F.col("y") - F.col("pred"))
        return rows.select("series_id", "t", (F.row_number().over(Window.partitionBy("series_id").orderBy("t")) - 1).alias("pos"), "r")


def _bag(make: Callable[[], object], z: np.ndarray, y: np.ndarray, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Fits a model on each row of idx: by observation, the sum of predictions by models that didn't see it, and their number; the models."""
    total, n_out, models = np.zeros(len(y)), np.zeros(len(y), np.int64), []
    for bag in idx:
        model = copy.deepcopy(make()).fit(z[bag], y[bag])
        out = np.bincount(bag, minlength=len(y)) == 0
        if out.any():
            total[out] += np.asarray(model.predict(z[out]), float).ravel()
            n_out += out
        models.append(cloudpickle.dumps(model))
    return total, n_out, models


def fit_ensemble(rows: DataFrame, method: MethodSpec, n_bootstraps: int = 50, seed: int = 0, make: Callable[[], object] = LeastSquares) -> Ensemble:
    """EnbPI (Xu and Xie, 2021). rows: series_id, slot, t, y double, z array of regressors.

    Each (series, replicate) fits one copy on its bag and predicts the rows outside. Series are packed as columns of
    numbers and shipped once for each chunk of replicates, which are no more than there are cores to fill; a chunk adds up
    its predictions by row, so what is shuffled afterwards is a row an observation and chunk, not one a replicate.
    """
    require_oob(method)
    id_type = dict(rows.dtypes)["series_id"]
    width, few = rows.select(F.max(F.size("z")), F.approx_count_distinct("series_id")).first()
    width = width or 0
    job = make_job(method, n_bootstraps, seed, "counter")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    chunk = max(1, -(-n_bootstraps // max(1, min(n_bootstraps, -(-cores // max(1, few))))))
    line = F.sort_array(F.collect_list(F.struct("t", "y", "z")))
    packed = rows.groupBy("series_id", "slot").agg(line.alias("s")).select("series_id", "slot", F.col("s.t").alias("t"), F.col("s.y").alias("y"), F.flatten("s.z").alias("z"))
    firsts = list(range(0, n_bootstraps, chunk))
    each = packed.select("*", F.explode(F.array(*[F.lit(a) for a in firsts])).alias("first"))
    each = each.repartition("series_id", "first") if len(firsts) > 1 else each
    names = ["series_id", "first", "t", "total", "n_out", "models"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                slot, first = batch.column(1)[i].as_py(), batch.column(5)[i].as_py()
                t, y, z = (batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j in (2, 3, 4))
                z = z.reshape(len(y), width)
                idx = job.indices(job.length(np.column_stack([y, z])), len(y), int(slot), first, min(chunk, n_bootstraps - first))
                total, n_out, models = _bag(make, z, y, idx)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in (pa.array(t), pa.array(total), pa.array(n_out), pa.array(models, pa.binary()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(5).slice(i, 1), *lists], names)

    done = each.mapInArrow(run, f"series_id {id_type}, first int, t array<int>, total array<double>, n_out array<long>, models array<binary>")
    flat = done.select("series_id", F.explode(F.arrays_zip("t", "total", "n_out")).alias("e")).select("series_id", "e.t", "e.total", "e.n_out")
    mean = flat.groupBy("series_id", "t").agg((F.sum("total") / F.nullif(F.sum("n_out"), F.lit(0))).alias("pred"), F.sum("n_out").alias("n_out"))
    oob = rows.select("series_id", "t", "y").join(mean, ["series_id", "t"], "left").select("series_id", "t", "y", "pred", F.coalesce("n_out", F.lit(0)).alias("n_out"))
    members = done.select("series_id", "first", F.posexplode("models").alias("i", "model")).select("series_id", (F.col("first") + F.col("i")).alias("b"), "model")
    return Ensemble(oob, members, width)


def predict(ensemble: Ensemble, new: DataFrame) -> DataFrame:
    """new (series_id, pos, z) -> series_id, pos, point: the mean over all members of the series."""
    id_type, pos_type = dict(new.dtypes)["series_id"], dict(new.dtypes)["pos"]

    def run(members: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(members) or not len(rows):
            return pd.DataFrame({"series_id": [], "pos": [], "point": []})
        z = np.array([list(v) for v in rows["z"]])
        point = np.mean([cloudpickle.loads(m).predict(z) for m in members["model"]], axis=0)  # noqa: S301  (this engine's own)
        return pd.DataFrame({"series_id": rows["series_id"], "pos": rows["pos"], "point": point})

    return ensemble.members.groupBy("series_id").cogroup(new.select("series_id", "pos", "z").groupBy("series_id")).applyInPandas(run, f"series_id {id_type}, pos {pos_type}, point double")


_CALIBRATORS: dict[type, Callable[[DataFrame, float, CalibratorSpec], DataFrame]] = {}


def register_calibrator(kind: type, plan: Callable[[DataFrame, float, CalibratorSpec], DataFrame]) -> None:
    """plan: residuals (series_id, pos, r), alpha, spec -> series_id, pos, lower, upper (offsets from the point)."""
    _CALIBRATORS[kind] = plan


def calibrate(residuals: DataFrame, alpha: float, spec: CalibratorSpec) -> DataFrame:
    if type(spec) not in _CALIBRATORS:
        raise MethodConfigError(f"no calibrator for {spec!r}", code=Codes.INVALID_PARAMETER)
    return _CALIBRATORS[type(spec)](residuals, alpha, spec)


def _everywhere(residuals: DataFrame, widths: DataFrame) -> DataFrame:
    return residuals.select("series_id", "pos").join(widths, "series_id").select("series_id", "pos", F.col("width").alias("lower"), F.col("width").alias("upper"))


def _both(widths: DataFrame) -> DataFrame:
    return widths.select("series_id", "pos", F.col("width").alias("lower"), F.col("width").alias("upper"))


register_calibrator(Static, lambda r, a, s: _everywhere(r, static_frame(r, a)))
register_calibrator(SlidingWindow, lambda r, a, s: _both(sliding_frame(r, a, s.window or 50)))
register_calibrator(NexCP, lambda r, a, s: _everywhere(r, nexcp_frame(r, a, s.decay)))
register_calibrator(ACI, lambda r, a, s: _both(aci_frame(r, r, a, s.gamma)))
register_calibrator(AgACI, lambda r, a, s: agaci_frame(r, r, a, s))


def intervals(ensemble: Ensemble, alpha: float = 0.1, calibrator: CalibratorSpec | None = None) -> DataFrame:
    """series_id, t, lower, upper, point of the rows that the ensemble was fitted on."""
    r = ensemble.residuals()
    widths = calibrate(r, alpha, calibrator or Static())
    met = r.join(widths, ["series_id", "pos"]).join(ensemble.oob.select("series_id", "t", "pred"), ["series_id", "t"])
    return met.select("series_id", "t", (F.col("pred") - F.col("lower")).alias("lower"), (F.col("pred") + F.col("upper")).alias("upper"), F.col("pred").alias("point"))
