"""The out-of-bag ensemble for arrays: one series, results on the driver; the work is that of conformal.py."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from ..errors import Codes, InputDataError, MethodConfigError
from ..sources.series import active_session, to_matrix
from ..specs import ACI, AgACI, CalibratorSpec, MethodSpec, NexCP, SlidingWindow, Static
from . import conformal
from .resample import seed64


def _rows(z: np.ndarray, **more: np.ndarray) -> pa.Table:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1]), pa.array(z.ravel()))
    return pa.table({"series_id": np.zeros(len(z), np.int64), **more, "z": lists})


class EnbPI:
    """fit(estimator, X, y, method=...), then predict_interval(); estimator: anything with fit and predict that can be copied."""

    def fit(self, estimator: object, X: object, y: object, *, method: MethodSpec, n_bootstraps: int = 100, random_state: object = None) -> EnbPI:
        z, _ = to_matrix(X)
        target = to_matrix(y, "y")[0][:, 0]
        if len(target) != len(z):
            raise InputDataError("X and y must have as many rows", code=Codes.INVALID_SHAPE, rows=len(z), targets=len(target))
        spark = active_session()
        n = len(z)
        frame = spark.createDataFrame(_rows(z, slot=np.zeros(n, np.int64), t=np.arange(n, dtype=np.int32), y=target))
        self.ensemble = conformal.fit_ensemble(frame, method, n_bootstraps, seed64(random_state), lambda: estimator)
        self.ensemble.members = self.ensemble.members.persist()
        oob = self.ensemble.oob.orderBy("t").toPandas()
        self.oob_prediction = oob["pred"].to_numpy(float, na_value=np.nan)
        self.signed = (target - self.oob_prediction)[np.isfinite(self.oob_prediction)]
        if not len(self.signed):
            raise MethodConfigError("no row was ever out of bag", code=Codes.OOB_UNAVAILABLE)
        self.oob_residuals = np.abs(self.signed)
        return self

    def predict_interval(self, X_new: object = None, *, alpha: float = 0.1, calibrator: CalibratorSpec | None = None, test_data: object = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lower, upper, point): of the rows fitted on, or of X_new; ACI and AgACI need the new targets, as test_data, for new rows."""
        spec = calibrator or Static()
        if X_new is None:
            point, signed = self.oob_prediction, self.signed
        else:
            z, _ = to_matrix(X_new, "X_new", 1)
            new = active_session().createDataFrame(_rows(z, pos=np.arange(len(z))))
            point = conformal.predict(self.ensemble, new).orderBy("pos").toPandas()["point"].to_numpy(float)
            signed = None if test_data is None else np.asarray(test_data, float).ravel() - point
        if isinstance(spec, (ACI, AgACI)) and (signed is None or len(signed) != len(point)):
            raise MethodConfigError("this calibrator needs a realised target for each row", code=Codes.INVALID_PARAMETER)
        if isinstance(spec, SlidingWindow):
            upper = conformal.sliding_window_halfwidths(self.oob_residuals, alpha, spec.window, len(self.oob_residuals) + len(point))
            upper = upper[: len(point)] if X_new is None else upper[len(self.oob_residuals) :]
            lower = upper
        elif isinstance(spec, NexCP):
            lower = upper = np.full(len(point), conformal.nexcp_quantile(self.oob_residuals, alpha, spec.decay))
        elif isinstance(spec, ACI):
            lower = upper = conformal.aci_halfwidths(self.oob_residuals, signed, alpha, spec.gamma)[0]
        elif isinstance(spec, AgACI):
            lower, upper = conformal.agaci_bounds(self.oob_residuals, signed, alpha, spec.gammas, spec.boa_regret_constant, spec.infinite_sentinel, spec.require_signed)
        else:
            lower = upper = conformal.static_halfwidths(self.oob_residuals, alpha, len(point))
        return point - lower, point + upper, point


def fit_predict_oob(estimator: object, X: object, y: object, *, method: MethodSpec, n_bootstraps: int = 100, random_state: object = None) -> np.ndarray:
    """Out-of-bag predictions; NaN for a row that is in every bag."""
    return EnbPI().fit(estimator, X, y, method=method, n_bootstraps=n_bootstraps, random_state=random_state).oob_prediction


def enbpi_intervals(estimator: object, X: object, y: object, *, method: MethodSpec, alpha: float = 0.1, n_bootstraps: int = 100, random_state: object = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, point) of the rows fitted on, with one width."""
    return EnbPI().fit(estimator, X, y, method=method, n_bootstraps=n_bootstraps, random_state=random_state).predict_interval(alpha=alpha)
