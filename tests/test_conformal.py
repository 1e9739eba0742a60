import numpy as np
import pandas as pd
import pytest

import tidemark as tm
from tidemark.operators import conformal

R = np.random.default_rng(2).normal(size=120)


def frame(spark, r, first=0):
    return spark.createDataFrame(pd.DataFrame({"series_id": 1, "pos": np.arange(first, first + len(r)), "r": r}))


def test_frames_give_the_arrays_widths(spark):
    df = frame(spark, R)
    assert conformal.static_frame(df, 0.1).first()["width"] == pytest.approx(tm.static_halfwidths(R, 0.1)[0])
    assert conformal.nexcp_frame(df, 0.1, 0.95).first()["width"] == pytest.approx(tm.nexcp_quantile(R, 0.1, 0.95))
    got = conformal.sliding_frame(df, 0.1, 20).orderBy("pos").toPandas().width
    np.testing.assert_allclose(got, tm.sliding_window_halfwidths(R, 0.1, 20))
    widths, levels = tm.aci_halfwidths(R[:40], R[40:], 0.1, 0.05)
    got = conformal.aci_frame(frame(spark, R[:40]), frame(spark, R[40:]), 0.1, 0.05).orderBy("pos").toPandas()
    np.testing.assert_allclose(got.width, widths)
    np.testing.assert_allclose(got.level, levels)


def test_aci_adapts():
    widths, levels = tm.aci_halfwidths(R, np.full(200, 1e9), 0.1, 0.05)
    assert np.isinf(widths).any() and levels.min() == 0
    widths, _ = tm.aci_halfwidths(R, np.zeros(4000), 0.1, 0.05)
    assert widths.min() == 0
    fixed, _ = tm.aci_halfwidths(R, R, 0.1, 0.0)
    assert (fixed == fixed[0]).all()


def test_agaci():
    out = tm.agaci_bounds(np.abs(R), R, 0.1)
    assert (out.lower >= 0).all() and (out.upper >= 0).all() and np.isfinite(out.upper).all()
    scaled = tm.agaci_bounds(np.abs(R) * 1e3, R * 1e3, 0.1)
    np.testing.assert_allclose(scaled.upper, out.upper * 1e3, rtol=1e-6)
    with pytest.raises(ValueError):
        tm.agaci_bounds(np.abs(R), np.abs(R))
    boa = conformal.BoaState(3, 0.9)
    assert boa.step(np.array([1.0, 2.0, 6.0]), 0.0) == pytest.approx(3.0)  # at first, all weigh the same
    assert boa.weights().sum() == pytest.approx(1)


@pytest.mark.parametrize("spec", [tm.Static(), tm.SlidingWindow(15), tm.NexCP(), tm.ACI(), tm.AgACI(gammas=(0.0, 0.05))], ids=lambda s: type(s).__name__)
def test_ensemble_covers(spark, spec):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(150, 2))
    y = 1 + z @ [2.0, -1.0] + rng.normal(size=150) * 0.3
    rows = spark.createDataFrame(pd.DataFrame({"series_id": 0, "slot": 0, "t": np.arange(150, dtype=np.int32), "y": y, "z": z.tolist()}), "series_id long, slot long, t int, y double, z array<double>")
    ensemble = tm.fit_ensemble(rows, tm.MovingBlock(5), 12, 3)
    oob = ensemble.oob.toPandas()
    assert len(oob) == 150 and (oob.n_out > 0).mean() > 0.9
    met = tm.intervals(ensemble, 0.1, spec).toPandas().merge(oob, on="t")
    assert 0.7 < ((met.lower <= met.y) & (met.y <= met.upper)).mean() <= 1
    new = spark.createDataFrame([(0, 0, [1.0, 1.0])], "series_id long, pos int, z array<double>")
    assert conformal.predict(ensemble, new).first()["point"] == pytest.approx(2.0, abs=0.3)


def test_ensemble_needs_indices(spark):
    with pytest.raises(tm.OOBUnavailableError):
        conformal.require_oob(tm.SieveAR())
    with pytest.raises(tm.MethodConfigError):
        conformal.calibrate(None, 0.1, tm.CalibratorSpec())


def test_arrays(spark):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(80, 1))
    y = 2 * z[:, 0] + rng.normal(size=80) * 0.2
    model = tm.EnbPI().fit(conformal.LeastSquares(), z, y, method=tm.IID(), n_bootstraps=15, random_state=1)
    for spec in (tm.Static(), tm.SlidingWindow(10), tm.NexCP(), tm.ACI(), tm.AgACI(gammas=(0.0, 0.1))):
        known = np.isfinite(model.oob_prediction).all()
        if known or not isinstance(spec, (tm.ACI, tm.AgACI)):
            low, high, point = model.predict_interval(calibrator=spec)
            assert low.shape == high.shape == point.shape == (80,)
        low, high, point = model.predict_interval(z[:20], calibrator=spec, test_data=y[:20])
        assert (low <= high).all() and abs(point - 2 * z[:20, 0]).max() < 0.3
    with pytest.raises(tm.MethodConfigError):
        model.predict_interval(z[:5], calibrator=tm.ACI())
    assert np.isfinite(tm.fit_predict_oob(conformal.LeastSquares(), z, y, method=tm.MovingBlock(4), n_bootstraps=15, random_state=1)).mean() > 0.9
    with pytest.raises(tm.InputDataError):
        tm.enbpi_intervals(conformal.LeastSquares(), z, y[:9], method=tm.IID(), n_bootstraps=3, random_state=0)
