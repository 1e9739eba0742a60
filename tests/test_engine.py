import warnings

import numpy as np
import pytest

import tidemark as tm
from tidemark.operators import blocklength, models, resample
from tidemark.operators.engine import make_job, statistics_of
from tidemark.operators.reduce import statistic_of

RNG = np.random.default_rng(5)
X = np.cumsum(RNG.normal(size=60)) * 0.3 + RNG.normal(size=60)


def ar1(phi, n, seed=0):
    e = np.random.default_rng(seed).normal(size=n)
    for t in range(1, n):
        e[t] += phi * e[t - 1]
    return e


@pytest.mark.parametrize("method", [tm.MovingBlock(7), tm.CircularBlock(7), tm.NonOverlappingBlock(7), tm.MovingBlock(60), tm.CircularBlock(60)], ids=str)
def test_means_by_blocks_are_means(method):
    job = make_job(method, 20, 3, "counter")
    got = statistics_of(job, statistic_of("mean"), X[:, None], 4, 0, 20)[:, 0]
    idx = resample.counter_indices(method, resample.block_length(method, 60, warn=False), 60, 3, 4, 0, 20)
    np.testing.assert_allclose(got, X[idx].mean(axis=1), atol=1e-12)


def test_statistics_of_all_kinds(spark):
    values = tm.bootstrap(X, method=tm.StationaryBlock(4), n_bootstraps=7, random_state=1).values()
    run = lambda s, **k: tm.bootstrap_reduce(X, method=tm.StationaryBlock(4), statistic=s, n_bootstraps=7, random_state=1, **k).statistics
    np.testing.assert_allclose(run("mean"), values.mean(axis=1))
    np.testing.assert_allclose(run("var"), values.var(axis=1))
    np.testing.assert_allclose(run("std"), values.std(axis=1))
    np.testing.assert_allclose(run(("quantile", 0.3)), np.quantile(values, 0.3, axis=1))
    np.testing.assert_allclose(run(lambda v, i: [v.max(), i.min()])[:, 0], values.max(axis=1))
    np.testing.assert_allclose(run(lambda v, i: v.max(axis=1), vectorized=True), values.max(axis=1))
    for bad in ("nope", ("quantile", 2), 3):
        with pytest.raises(tm.MethodConfigError):
            run(bad)


def test_iter_gives_the_same_replicates(spark):
    whole = tm.bootstrap(X, method=tm.MovingBlock(5), n_bootstraps=10, random_state=2)
    parts = list(tm.bootstrap_iter(X, method=tm.MovingBlock(5), n_bootstraps=10, random_state=2, chunk=4))
    assert (np.concatenate([v for v, _ in parts]) == whole.values()).all()
    assert (np.concatenate([i for _, i in parts]) == whole.indices()).all()


def test_panel_forms_agree(spark):
    series = [X[:10], X[10:31], X[31:]]
    run = lambda *a, **k: tm.bootstrap_reduce_panel(*a, method=tm.MovingBlock(4), statistic="mean", n_bootstraps=5, random_state=3, **k).long().orderBy("series_id", "b").toPandas()
    a, b = run(series), run(X, indptr=[0, 10, 31, 60])
    assert (a.theta == b.theta).all() and len(a) == 15
    for bad in ([0, 5], [1, 60], [0, 30, 30, 60]):
        with pytest.raises(tm.InputDataError):
            run(X, indptr=bad)


def test_multivariate_rows_stay_whole(spark):
    xy = np.column_stack([X, 2 * X + 1])
    v = tm.bootstrap(xy, method=tm.CircularBlock(6), n_bootstraps=4, random_state=0).values()
    assert v.shape == (4, 60, 2)
    np.testing.assert_allclose(v[:, :, 1], 2 * v[:, :, 0] + 1)


def test_inbag_and_out_of_bag(spark):
    out = tm.bootstrap(X, method=tm.IID(), n_bootstraps=3, random_state=0)
    counts = out.inbag_counts().toPandas()
    assert (counts.groupby("b").n_inbag.sum() == 60).all() and len(counts) == 180
    assert out.out_of_bag().count() == (counts.n_inbag == 0).sum()
    with pytest.raises(tm.OOBUnavailableError):
        tm.bootstrap(X, method=tm.SieveAR(max_lag=2), n_bootstraps=2, random_state=0).inbag_counts()


@pytest.mark.parametrize("bad", [[1.0, np.nan, 2.0], [1.0, 2.0], np.zeros((2, 2, 2)), ["a", "b", "c"]])
def test_bad_input(spark, bad):
    with pytest.raises(tm.InputDataError):
        tm.bootstrap(bad, method=tm.IID(), n_bootstraps=2)


def test_bad_series_frames(spark):
    df = spark.createDataFrame([(1, 1, 1.0, "a"), (1, 2, None, "b"), (1, 3, 2.0, "c")], "k int, o int, v double, s string")
    with pytest.raises(tm.InputDataError) as e:
        tm.from_frame(df, "v", order="o", series="k")
    assert e.value.code == tm.Codes.NONFINITE_INPUT
    for column in ("s", "missing"):
        with pytest.raises(tm.InputDataError):
            tm.from_frame(df, column, order="o")
    with pytest.raises(tm.InputDataError):
        tm.from_frame(df.where("o < 2"), "v", order="o")


@pytest.mark.parametrize("make", [lambda: tm.MovingBlock(0), lambda: tm.MovingBlock(True), lambda: tm.TaperedBlock(3, window="x"), lambda: tm.TaperedBlock(3, alpha=0), lambda: tm.AR(order=0), lambda: tm.ARIMA(order=(0, 1, 0)), lambda: tm.Wild("x"), lambda: tm.SieveAR(min_lag=3, max_lag=2), lambda: tm.SieveAR(criterion="x"), lambda: tm.NexCP(0), lambda: tm.ACI(-1), lambda: tm.SlidingWindow(0)])
def test_bad_specs(make):
    with pytest.raises(tm.MethodConfigError):
        make()


def test_bad_combinations(spark):
    run = lambda x, m, **k: tm.bootstrap(x, method=m, n_bootstraps=2, random_state=0, **k)
    cases = [
        (X, tm.Wild(), {}), (X, tm.ResidualBootstrap(tm.VAR()), {}), (np.column_stack([X, X]), tm.ResidualBootstrap(tm.AR()), {}),
        (X, tm.ResidualBootstrap(tm.AR(burn_in=3), tm.Wild()), {}), (X, tm.ResidualBootstrap(tm.AR(), tm.MovingBlock(3)), {}),
        (X, tm.SieveAR(), {"exog": X}), (X, tm.IID(), {"exog": X}), (X, tm.IID(), {"dtype": "int"}), (X, tm.IID(), {"stream": "x"}),
    ]
    for x, m, k in cases:
        with pytest.raises(tm.MethodConfigError):
            run(x, m, **k)
    with pytest.raises(tm.InputDataError):
        run(X, tm.ResidualBootstrap(tm.AR()), exog=X[:5])


def test_block_longer_than_series_warns(spark):
    with pytest.warns(tm.DegenerateBlockBootstrapWarning):
        tm.bootstrap(X[:5], method=tm.MovingBlock(5), n_bootstraps=1, random_state=0)


def test_unstable_models(spark):
    x = 1.2 ** np.arange(40.0) + np.random.default_rng(0).normal(size=40) * 0.01
    with pytest.raises(Exception, match="unstable"):
        tm.bootstrap(x, method=tm.ResidualBootstrap(tm.AR()), n_bootstraps=2, random_state=0).values()
    out = tm.bootstrap(x, method=tm.ResidualBootstrap(tm.AR(stability_policy="skip")), n_bootstraps=2, random_state=0)
    assert [r["status"] for r in out.failed.collect()] == [tm.Codes.UNSTABLE_MODEL]
    assert tm.bootstrap_reduce(x, method=tm.ResidualBootstrap(tm.AR(stability_policy="skip")), statistic="mean", n_bootstraps=2, random_state=0).statistics is None
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        models.check_stability(np.array([0.99]))
    assert seen[0].category is tm.NearUnitRootWarning


def test_wild_weights_keep_residuals_in_place():
    x = ar1(0.5, 50)
    for kind, values in (("rademacher", {1.0}), ("mammen", {abs(models.MAMMEN_LOW), models.MAMMEN_HIGH})):
        ctx = models.prepare(x[:, None], tm.ResidualBootstrap(tm.AR(), tm.Wild(kind)))
        e, first = models.draw(ctx, np.random.default_rng(0))
        assert {round(v, 9) for v in np.abs(e / ctx.innovations)} <= {round(v, 9) for v in values}
        assert (first == x[:1]).all()
    ctx = models.prepare(x[:, None], tm.ResidualBootstrap(tm.AR(), tm.BlockWild("rademacher", 7)))
    sign = np.sign(models.draw(ctx, np.random.default_rng(0))[0] / ctx.innovations)
    assert all(len(set(sign[i : i + 7])) == 1 for i in range(0, 49, 7))


def test_paths_of_the_own_residuals_are_the_series():
    x = ar1(0.5, 60)
    ctx = models.prepare(x[:, None], tm.ResidualBootstrap(tm.AR(order=2)))
    np.testing.assert_allclose(models.paths(ctx, ctx.fit.residuals[None], x[None, :2])[0, :, 0], x, atol=1e-9)
    y = np.cumsum(x)
    ctx = models.prepare(y[:, None], tm.ResidualBootstrap(tm.ARIMA(order=(1, 1, 1))))
    np.testing.assert_allclose(models.paths(ctx, ctx.fit.residuals[None, 1:], ctx.fit.first[None])[0, :, 0], y, atol=1e-8)
    xy = np.column_stack([x, ar1(0.3, 60, 4)])
    ctx = models.prepare(xy, tm.ResidualBootstrap(tm.VAR(order=2)))
    np.testing.assert_allclose(models.paths(ctx, ctx.fit.residuals[None], xy[None, :2])[0], xy, atol=1e-9)


def test_fits_find_what_made_the_series():
    assert abs(models.fit_ar(ar1(0.7, 4000), 1).lags[0] - 0.7) < 0.05
    e = np.random.default_rng(1).normal(size=1500)
    w = np.convolve(e, [1, 0.5])[:1500]
    fit = models.fit_arma(w, 0, 1)
    assert abs(fit.theta[0] - 0.5) < 0.07
    assert models.select_order(ar1(0.7, 800), 1, 6) == 1
    with pytest.raises(tm.InputDataError):
        models.fit_ar(np.ones(20), 1)
    with pytest.raises(tm.MethodConfigError):
        models.fit_ar(np.ones(3), 5)


def test_block_length_rule(spark):
    x = ar1(0.8, 500)
    sb, cb = blocklength.plug_in(x)
    assert 5 < sb < 60 and cb > sb  # the circular rule's constant is smaller
    assert blocklength.plug_in(np.ones(30)) == (1.0, 1.0)
    frame = blocklength.block_lengths(tm.from_arrays([x[:, None]], spark).scalar().select("series_id", "t", "v")).first()
    np.testing.assert_allclose((frame["b_stationary"], frame["b_circular"]), (sb, cb), rtol=1e-9)


def test_intervals(spark):
    low, high, point = tm.conf_int(X, "mean", method=tm.MovingBlock(5), n_bootstraps=199, random_state=1)
    assert low < point < high
    for kind, method in (("basic", tm.MovingBlock(5)), ("studentized", tm.MovingBlock(5)), ("bca", tm.IID())):
        low, high, point = tm.conf_int(X, "mean", method=method, kind=kind, n_bootstraps=199, random_state=1)
        assert low < point < high
    with pytest.raises(tm.MethodConfigError):
        tm.conf_int(X, "mean", method=tm.MovingBlock(5), kind="bca")
    with pytest.raises(tm.MethodConfigError):
        tm.conf_int(X, "mean", method=tm.IID(), alpha=1.5)
    with pytest.raises(ValueError):
        tm.studentized_interval(np.zeros(3), np.zeros(3), 0.0, 1.0)
    with pytest.raises(ValueError):
        tm.bca_interval(np.ones(5), np.array(0.0), np.array(0.0))
    assert tm.block_jackknife_se(np.arange(10.0), np.mean, 1) == pytest.approx(np.std(np.arange(10.0), ddof=1) / np.sqrt(10))


def test_panel_bca_is_the_same_as_arrays(spark):
    series = tm.from_arrays([X[:, None]], spark, was_1d=True)
    row = tm.conf_int_panel(series, "mean", method=tm.IID(), kind="bca", n_bootstraps=99, seed=4).first()
    low, high, point = tm.conf_int(X, "mean", method=tm.IID(), kind="bca", n_bootstraps=99, random_state=4, stream="counter")
    np.testing.assert_allclose((row["lower"], row["upper"], row["point"]), (low, high, point))


def test_forecast():
    x = ar1(0.6, 300)
    low, high, mid = tm.forecast_intervals(x, model=tm.AR(), horizon=5, n_bootstraps=400, random_state=0)
    assert (low < mid).all() and (mid < high).all() and high[4] - low[4] > high[0] - low[0]


def test_registered_method(spark):
    from dataclasses import dataclass

    @dataclass(frozen=True)
    class Flip(tm.MethodSpec):
        kind = "flip"

    with pytest.raises(tm.MethodConfigError):
        tm.bootstrap_reduce(X, method=Flip(), statistic="mean", n_bootstraps=2, random_state=0)
    record = tm.MethodMetadata("flip", (), True, False, False, False, False, (), "O(n)", ())
    tm.register_method(Flip, record, lambda spec, x, slot, first, count: np.repeat(-x[None], count, axis=0))
    np.testing.assert_allclose(tm.bootstrap_reduce(X, method=Flip(), statistic="mean", n_bootstraps=2, random_state=0).statistics, -X.mean())

    @dataclass(frozen=True)
    class Shift(tm.MethodSpec):
        kind = "shift"

    def reduce(spec, mean, slot, first, count, statistic):
        return np.full((count, 1), mean + 100) if statistic.name == "mean" else None

    tm.register_method(Shift, record, lambda spec, mean, slot, first, count: np.full((count, 60, 1), mean) + np.arange(first, first + count)[:, None, None], prepare=lambda spec, x, slot: x.mean(), reduce=reduce)
    run = lambda s: tm.bootstrap_reduce(X, method=Shift(), statistic=s, n_bootstraps=3, random_state=0).statistics
    np.testing.assert_allclose(run("median"), X.mean() + np.arange(3))
    np.testing.assert_allclose(run("mean"), X.mean() + 100)


def test_metadata(spark):
    run = tm.bootstrap(X, method=tm.MovingBlock(5), n_bootstraps=2, random_state=9)
    row = run.metadata.frame(spark).first()
    assert row["method"] == "moving_block" and row["params"]["block_length"] == "5" and row["seed_entropy"] == "9"
    assert tm.metadata_for(tm.SieveAR).supports_oob is False
    with pytest.raises(tm.MethodConfigError):
        tm.metadata_for(tm.Wild())


RECURSIVE = [tm.ResidualBootstrap(tm.AR(order=2)), tm.ResidualBootstrap(tm.AR(burn_in=5, initial="random_block")), tm.ResidualBootstrap(tm.AR(), tm.Wild("gaussian")), tm.SieveAR(max_lag=3), tm.ResidualBootstrap(tm.ARIMA(order=(1, 1, 0)))]


@pytest.mark.parametrize("method", RECURSIVE, ids=repr)
def test_counter_stream_of_models(spark, method):
    run = lambda **k: tm.bootstrap(X, method=method, n_bootstraps=9, random_state=3, stream="counter", **k)
    out = run()
    assert out.metadata.stream == "counter"
    values = out.values()
    assert values.shape == (9, 60) and len(np.unique(values[:, -1])) > 1
    job = make_job(method, 9, 3, "counter")
    for name in ("mean", "var", "std"):  # moments come step by step, without the paths
        got = statistics_of(job, statistic_of(name), X[:, None], 0, 0, 9)[:, 0]
        np.testing.assert_allclose(got, getattr(np, name)(values, axis=1), rtol=1e-9)
    later = statistics_of(job, statistic_of("mean"), X[:, None], 0, 4, 3)[:, 0]  # replicates don't depend on how they are dealt
    np.testing.assert_allclose(later, values[4:7].mean(axis=1), rtol=1e-9)


def test_counter_weights():
    for kind in ("rademacher", "gaussian", "mammen"):
        w = models.counter_weights(kind, 1, 2, 0, 50, 400)
        assert abs(w.mean()) < 0.03 and abs(w.var() - 1) < 0.05
    assert set(np.unique(models.counter_weights("rademacher", 1, 2, 0, 4, 50))) == {-1.0, 1.0}


@pytest.mark.parametrize("window", ["bartlett", "blackman", "hamming", "hann", "tukey"])
@pytest.mark.parametrize("length", [1, 2, 65, 100, "auto"])
def test_tapered_frame_is_the_kernels(spark, window, length):
    series = tm.from_arrays([X[:50, None], np.tile(X, 2)[:90, None]], spark, was_1d=True)
    method = tm.TaperedBlock(length, window=window)
    a = tm.bootstrap_frame(series, method, 3, 5).orderBy("series_id", "b", "t").toPandas()
    b = tm.bootstrap(series, method=method, n_bootstraps=3, random_state=5, stream="counter").frame.orderBy("series_id", "b", "t").toPandas()
    np.testing.assert_allclose([x[0] for x in a.x], [x[0] for x in b.x], atol=1e-12)


def test_panel_intervals_of_several_columns(spark):
    xy = np.column_stack([X, X[::-1] * 2 + 1])
    series = tm.from_arrays([xy[:40], xy], spark)
    for kind, method, statistic in (("percentile", tm.MovingBlock(5), "mean"), ("basic", tm.CircularBlock(5), "median"), ("studentized", tm.MovingBlock(5), "mean"), ("bca", tm.IID(), "mean"), ("bca", tm.IID(), "std"), ("studentized", tm.IID(), "std"), ("percentile", tm.IID(), lambda v, i: v.max(axis=0) - v.min(axis=0))):
        got = tm.conf_int_panel(series, statistic, method=method, kind=kind, n_bootstraps=60, seed=4).orderBy("series_id", "dim").toPandas()
        assert got[["series_id", "dim"]].to_numpy().tolist() == [[0, 0], [0, 1], [1, 0], [1, 1]]
        for k, n in enumerate((40, 60)):
            if kind != "percentile" or isinstance(statistic, str):
                assert (got.lower < got.point).all() and (got.point < got.upper).all()
            one = tm.from_arrays([xy[:n]], spark)
            one = tm.SeriesFrame(one.rows.selectExpr(f"{k}L as series_id", f"{k}L as slot", "t", "x"), 2, False)
            again = tm.conf_int_panel(one, statistic, method=method, kind=kind, n_bootstraps=60, seed=4).orderBy("dim").toPandas()
            np.testing.assert_allclose(got[got.series_id == k][["lower", "upper", "point"]], again[["lower", "upper", "point"]])


def test_panel_studentized_is_the_arrays(spark):
    for statistic, more in (("mean", {}), ("median", {}), ("mean", {"se_block_length": 6}), ("std", {"se_statistic": lambda v, i: v.std() / 7})):
        row = tm.conf_int_panel([X], statistic, method=tm.MovingBlock(5), kind="studentized", n_bootstraps=40, seed=4, **more).first()
        low, high, point = tm.conf_int(X, statistic, method=tm.MovingBlock(5), kind="studentized", n_bootstraps=40, random_state=4, stream="counter", **more)
        np.testing.assert_allclose((row["lower"], row["upper"], row["point"]), (low, high, point))
    with pytest.raises(tm.MethodConfigError):
        tm.conf_int_panel([X], "mean", method=tm.MovingBlock(), kind="studentized")


def test_panels_are_no_single_series(spark):
    for bad in ([X, X], X.tolist(), np.zeros((2, 5, 2))):
        with pytest.raises(tm.MethodConfigError):
            tm.conf_int(bad, "mean", method=tm.IID())
    with pytest.raises(tm.MethodConfigError):
        list(tm.bootstrap_iter(tm.from_arrays([X[:, None], X[:, None]], spark), method=tm.IID()))


def test_counts_are_those_of_the_indices(spark):
    for stream in ("seedseq", "counter"):
        out = tm.bootstrap(X, method=tm.StationaryBlock(4), n_bootstraps=3, random_state=0, stream=stream)
        got = out.inbag_counts().orderBy("b", "t").toPandas().n_inbag.to_numpy().reshape(3, 60)
        assert (got == [np.bincount(i, minlength=60) for i in out.indices()]).all()
        frame = resample.inbag_counts(out.frame.select("series_id", "b", "t", "idx")).orderBy("b", "t").toPandas().n_inbag.to_numpy()
        assert (got.ravel() == frame).all()
