"""Values that any faithful implementation of the default stream must give; fixed values, from published pins."""

import numpy as np
import pytest

import tidemark as tm


def driven(shocks, move):
    """x[t] = move x[t-1] + shocks[t], from rest; move: a number or a matrix."""
    state, out = np.zeros(np.shape(shocks)[1:]), []
    for shock in shocks:
        state = np.dot(move, state) + shock
        out.append(state)
    return np.array(out)


def normals(seed, *shape):
    return np.random.default_rng(seed).standard_normal(shape)


def after_rest(rows):
    return np.vstack([np.zeros(rows.shape[1]), rows])


X = driven(normals(0, 40), 0.6)
INDEX_PINS = {
    "iid": (tm.IID(), [19, 36, 23, 36, 8, 35, 13, 12], [0.7791226231137061, -0.34283569625763266]),
    "moving": (tm.MovingBlock(5), [17, 18, 19, 20, 21, 33, 34, 35], [-1.4176918559818088, -0.43898457721495243]),
    "circular": (tm.CircularBlock(5), [19, 20, 21, 22, 23, 36, 37, 38], [0.7791226231137061, 0.3389389109241894]),
    "nonoverlap": (tm.NonOverlappingBlock(5), [15, 16, 17, 18, 19, 35, 36, 37], [-2.1523230830507454, -1.835652832687757]),
    "stationary": (tm.StationaryBlock(5), [39, 0, 1, 2, 3, 24, 25, 26], [1.8431030087365128, 0.1257302210933933]),
    "tapered": (tm.TaperedBlock(5), [17, 18, 19, 20, 21, 33, 34, 35], [-0.2202271111201936, -0.4199244424581452]),
}


@pytest.mark.parametrize("name", INDEX_PINS)
def test_observation_methods(spark, name):
    method, idx, values = INDEX_PINS[name]
    out = tm.bootstrap(X, method=method, n_bootstraps=3, random_state=42)
    assert out.indices()[0, :8].tolist() == idx
    np.testing.assert_allclose(out.values()[0, :2], values, atol=1e-12)
    assert out.values().shape == (3, 40)


AR_PATH = [0.1257302210933933, -0.15659536806713267, -0.854694195731939, -0.34052207734260864, -0.9941846290247891]


@pytest.mark.parametrize("method", [tm.ResidualBootstrap(tm.AR()), tm.SieveAR(min_lag=1, max_lag=3)], ids=["ar", "sieve"])
def test_ar_and_sieve(spark, method):
    out = tm.bootstrap(X, method=method, n_bootstraps=3, random_state=42)
    np.testing.assert_allclose(out.values()[0, :5], AR_PATH, atol=1e-12)
    assert out.indices() is None


def test_arima(spark):
    y = np.cumsum(driven(normals(1, 41), 0.5))[:40]
    out = tm.bootstrap(y, method=tm.ResidualBootstrap(tm.ARIMA(order=(1, 1, 1))), n_bootstraps=3, random_state=42)
    # the first two are exact; the others depend on an optimiser
    np.testing.assert_allclose(out.values()[0, :5], [0.345584192064786, 1.3399944315983374, 1.6322306432743918, 0.9870484878739917, 1.5632683881209846], atol=1e-3)


def test_var(spark):
    x = driven(after_rest(normals(0, 39, 2)), [[0.5, 0.1], [0.2, 0.4]])
    out = tm.bootstrap(x, method=tm.ResidualBootstrap(tm.VAR()), n_bootstraps=3, random_state=42)
    np.testing.assert_allclose(out.values()[0, :3], [[0.0, 0.0], [0.8857745892917128, 1.4468454831411872], [0.5916210188810951, 1.4351448872853465]], atol=1e-12)


def test_arx(spark):
    drawn = normals(0, 80)
    exog, shocks = drawn[:40, None], drawn[40:]
    x = driven(shocks + np.append(0, 2 * exog[1:, 0]), 0.5)
    out = tm.bootstrap(x, method=tm.ResidualBootstrap(tm.AR()), n_bootstraps=3, random_state=42, exog=exog)
    np.testing.assert_allclose(out.values()[0, :5], [-1.2590655321041202, -1.5971947009652947, -0.6212029906974876, -0.7766418885767343, -2.3083991888676922], atol=1e-12)


def test_varx(spark):
    drawn = normals(0, 118)
    exog, shocks = drawn[:40, None], drawn[40:].reshape(39, 2)
    x = driven(after_rest(shocks + exog[1:] * [1.2, -1.5]), [[0.4, 0.1], [0.05, 0.3]])
    out = tm.bootstrap(x, method=tm.ResidualBootstrap(tm.VAR()), n_bootstraps=3, random_state=42, exog=exog)
    np.testing.assert_allclose(out.values()[0, :3], [[0.0, 0.0], [-0.00015381519504510666, 2.009840764531376], [0.7751689164856954, -0.7901138586477876]], atol=1e-12)


def test_float32_is_a_cast(spark):
    a = tm.bootstrap(X, method=tm.MovingBlock(5), n_bootstraps=3, random_state=42)
    b = tm.bootstrap(X, method=tm.MovingBlock(5), n_bootstraps=3, random_state=42, dtype="float32")
    assert b.values().dtype == np.float32
    assert (a.values().astype(np.float32) == b.values()).all()
