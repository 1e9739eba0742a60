"""Automatic block lengths of long series, whose rule asks for many lags."""

import numpy as np
import pytest

import tidemark as tm
from tidemark.operators import blocklength
from tidemark.plans.api import with_lengths


@pytest.fixture(scope="module")
def slow():
    """A persistent series whose tuning lag exceeds 400."""
    rng, x = np.random.default_rng(2), np.zeros(170_000)
    for i, e in enumerate(rng.standard_normal(len(x) - 1)):
        x[i + 1] = 0.999 * x[i] + e
    return x


def test_long_series_keep_all_lags(spark, slow):
    short = slow[:300].copy()
    rows = tm.from_arrays([slow[:, None], short[:, None]], spark).scalar().select("series_id", "t", "v")
    got = {r["n"]: r for r in blocklength.block_lengths(rows).collect()}
    assert sorted(got) == [300, 170_000] and got[170_000]["m"] > 400
    for x in (slow, short):
        np.testing.assert_allclose([got[len(x)][k] for k in ("m", "b_stationary", "b_circular")], blocklength.tuned(x), rtol=1e-9)


def test_auto_panels_of_long_series(spark, slow):
    series = tm.from_arrays([slow[:, None]], spark)
    assert with_lengths(series, tm.CircularBlock("auto")).first()["length"] == blocklength.optimal_block_length(slow[:, None])


def test_both_ways_agree(slow, monkeypatch):
    x = slow[:3000]
    a = blocklength.autocovariances(x, 100)
    monkeypatch.setattr(blocklength, "DIRECT", 1000)
    np.testing.assert_allclose(a, blocklength.autocovariances(x, 100), rtol=1e-9)
