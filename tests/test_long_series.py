"""Series that no single task sorts, packs or holds."""

import numpy as np
import pandas as pd
import pytest

import tidemark as tm
from tidemark.operators import reduce
from tidemark.plans import api

N = 3000


@pytest.fixture(scope="module")
def events(spark):
    rng = np.random.default_rng(6)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 2000, N), unit="s")  # with ties
    return spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 2, N), "ts": ts, "id": rng.permutation(N), "v": rng.normal(size=N) + 50, "w": rng.normal(size=N)})).repartition(5)


def test_ranks_by_ranges_are_ranks(spark, events):
    some = events.selectExpr("g", "case when id % 50 = 0 then null else ts end as ts", "id", "v")
    for order in ("ts", "id", "day"):
        df = some.selectExpr("*", "cast(ts as date) as day")
        a, b = (tm.from_frame(df, "v", order=[order, "id"], series="g", spread=k).rows.orderBy("series_id", "t").toPandas() for k in (0, 7))
        assert a.t.tolist() == b.t.tolist() and [x[0] for x in a.x] == [x[0] for x in b.x]
    assert tm.from_frame(some.where("false"), "v", order="id", spread=4, check=False).rows.count() == 0


@pytest.mark.parametrize("method", [tm.MovingBlock(40), tm.CircularBlock(40), tm.NonOverlappingBlock(7), tm.IID(), tm.StationaryBlock(30)], ids=repr)
@pytest.mark.parametrize("statistic", ["mean", "std", "median"])
def test_long_statistics_are_the_kernels(spark, events, method, statistic, monkeypatch):
    series = tm.from_frame(events, ["v", "w"], order=["ts", "id"], series="g")
    run = lambda: tm.bootstrap_reduce_panel(series, method=method, statistic=statistic, n_bootstraps=6, random_state=8).frame.orderBy("series_id", "b").toPandas()
    want = run()
    monkeypatch.setattr(api, "LONG", 100)
    monkeypatch.setattr(reduce, "PIECE", 128)
    got = run()
    assert got[["series_id", "b"]].to_numpy().tolist() == want[["series_id", "b"]].to_numpy().tolist()
    np.testing.assert_allclose(np.stack(got.theta), np.stack(want.theta), atol=1e-10)
