"""Streaming, transformers, service functions, diagnostics."""

import io
import json

import numpy as np
import pandas as pd
import pytest

import tidemark as tm
from tidemark import estimators, service
from tidemark.operators import diagnostics
from tidemark.streaming.aci import online_aci, online_agaci, windowed_series

X = np.random.default_rng(0).normal(size=80)


def test_online_aci_is_the_batch_recursion(spark, tmp_path):
    rows = pd.DataFrame({"series_id": 7, "pos": np.arange(80), "r": X})
    for k in range(4):
        spark.createDataFrame(rows[k * 20 : (k + 1) * 20]).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = online_aci(stream, 0.1, 0.05, calibration=30).writeStream.format("memory").queryName("widths").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table("widths").orderBy("pos").toPandas()
    widths, levels = tm.aci_halfwidths(X[:30], X[30:], 0.1, 0.05)
    np.testing.assert_allclose(got.width, widths)
    np.testing.assert_allclose(got.level, levels)


@pytest.mark.parametrize("sentinel", [50.0, None])
def test_online_agaci_is_the_batch_recursion(spark, tmp_path, sentinel):
    r = np.concatenate([X, 4 * X[::-1], X])  # misses in a row drive some experts to infinite widths
    rows = pd.DataFrame({"series_id": 7, "pos": np.arange(len(r)), "r": r})
    for k in range(4):
        spark.createDataFrame(rows[k * 60 : (k + 1) * 60]).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    spec = tm.AgACI(gammas=(0.0, 0.02, 0.3), infinite_sentinel=sentinel)
    name = f"ends_{sentinel is None}"
    query = online_agaci(stream, 0.1, spec, calibration=30).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = spark.table(name).orderBy("pos").toPandas()
    assert got.pos.tolist() == list(range(30, 240)) and np.isfinite(got.upper).all()
    want = tm.agaci_bounds(r[:30], r[30:], 0.1, spec.gammas, infinite_sentinel=sentinel)
    endless = np.isinf([tm.aci_halfwidths(r[:30], r[30:], 0.1, g)[0] for g in spec.gammas]).any(axis=0)
    assert endless.any()
    finite = len(got) if sentinel else int(np.argmax(endless))  # without one, the batch knows the whole series' widest
    np.testing.assert_allclose(got.lower[:finite], want.lower[:finite])
    np.testing.assert_allclose(got.upper[:finite], want.upper[:finite])


def test_windows_of_event_time(spark, tmp_path):
    at = lambda minute: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=minute)).to_pydatetime()
    batches = [[(1, at(5), 1.0), (1, at(50), 3.0), (2, at(10), 7.0)], [(1, at(70), 5.0), (None, at(71), 1.0), (1, at(200), 9.0)], [(2, at(201), 2.0)], [(1, at(20), 100.0), (1, at(195), 1.0), (1, at(400), 0.0)], [(1, at(401), 0.0)]]
    for k, b in enumerate(batches):  # the first of batch 3 comes hours late
        spark.createDataFrame(b, "u long, ts timestamp, v double").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("u long, ts timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = windowed_series(stream, "v", time="ts", series="u", width="1 hour", delay="10 minutes").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["series_id"], r["start"].hour): (r["v"], r["n"]) for r in spark.table("hours").collect()}
    assert got == {(1, 0): (2.0, 2), (2, 0): (7.0, 1), (1, 1): (5.0, 1), (1, 3): (5.0, 2), (2, 3): (2.0, 1)}


ALL = [c for c in vars(estimators).values() if isinstance(c, type) and issubclass(c, estimators.SeriesBootstrap) and c is not estimators.SeriesBootstrap and not c.__name__.startswith("_")]


@pytest.mark.parametrize("kind", ALL, ids=lambda c: c.__name__)
def test_transformers(spark, kind, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat([1, 2], 40), "ts": np.tile(np.arange(40), 2), "value": X, "w": X[::-1]}))
    more = {"valueCols": ["value", "w"]} if kind is estimators.VARResidualBootstrap else {"blockLength": 4} if "Block" in kind.__name__ else {"maxLag": 2} if kind is estimators.SieveBootstrap else {}
    stage = kind(seriesCol="g", numBootstraps=3, seed=1, returnIndices=True, **more)
    out = stage.transform(df)
    assert out.count() == 2 * 3 * 40 and "idx" in out.columns
    stage.write().overwrite().save(str(tmp_path / "stage"))
    assert kind.load(str(tmp_path / "stage")).spec() == stage.spec()
    assert len(ALL) == 10


def test_service():
    out = service.bootstrap_confidence_interval(X.tolist(), "MovingBlock", "mean", random_state=7, block_length=5)
    assert out["ci_lower"] <= out["point_estimate"] <= out["ci_upper"] and out["n_bootstraps"] == 200
    assert service.bootstrap_confidence_interval(X.tolist(), "MovingBlock", "variance", random_state=7)["standard_error"] > 0
    for bad in (([1, 2], "IID", "mean", 1), (X.tolist(), "Nope", "mean", 1), (X.tolist(), "IID", "mode", 1), (X.tolist(), "IID", "mean", None), ("x", "IID", "mean", 1), ([1.0, float("nan"), 2.0], "IID", "mean", 1)):
        assert "error" in service.bootstrap_confidence_interval(*bad)
    assert service.bootstrap_confidence_interval(X.tolist(), "MovingBlock", "mean", 1, block_length=500)["error"]["code"] == tm.Codes.BLOCK_LENGTH_GT_N
    assert service.diagnose_series(X.tolist())["recommended_methods"][0] == "IID"
    assert "error" in service.diagnose_series([1.0, 2.0])


def test_diagnose():
    walk = np.cumsum(np.random.default_rng(1).normal(size=400))
    assert tm.diagnose(walk).nonstationary
    assert tm.diagnose(np.ones(10)).lag1_autocorr == 0
    assert tm.diagnose(np.column_stack([X, X])).recommended_methods[0].startswith("ResidualBootstrap(model=VAR")


def test_unit_root_test(spark):
    assert diagnostics.mackinnon(-2.86) == pytest.approx(0.05, abs=2e-3) and diagnostics.mackinnon(-3.43) == pytest.approx(0.01, abs=1e-3)  # published critical values
    rng = np.random.default_rng(3)
    walks, noises = rng.normal(size=(40, 300)).cumsum(axis=1), rng.normal(size=(40, 300))
    assert np.mean([diagnostics.adf(w)[2] > 0.05 for w in walks]) > 0.85
    assert np.mean([diagnostics.adf(w)[2] < 0.05 for w in noises]) > 0.95
    assert not tm.diagnose(noises[0]).nonstationary
    for bad in (np.ones(50), np.arange(3.0)):
        with pytest.raises(ValueError):
            diagnostics.adf(bad)
    series = tm.from_arrays([np.column_stack([walks[0], noises[0]]), np.ones((9, 2))], spark)
    got = {(r["series_id"], r["dim"]): r for r in diagnostics.adf_frame(series).collect()}
    assert got[0, 0]["p_value"] == pytest.approx(diagnostics.adf(walks[0])[2]) and got[0, 1]["p_value"] < 0.01
    assert got[1, 0]["statistic"] is None and got[1, 1]["p_value"] is None


def test_tool_server():
    ask = lambda i, method, **params: json.dumps({"jsonrpc": "2.0", "id": i, "method": method, "params": params})
    lines = [
        ask(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), ask(2, "tools/list"), "", ask(3, "tools/call", name="diagnose_series", arguments={"series": X.tolist()}),
        ask(4, "tools/call", name="bootstrap_confidence_interval", arguments={"series": X.tolist(), "method": "IID", "statistic": "mean"}), ask(5, "nope"), "{", ask(6, "tools/call", name="x"), ask(7, "ping"),
        ask(8, "tools/call", name="bootstrap_confidence_interval", arguments={"series": X.tolist(), "method": "IID", "statistic": "mean", "random_state": 3}),
    ]
    sink = io.StringIO()
    service.serve(io.StringIO("\n".join(lines)), sink)
    got = {r["id"]: r for r in map(json.loads, sink.getvalue().splitlines())}
    assert got[1]["result"]["serverInfo"]["name"] == "tidemark" and len(got[2]["result"]["tools"]) == 2
    assert got[3]["result"]["structuredContent"]["recommended_methods"] and not got[3]["result"]["isError"]
    assert got[4]["result"]["isError"] and got[6]["result"]["isError"]
    assert got[5]["error"]["code"] == -32601 and got[None]["error"]["code"] == -32700 and got[7]["result"] == {}
    assert got[8]["result"]["structuredContent"]["ci_lower"] < got[8]["result"]["structuredContent"]["ci_upper"]


def test_metadata_query_has_own_methods_only(spark, monkeypatch):
    from tidemark import queries
    from tidemark.plans import metadata

    record = tm.MethodMetadata("other", (), True, False, False, False, False, (), "O(n)", ())
    monkeypatch.setitem(metadata._KNOWN, type("Other", (), {}), record)
    names = lambda df: [r["name"] for r in df.collect()]
    assert "other" in names(metadata.metadata_frame(spark))
    got = names(queries.QUERIES["method_metadata"](spark, ""))
    assert got == ["iid", "moving_block", "circular_block", "stationary_block", "non_overlapping_block", "tapered_block", "residual", "sieve_ar"]
