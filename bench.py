"""Times the headline queries once warm; prints one JSON line.

BENCH_SF_DIR: the tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8). The value is the sum of the
queries' seconds; each writes its whole result to Spark's noop sink.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import tidemark as tm
from tidemark import queries

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
HEADLINES = ["ci_percentile", "moving_mean", "circular_mean", "stationary_mean", "iid_mean", "moving_quantile", "block_sum_mean", "moving_values", "inbag_counts", "pwsd_block_length", "ci_studentized", "ci_bca", "ar1_fit", "forecast_ar1", "ar1_residual_paths", "sieve_paths", "sliding_width", "aci_levels", "enbpi_intervals"]


def panel(spark: SparkSession, count: int = 10_000, n: int = 200) -> tm.SeriesFrame:
    """AR(1) series, as in the published panel figures: count series of n observations."""
    rng = np.random.default_rng(0)
    x = rng.standard_normal((count, n))
    for t in range(1, n):
        x[:, t] += 0.5 * x[:, t - 1]
    import pyarrow as pa

    frame = spark.createDataFrame(pa.table({"series_id": np.arange(count), "v": pa.FixedSizeListArray.from_arrays(x.ravel(), n).cast(pa.list_(pa.float64()))}))
    rows = frame.repartition(int(CPUS) * 2).select("series_id", F.col("series_id").alias("slot"), F.posexplode("v").alias("t", "x")).select("series_id", "slot", "t", F.array("x").alias("x")).persist()
    rows.count()
    return tm.SeriesFrame(rows, 1, True)


def timed(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINES:
        for _ in range(2):  # the first run compiles code
            start = time.perf_counter()
            df = queries.QUERIES[name](spark, SF_DIR)
            took = timed(df)
            seconds[name] = round(time.perf_counter() - start, 3) if took else took
    series = panel(spark)
    for method in (tm.MovingBlock(20), tm.CircularBlock(20), tm.StationaryBlock(20), tm.IID()):
        for _ in range(2):
            out = tm.bootstrap_reduce_panel(series, method=method, statistic="mean", n_bootstraps=1000, random_state=1)
            seconds[f"panel_10000x200x1000_{method.kind}_mean"] = timed(out.frame)
    sf = SF_DIR.rstrip("/").rpartition("sf")[2]
    print(json.dumps({"metric": "headline_queries_warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
