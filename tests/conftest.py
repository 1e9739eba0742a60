import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "3g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def same(spark, sf_dir):
    """Holds a query against its SQL in DuckDB, as the driver does: rows as multisets, columns by name."""
    import duckdb

    names = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    duck = duckdb.connect()
    for n in names:
        duck.sql(f"create view {n} as select * from '{sf_dir}/{n}.parquet'")

    def check(query, sql):
        got, want = query(spark, sf_dir).toPandas(), duck.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(map(repr, f[columns].astype(str).to_numpy().tolist())) for f in (got, want)]
        assert rows[0] == rows[1]

    return check
