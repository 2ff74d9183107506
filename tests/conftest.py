import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
# Python workers import the package too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(shared)).config("spark.sql.warehouse.dir", str(shared / "warehouse")).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df):
    """The rows of a pandas frame in no order, columns by name, floats rounded (whole ones as integers, as nullable integers are floats in one engine), lists as text."""
    import pandas as pd

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0) if v % 1 else str(int(v))
        return str(list(v)) if hasattr(v, "__len__") and not isinstance(v, str) else str(v)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted((tuple(map(cell, r)) for r in df.itertuples(index=False, name=None)), key=repr)


@pytest.fixture(scope="session")
def same(spark, duck):
    """Whether a registered query and its oracle give the same rows."""

    def check(query, oracle):
        got, want = rows(query(spark, SF).toPandas()), rows(duck.sql(oracle).df())
        assert got[0] == want[0]
        assert got[1] == want[1]

    return check
