import tempfile

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp()).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    """Runs a query's SQL over the small tables and returns its rows."""
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return lambda sql: c.execute(sql).fetchdf()


def normal(frame):
    """Rows in an order of their own, numbers rounded."""
    cols = sorted(frame.columns)
    cell = lambda v: None if v is None or (isinstance(v, float) and v != v) else round(v, 6) if isinstance(v, float) else str(v)
    return cols, sorted(str([cell(v) for v in row]) for row in frame[cols].itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        assert normal(a) == normal(b)

    return check
