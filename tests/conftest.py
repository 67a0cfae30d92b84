import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("seqloom-tests")
        .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def normal(df):
    """Rows as sorted tuples of text, columns by name."""
    import math

    def cell(v):
        if v is None or str(v) == "<NA>" or isinstance(v, float) and math.isnan(v):
            return "NULL"
        if hasattr(v, "tolist"):
            v = v.tolist()
        return repr(round(v, 6)) if isinstance(v, float) else str(v)

    cols = sorted(df.columns)
    return cols, sorted(tuple(cell(v) for v in row) for row in df[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="session")
def same():
    def check(a, b):
        (ca, ra), (cb, rb) = normal(a), normal(b)
        assert ca == cb
        assert len(ra) == len(rb)
        assert ra == rb

    return check
