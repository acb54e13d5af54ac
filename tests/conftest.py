import os

import duckdb
import pytest
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{shared}").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool_":
        return bool(x)
    if isinstance(x, str):
        return x
    return round(float(x), 6)


def same_rows(spark_df, duck, sql):
    """Asserts equal columns and equal multisets of rows."""
    names = sorted(spark_df.columns)
    cursor = duck.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    place = [theirs.index(n) for n in names]
    key = lambda row: tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)
    expected = sorted((tuple(_plain(r[i]) for i in place) for r in cursor.fetchall()), key=key)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in spark_df.collect()), key=key)
    assert got == expected
