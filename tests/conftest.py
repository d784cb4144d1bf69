import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows_of(table) -> list[tuple]:
    """Sorted rows of an Arrow table, columns by name."""
    names = sorted(table.schema.names)
    return sorted(zip(*[table.column(n).to_pylist() for n in names], strict=True), key=lambda r: [(x is not None, str(x)) for x in r])


@pytest.fixture(scope="session")
def compare(spark, sf_dir, duck):
    def check(run, sql):
        ours = run(spark, sf_dir).toArrow()
        theirs = duck.sql(sql).to_arrow_table()
        assert sorted(ours.schema.names) == sorted(theirs.schema.names)
        assert rows_of(ours) == rows_of(theirs)

    return check
