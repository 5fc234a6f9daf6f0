import os

import duckdb
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


def compare(df, sql: str, sf_dir: str) -> None:
    """The rows of a query and of its SQL, in any order, floats to nine digits."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    cols = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*cols).collect()]
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    theirs = [tuple(r[i] for i in order) for r in found.fetchall()]
    text = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(text, r)) for r in mine) == sorted(tuple(map(text, r)) for r in theirs)
