from __future__ import annotations

import os
import sys

import pytest
from common import ROOT, SF, TABLES, plain

sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"  # for the workers


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{folder}")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Hold a query against its SQL."""

    def check(query, sql):
        df = query(spark, SF)
        names = sorted(df.columns)
        ours = sorted(([plain(r[c]) for c in names] for r in df.collect()), key=repr)
        found = duck.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == names
        at = [columns.index(c) for c in names]
        theirs = sorted(([plain(r[i]) for i in at] for r in found.fetchall()), key=repr)
        assert ours == theirs
        return len(ours)

    return check
