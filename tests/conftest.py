from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small(tmp_path_factory) -> str:
    """The smallest tables, documents cut to forty rows so that SQL over their letters is quick."""
    d = tmp_path_factory.mktemp("small")
    con = duckdb.connect()
    for t in TABLES:
        where = " WHERE doc_id < 40" if t == "documents" else ""
        con.sql(f"COPY (SELECT * FROM '{DATA}/{t}.parquet'{where}) TO '{d}/{t}.parquet' (FORMAT parquet)")
    return str(d)


@pytest.fixture(scope="session")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con
