import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.sql.adaptive.coalescePartitions.enabled": "true"}
    session = SparkSession.builder.master("local[4]").appName("tests").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v.replace(tzinfo=None) if getattr(v, "tzinfo", None) else v


@pytest.fixture(scope="session")
def matches_sql(spark, sf):
    """Runs a query and the SQL said to be equal to it over the same tables; rows must be the same, in any order."""
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")

    def run(query, sql: str) -> int:
        df = query(spark, sf)
        names = sorted(df.columns)
        got = sorted(tuple(str(_plain(r[c])) for c in names) for r in df.collect())
        answer = db.sql(sql)
        at = [answer.columns.index(c) for c in names]
        assert len(answer.columns) == len(names)
        want = sorted(tuple(str(_plain(r[k])) for k in at) for r in answer.fetchall())
        assert got == want
        return len(got)

    return run
