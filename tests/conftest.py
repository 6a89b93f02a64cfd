import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from kinspark.session import local_session, ship_package  # noqa: E402

TESTDATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    from pyspark.sql import SparkSession

    SparkSession.builder.config("spark.sql.warehouse.dir", str(warehouse))
    session = local_session("tests", cpus=4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{TESTDATA}/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
