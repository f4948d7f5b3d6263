from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "plumbline-tests",
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "6g",
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def defects(spark):
    from tests.samples import defect_rows, DEFECT_SCHEMA

    return spark.createDataFrame(defect_rows(), DEFECT_SCHEMA)


@pytest.fixture()
def store(spark, request):
    from plumbline.sources.store import Store

    name = "dq_" + "".join(c if c.isalnum() else "_" for c in request.node.name.lower())[:60]
    yield Store(spark, name).create()
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
