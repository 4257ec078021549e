"""One Spark session for all tests."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from rolloutframe.session import builder

    session = builder("tests").master("local[8]").config(map={
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.local.dir": "/tmp",
    }).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
