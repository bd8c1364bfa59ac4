from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from barspark.session import get_session

    place = str(tmp_path_factory.mktemp("spark"))
    session = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": f"file:{place}/warehouse"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
