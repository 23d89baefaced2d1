import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sessionlab.session import build_session

    s = build_session(
        "local[4]", "sessionlab-tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g"}
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
