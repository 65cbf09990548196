import os

import pytest

from quern.session import get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "3g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def data():
    d = os.path.join(os.environ.get("QUERN_DATA", "/root/testdata"), "sf0.001")
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d
