import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def pytest_sessionstart(session):
    """The session is there before test modules are read: they build columns."""
    from brindle.session import session as start

    folder = tempfile.mkdtemp(prefix="brindle-tests-")
    s = start("local[4]", 4, **{"spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": f"{folder}/warehouse", "spark.checkpoint.dir": f"{folder}/shared"})
    s.sparkContext.setLogLevel("OFF")
    session.config.spark = s


@pytest.fixture(scope="session")
def spark(request):
    return request.config.spark
