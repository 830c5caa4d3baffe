import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tracewell.session import local_session

    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [sys.path[0], os.environ.get("PYTHONPATH")]))
    session = local_session("4", "tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
