import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    from tessera.session import get_spark

    shared = tmp_path_factory.mktemp("shared")
    session = get_spark(
        "tests", "local[4]", spark__sql__shuffle__partitions="4", spark__checkpoint__dir=f"file://{shared}", spark__sql__warehouse__dir=f"file://{shared}/warehouse",
        spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__execution__arrow__maxRecordsPerBatch="2000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
