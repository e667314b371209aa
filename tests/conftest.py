import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from trajmill.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", **{
        "spark.sql.codegen.wholeStage": "false", "spark.sql.adaptive.enabled": "false",
        "spark.sql.shuffle.partitions": "3",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-", dir="/tmp")})
    yield session
    session.stop()
