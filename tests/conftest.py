import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidewatch.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", 8)
    session.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    yield session
    session.stop()
