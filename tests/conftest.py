import sys
from contextlib import contextmanager
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from speechloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", partitions=4)
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Value of a Column expression over one row of a single column ``x``."""

    def run(expression, value, kind="string"):
        return spark.createDataFrame([(value,)], f"x {kind}").select(expression).first()[0]

    return run


@pytest.fixture
def without_broadcasts(spark):
    """Within it no side is small enough to be broadcast."""

    @contextmanager
    def run():
        key = "spark.sql.autoBroadcastJoinThreshold"
        old = spark.conf.get(key)
        spark.conf.set(key, "-1")
        try:
            yield
        finally:
            spark.conf.set(key, old)

    return run
