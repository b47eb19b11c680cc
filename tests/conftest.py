import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import session  # noqa: E402

from nextrail.operators import skew  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return session(partitions=4)


@pytest.fixture(params=[None, 1], ids=["light", "heavy"])
def heavy_rows(request, monkeypatch):
    """Runs a test twice: with the ordinary plan, and with every larger key taken as heavy."""
    if request.param is not None:
        monkeypatch.setattr(skew, "MIN_HEAVY_ROWS", request.param)
    return request.param


@pytest.fixture
def partitions(spark):
    """Sets the number of shuffle partitions and puts it back."""
    before = spark.conf.get("spark.sql.shuffle.partitions")

    def use(count: int) -> None:
        spark.conf.set("spark.sql.shuffle.partitions", count)

    yield use
    spark.conf.set("spark.sql.shuffle.partitions", before)
