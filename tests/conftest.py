import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tabwright-tests-"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def mixed(spark):
    """100 rows with numbers, text, real nulls and the text ``nan``."""
    import numpy as np

    rng = np.random.default_rng(7)
    rows = [
        (
            i,
            None if i % 10 == 0 else float(rng.normal()),
            None if i % 15 == 0 else float(rng.normal()),
            ["A", "B", "C", "nan", None][int(rng.integers(5))],
            int(rng.integers(2)),
        )
        for i in range(100)
    ]
    return spark.createDataFrame(rows, "id bigint, f1 double, f2 double, f3 string, target int").cache()
