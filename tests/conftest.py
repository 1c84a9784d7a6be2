from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from strandline.runtime import local_session  # noqa: E402


# Started on import: test modules build Columns at module level.
SESSION = local_session("tests", "4", shuffle_partitions=4)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture
def one(spark):
    """Evaluate a Column over a one-row frame of named values."""
    def run(column, **values):
        schema = ", ".join(f"{k} string" for k in values) or "dummy string"
        df = spark.createDataFrame([tuple(values.values()) or ("",)], schema)
        return df.select(column.alias("out")).first()["out"]
    return run
