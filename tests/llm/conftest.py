import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from llm_edges import CLASHING, EDGES, EXTRA  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame([(*row, *["old"] * len(EXTRA)) for row in EDGES], CLASHING)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], CLASHING)
