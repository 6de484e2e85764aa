import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from cellwatch.runtime import local_scratch, session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    spark = local_scratch(session("tests", "local[4]", 4))
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
