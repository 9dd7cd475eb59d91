import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from claimloom.session import drop_cuts, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    yield session
    drop_cuts(session)
    session.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Apply a Column function to a list of texts."""
    from pyspark.sql import functions as F

    def run(function, values, schema="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
        return [r[0] for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").select("x").collect()]

    return run
