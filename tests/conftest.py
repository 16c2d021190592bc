import pytest

from tests.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate a Column function on single texts: ``one(fn, "text", ...) -> list``."""
    from pyspark.sql import functions as F

    def run(fn, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        return [r.v for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]

    return run
