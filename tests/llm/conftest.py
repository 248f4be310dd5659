import pytest


@pytest.fixture(scope="session", autouse=True)
def scratch(spark, tmp_path_factory):
    """Stored tables of the tests go to a folder of their own."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
