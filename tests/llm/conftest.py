import pytest
from pyspark.sql import DataFrame

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame of several partitions."""

    def make(rows, schema: str, parts: int = 3) -> DataFrame:
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
