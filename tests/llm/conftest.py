import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("key", T.StringType()), T.StructField("row", T.StringType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with extra columns whose names the operators use inside."""
    def make(rows):
        return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], DOCS).repartition(3)
    return make
