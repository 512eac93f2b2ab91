from pyspark.sql import types as T
import pytest

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """``[(doc_id, text, source)]`` as a documents table."""
    def make(rows, clash=()):
        df = spark.createDataFrame([(i, t, "en", s, len(t) if t else 0) for i, t, s in rows], DOCS)
        for name in clash:
            from pyspark.sql import functions as F
            df = df.withColumn(name, F.lit("clash"))
        return df
    return make
