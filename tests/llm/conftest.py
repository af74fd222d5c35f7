import tempfile

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) or full tuples, with extra columns if asked."""
    def f(rows, extra=()):
        full = [tuple(r) + ("en", "s", len(r[1] or "")) if len(r) == 2 else tuple(r) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        from pyspark.sql import functions as F
        for name in extra:
            df = df.withColumn(name, F.lit("own"))
        return df
    return f


@pytest.fixture(scope="session")
def table_dir(spark):
    def f(df, name="documents"):
        d = tempfile.mkdtemp(prefix="corpuslab-table-")
        df.coalesce(2).write.mode("overwrite").parquet(f"{d}/{name}.parquet")
        return d
    return f
