import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture
def docs_of(spark):
    def make(texts, extra=None, **columns):
        rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
        schema = DOCS
        if extra:
            schema = T.StructType([*DOCS.fields, *(T.StructField(n, T.StringType()) for n in extra)])
            rows = [(*r, *("x" for _ in extra)) for r in rows]
        return spark.createDataFrame(rows, schema)

    return make


ODD = [None, "", " \n\t ", "word", "same text here for all to see", "same text here for all to see", "é" * 300, "a" * 200_000, "x y z " * 4000]


@pytest.fixture
def odd_texts():
    return list(ODD)
