import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_frame(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns with clashing names."""
    from pyspark.sql import types as T

    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            T.StructField("raw", T.StringType()),
            T.StructField("body", T.StringType()),
            T.StructField("length", T.IntegerType()),
            T.StructField("content", T.StringType()),
            T.StructField("n", T.IntegerType()),
        ]
    )

    def make(rows):
        return spark.createDataFrame([(i, t, "en", None, None, "x", None, 1, "y", 2) for i, t in rows], schema)

    return make


@pytest.fixture(scope="session")
def hard_rows():
    return [
        (1, "One two three four five six seven."),
        (2, None),
        (3, ""),
        (4, "  \t\n "),
        (5, "word " * 30000),
        (1, "One two three four five six seven."),
        (None, "no id here"),
        (None, None),
        (7, "One  two\tthree four\nfive six seven."),
        (8, "Ünï códé 漢字 　 x'll <|endoftext|> İK"),
        (9, "a"),
    ]


@pytest.fixture(scope="session")
def small_documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
