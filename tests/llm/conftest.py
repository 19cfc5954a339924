import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long_text = " ".join(f"word{i % 977} and{i % 13}" for i in range(12_000))
    rows = [
        (1, "plain words in a row of some length", "en", "src1", 35), (1, "plain words in a row of some length", "en", "src1", 35), (None, None, None, None, None),
        (2, None, "en", None, 0), (3, "", None, "src2", 0), (4, long_text, "en", "src3", len(long_text)), (5, "plain words in a row of some length", "en", "src9", 35),
        (None, "nameless text", None, None, None), (1, "another text under the same id", "en", "src1", 30), (7, "\n\t  \n", "en", "src1", 5), (8, "Ünï çödé 日本語 \U0001f600 İ", "fr", "src1", 22),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


def clashing(df):
    """Extra columns with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "text_key fp shard slot bucket window items marker start length score label counts ids n_tokens size value path x words".split()
    return df.withColumns({n: F.lit(f"own {n}") for n in names})
