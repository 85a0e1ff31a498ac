import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """About 200 given documents and some odd ones, in one table."""
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    long_text = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
    odd = [
        (10_001, None, None, None, None), (10_002, "", "en", "src0", 0), (10_003, " \n\t ", "en", None, 4),
        (10_004, long_text, "en", "src0", len(long_text)), (10_005, long_text, "de", "one", len(long_text)),
        (10_006, "one two three", "xx", "one", 13), (10_007, "One two  three", None, "two", 14),
        (10_008, "é😀 a@b.co c_d@e.f 1.2.3.4 300.1.1.1 4111 1111 1111 1111, +1 (752) 555-7047", "fr", "two", 70),
        (10_009, "ab" * 400, "en", "two", 800), (10_010, "x" * 200, "en", "two", 200),
        (10_011, "<|endoftext|> It's <|ENDOFTEXT|> ÉTÉ İ 12", "fr", "two", 30),
    ]
    return given.unionByName(spark.createDataFrame(odd, SCHEMA)).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}


def clashing(df, *names):
    """``df`` with further columns of the given names."""
    return df.withColumns({n: F.lit("other") for n in names})
