import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def texts():
    """doc_id to text of the smallest documents table."""
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(t["doc_id"], t["text"]))


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and repeated texts, ties and a long text; extra columns with names that operators use inside."""
    long = " ".join(f"word{k % 977}" for k in range(30000))
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (2, None, None), (3, "", "y"), (None, "the cat sat", "x"), (4, long, "y"), (5, "  \n\t ", None), (None, None, None), (6, "a b c", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.selectExpr("*", "doc_id AS id", "'r' AS row", "1 AS fp", "2 AS whole", "3 AS rest", "4 AS dedup", "5 AS part", "6 AS sample_key", "7 AS root")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
