import pytest

from tests.llm.texts import ODD, corpus


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty and very long texts, nulls in every column, ties, repeated rows, clashing column names."""
    return spark.createDataFrame(ODD, "doc_id long, text string, score string, digest string, sequence_id int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -99")


@pytest.fixture(scope="session")
def small(spark):
    """Documents with copies, near copies, families of edits and shared passages."""
    return spark.createDataFrame(list(corpus().items()), "doc_id long, text string").repartition(5).cache()
