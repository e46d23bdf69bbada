import pytest

from callrank.llm.common import ship_code


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship_code(spark)


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def documents(spark):
    def make(texts, start=0):
        rows = [(start + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF
