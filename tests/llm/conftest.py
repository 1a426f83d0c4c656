import pytest

LONG = "lorem ipsum dolor sit amet " * 8_000

EDGE_TEXTS = [
    None, "", " ", "\n", "a", "the", "Don't  stop\t\n'ere", "x" * 3_000, LONG, "a b\x1cc d", "<|endoftext|> ok", "é\U0001f600 日本",
    "same text here", "same text here",
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeats, and other columns with names that results use."""
    rows = [(k, t, None, 1, "z") for k, t in enumerate(EDGE_TEXTS)]
    rows += [(12, "same text here", None, 1, "z"), (None, "no id", None, 1, "z"), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_tokens int, component_id string")


@pytest.fixture(scope="session")
def sample(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
