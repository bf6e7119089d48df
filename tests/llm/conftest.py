from __future__ import annotations

import pytest

from llm.corpus_rows import CLASHING, edge_rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    """The rows above in several partitions, with columns of names that the operators use themselves."""
    schema = "doc_id long, text string, lang string, " + CLASHING
    return spark.createDataFrame([(*r, *["other"] * 9) for r in edge_rows()], schema).repartition(3, "text")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
