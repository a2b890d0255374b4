import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from llm_rows import CLASHING, EDGES, SCHEMA  # noqa: E402

@pytest.fixture(scope="session")
def edge_docs(spark):
    return {extra: spark.createDataFrame(EDGES, SCHEMA.format(extra=extra)) for extra in CLASHING}


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
