import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuslens.data.tables import small_table  # noqa: E402
from corpuslens.plans.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def long_of(spark):
    """Texts in long form, numbered from 0, under one field."""

    def build(texts, field="prompt"):
        rows = [(i, field, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "row_id bigint, field string, text string")

    return build


@pytest.fixture(scope="session")
def table_of(spark):
    return lambda columns, rows: small_table(spark, columns, rows)
