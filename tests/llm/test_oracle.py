"""The queries that SQL can express, against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import check, connect  # noqa: E402

from kerbline.llm.oracle import ORACLE  # noqa: E402
from kerbline.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", list(ORACLE))
def test_query(spark, sf, name):
    assert check(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) > 0
