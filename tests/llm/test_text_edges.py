import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from edges import odd_tables  # noqa: E402

from loomspark.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("how", ["empty", "null", "clashing"])
def test_text_operators_on_odd_tables(spark, sf, tmp_path, how):
    d = odd_tables(spark, sf, tmp_path, how)
    for name, q in QUERIES.items():
        rows = q(spark, d).collect()
        if how == "empty":
            assert rows == [], name
