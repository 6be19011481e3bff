import pytest
from edges import odd_tables

from loomspark.plans import prep, prep_time

QUERIES = prep.QUERIES | prep_time.QUERIES


@pytest.mark.parametrize("how", ["empty", "null", "clashing"])
def test_general_operators_on_odd_tables(spark, sf, tmp_path, how):
    d = odd_tables(spark, sf, tmp_path, how)
    for name, q in QUERIES.items():
        rows = q(spark, d).collect()
        if how == "empty" and name != "p5_zones":
            assert rows == [], name
