import os

import pytest

from check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["scan_people", "scan_documents", "dedup_cell", "find_pan", "masked_ids", "summary",
          "sanitize_tokenize", "split_cells", "sheet_cells", "flatten_json"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["column", "confidence", "findings"]
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_against_sql(spark, name):
    import __spark_entry__ as e

    assert compare(spark, duck(SF), SF, e.queries()[name], e.oracle_sql()[name]) == ""
