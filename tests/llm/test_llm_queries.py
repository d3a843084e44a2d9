"""Every registered query of the subpackage runs on the smallest data and agrees with its SQL."""

import pytest
from oracle import compare

from quarryline.llm import queries as Q

FOUND = {"p2_found": ["block_id", "line_no"], "p3_found": ["sample_id", "defect"], "p4_found": ["block_id", "field_name", "markup"], "p6_found": ["block_id", "noise"], "p7_found": ["report_id", "field_name"], "p8_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "kind"]}


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, name):
    if name in Q.SQL:
        compare(spark, data, Q.QUERIES[name], Q.SQL[name])
    else:
        got = Q.QUERIES[name](spark, data).collect()
        assert len(got) > 0


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    assert df.columns == FOUND[name]
    got = df.collect()
    assert got and len(got) == len(set(got))
