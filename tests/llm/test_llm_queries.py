"""Every query of the subpackage runs; those with SQL give its rows."""

import pytest

import __spark_entry__ as entry
from factloom.llm import plans
from tests.test_contract import compare


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, root, name):
    compare(spark, root, name)


def test_columns(spark, root):
    want = {
        "p1_found": ["entity_id_a", "entity_id_b"], "p3_found": ["doc_id", "lang"], "p5_found": ["doc_id"], "p6_found": ["keep_item_id", "copy_item_id"], "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id"],
    }
    for name, columns in want.items():
        df = entry.queries()[name](spark, root)
        assert df.columns == columns and df.count() == df.distinct().count()
