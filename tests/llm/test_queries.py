import pytest

from tools.compare import compare, views
from weftline.llm import queries


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_queries(spark, sf, name):
    text, ok = compare(spark, views(sf), sf, name)
    assert ok, text


def test_columns(spark, sf):
    want = {"p1_found": "typeno int, featno int, cluster_featno int", "p5_found": "typeno int, featno_a int, featno_b int", "p6_ids": "doc_id bigint, ids array<int>", "p7_found": "doc_id bigint, item_id bigint", "p8_found": "doc_id bigint"}
    for name, cols in want.items():
        assert ", ".join(f"{c} {t}" for c, t in queries.QUERIES[name](spark, sf).dtypes) == cols
