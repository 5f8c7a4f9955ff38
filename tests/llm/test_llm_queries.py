"""The queries of the training-data operators on the smallest tables, against their SQL where there is some."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect
from lintlake.llm import queries as llm


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", list(llm.QUERIES))
def test_query(spark, con, data, name):
    assert name in entry.queries()
    assert compare(spark, con, name, data).startswith(("ok", "rows only"))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p2_found", "record_kind string, record_key string"),
        ("p3_found", "list_name string, group_key string, item_id bigint"),
        ("p4_found", "file_id bigint"),
        ("p5_found", "block_id_a bigint, block_id_b bigint"),
        ("p6_ids", "doc_id bigint, ids array<int>"),
        ("p8_found", "doc_id bigint"),
    ],
)
def test_columns(spark, data, name, columns):
    df = entry.queries()[name](spark, data)
    assert ", ".join(f"{n} {t}" for n, t in df.dtypes) == columns
    assert df.count() == df.distinct().count()
