"""Every query that has SQL gives the same rows, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import compare, connect

CORE = [n for m in entry._MODULES if not m.__name__.startswith("lintlake.llm") for n in m.QUERIES]


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, data, name):
    assert compare(spark, con, name, data).startswith(("ok", "rows only"))


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_the_core_does_not_import_the_training_data_operators():
    from pathlib import Path

    root = Path(entry.__file__).parent / "lintlake"
    assert not [p for p in root.rglob("*.py") if "lintlake.llm" in p.read_text() and "llm" not in p.relative_to(root).parts]


def test_stream(spark, data, tmp_path):
    from lintlake.sources.files import stored_files
    from lintlake.streaming.files import watch

    stored_files(spark, data).write.parquet(str(tmp_path / "in"))
    query = watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
