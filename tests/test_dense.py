from collections import Counter
from datetime import datetime

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lintlake.operators import dense
from lintlake.operators.dense import dense_key_stats, heavy_keys
from lintlake.operators.queries import rules_of_files

SCHEMA = "k string, r string, severity string, at timestamp, key_value string, n_rows long"


def stats(spark, rows):
    df = spark.createDataFrame([(k, r, s, t, "clash", 7) for k, r, s, t in rows], SCHEMA)
    kinds = {"n_mild": F.lower("severity") == "mild"}
    return dense_key_stats(df, {"k": F.col("k"), "r": F.col("r")}, kinds, F.col("at"))


def test_counts_by_kind_and_latest_time(spark):
    early, late = datetime(2024, 1, 1), datetime(2025, 1, 1)
    rows = [("a", "x", "Mild", early), ("a", "x", "Mild", late), ("a", None, None, None), (None, "x", "Spicy", early), ("a", "x", "Mild", late)]
    got = {(r.field_name, r.key_value): (r.n_rows, r.n_mild, r.n_other, r.latest) for r in stats(spark, rows).collect()}
    assert got == {("k", "a"): (4, 3, 1, late), ("k", None): (1, 0, 1, early), ("r", "x"): (4, 3, 1, late), ("r", None): (1, 0, 1, None)}


def test_empty_table_gives_no_rows(spark):
    assert stats(spark, []).collect() == []


def test_blocks_pass_through_every_level(spark, monkeypatch):
    monkeypatch.setattr(dense, "FAN_IN", 2)
    monkeypatch.setattr(dense, "FLUSH_KEYS", 16)
    rows = [("hot" if i % 3 == 0 else f"key{i % 97}", "r", None, None) for i in range(2000)]
    df = spark.createDataFrame([(k, r) for k, r, *_ in rows], "k string, r string").repartition(9)
    got = {r.key_value: r.n_rows for r in dense_key_stats(df, {"k": F.col("k")}, {}).collect()}
    assert got == Counter(k for k, *_ in rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(keys=st.lists(st.one_of(st.none(), st.text("ab é", max_size=2)), max_size=60))
def test_counts_equal_a_plain_count(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r.key_value: r.n_rows for r in dense_key_stats(df, {"k": F.col("k")}, {}).collect()}
    assert got == Counter(keys)


def test_heavy_keys_count_all_rows_and_never_null(spark):
    rows = [("a", "x", None, None)] * 2 + [(None, "x", None, None)] * 48 + [(f"k{i}", "y", None, None) for i in range(50)]
    got = {tuple(r) for r in heavy_keys(stats(spark, rows), 0.02).collect()}
    assert got == {("k", "a"), ("r", "x"), ("r", "y")}


def test_files_without_a_rule_have_no_rules_but_rows(spark):
    rows = [("a", "x"), ("a", "x"), ("a", "y"), ("a", None), ("bare", None), ("bare", None), ("named", "null"), (None, "x")]
    got = {tuple(r) for r in rules_of_files(spark.createDataFrame(rows, "file_path string, rule_name string")).collect()}
    assert got == {("a", 2, 4), ("bare", 0, 2), ("named", 1, 1)}
