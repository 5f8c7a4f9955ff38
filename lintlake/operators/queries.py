"""Core queries for skewed keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.dense import dense_key_stats, heavy_keys
from lintlake.session import table

HEAVY_SHARE = 0.02


def _severity(name: str):
    return F.lower(F.trim("severity")) == name


def _key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = table(spark, sf_dir, "issues")
    kinds = {f"n_{s}": _severity(s) for s in ("nuclear", "spicy", "mild")}
    return dense_key_stats(issues, {c: F.col(c) for c in ("file_path", "rule_name")}, kinds, F.col("scanned_at"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_keys(_key_stats(spark, sf_dir), HEAVY_SHARE)


def p1_key_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by severity and last scan of every file_path and rule_name."""
    out = _key_stats(spark, sf_dir)
    return out.select("field_name", "key_value", "n_rows", "n_nuclear", "n_spicy", "n_mild", "n_other", F.unix_micros("latest").alias("last_scan_us"))


def p1_distinct_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rules of every file: dense counts of (file, rule) pairs first, so a pair counts once however many rows it has."""
    pair = F.to_json(F.struct("file_path", "rule_name"))
    issues = table(spark, sf_dir, "issues").where("file_path is not null and rule_name is not null")
    pairs = dense_key_stats(issues, {"pair": pair}, {})
    path = F.get_json_object("key_value", "$.file_path")
    return pairs.groupBy(path.alias("file_path")).agg(F.count("*").alias("n_rules"), F.sum("n_rows").alias("n_rows"))


def rules_of_files(issues: DataFrame) -> DataFrame:
    """file_path, n_rules and n_rows of every file: a null rule is no rule, but its rows count, and a file with no other rows has 0 rules."""
    pair = F.to_json(F.struct("file_path", "rule_name"))
    pairs = dense_key_stats(issues.where("file_path is not null"), {"pair": pair}, {})
    path, rule = F.get_json_object("key_value", "$.file_path"), F.get_json_object("key_value", "$.rule_name")
    return pairs.groupBy(path.alias("file_path")).agg(F.count(rule).alias("n_rules"), F.sum("n_rows").alias("n_rows"))


def p1_rules_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct rules of every file_path. p1_distinct_rules leaves out the rows without a rule, as its SQL does."""
    return rules_of_files(table(spark, sf_dir, "issues"))


QUERIES = {"p1_found": p1_found, "p1_key_stats": p1_key_stats, "p1_distinct_rules": p1_distinct_rules, "p1_rules_of_files": p1_rules_of_files}

_KEYS = "select 'file_path' as field_name, file_path as key_value, severity, scanned_at from issues union all select 'rule_name', rule_name, severity, scanned_at from issues"
_SEVERITY = "count(*) filter (where lower(trim(severity)) = '{0}') as n_{0}"

SQL = {
    "p1_found": f"select field_name, key_value from ({_KEYS}) where key_value is not null group by 1, 2 having count(*) * 50 >= (select count(*) from issues)",
    "p1_key_stats": f"""select field_name, key_value, count(*) as n_rows, {", ".join(_SEVERITY.format(s) for s in ("nuclear", "spicy", "mild"))},
        count(*) filter (where coalesce(lower(trim(severity)), '') not in ('nuclear', 'spicy', 'mild')) as n_other,
        epoch_us(max(scanned_at)) as last_scan_us from ({_KEYS}) group by 1, 2""",
    "p1_distinct_rules": "select file_path, count(distinct rule_name) as n_rules, count(*) as n_rows from issues where file_path is not null and rule_name is not null group by 1",
    "p1_rules_of_files": "select file_path, count(distinct rule_name) as n_rules, count(*) as n_rows from issues where file_path is not null group by 1",
}
