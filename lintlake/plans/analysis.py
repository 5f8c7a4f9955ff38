"""From a path or a table of files to issues and a report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.rules import all_issues
from lintlake.operators.texts import with_message
from lintlake.plans.report import Options, Report
from lintlake.sources.files import scan_files


def analyze(files: DataFrame, lang: str = "en-US") -> DataFrame:
    """The issues table of a table of files (one row a file_path): the rows of all rules with messages and issue_id.

    (file_path, emit_seq) is the key of a row. issue_id is the 64-bit hash of it: the same in every run over the same content, and unique but for the chance
    of a collision, about one in 37 for a billion issues.
    """
    issues = with_message(all_issues(files), lang)
    return issues.withColumn("issue_id", F.xxhash64("file_path", "emit_seq"))


def analyze_file(spark: SparkSession, path: str, lang: str = "en-US") -> DataFrame:
    """Issues of one file, whatever exclude patterns would say."""
    return analyze(scan_files(spark, path, single=True), lang)


def report_on_path(spark: SparkSession, path: str, exclude: list[str] | None = None, options: Options | None = None) -> str:
    options = options or Options()
    files = scan_files(spark, path, exclude).persist()
    try:
        return Report(analyze(files, options.lang), files, options).text()
    finally:
        files.unpersist()
