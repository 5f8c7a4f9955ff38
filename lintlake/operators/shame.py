"""Rankings of the worst: files, patterns, directories and rule groups, each with a fixed order of ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.text import basename, parent_directory, severity_rank
from lintlake.operators.dims import SHAME_WEIGHTS, family_of
from lintlake.operators.scoring import density
from lintlake.operators.texts import number_of


def shame_score(nuclear: Column, spicy: Column, mild: Column) -> Column:
    return nuclear * SHAME_WEIGHTS["Nuclear"] + spicy * SHAME_WEIGHTS["Spicy"] + mild * SHAME_WEIGHTS["Mild"]


def _counts() -> list[Column]:
    return [F.count("*").alias("n_issues"), *(F.count_if(F.col("severity") == s).alias(f"n_{s.lower()}") for s in SHAME_WEIGHTS)]


def shame_entries(issues: DataFrame) -> DataFrame:
    """file_path, counts and shame_score of every file with issues."""
    out = issues.groupBy("file_path").agg(*_counts())
    return out.withColumn("shame_score", shame_score(F.col("n_nuclear"), F.col("n_spicy"), F.col("n_mild")))


def worst_offenses(issues: DataFrame) -> DataFrame:
    """file_path, rule_name, message of the Nuclear and Spicy issues: the list of a file as rows, so that no file is gathered in one place."""
    return issues.where(F.col("severity").isin("Nuclear", "Spicy")).select("file_path", "rule_name", "severity", "message")


def top_entries(entries: DataFrame, n: int = 10) -> DataFrame:
    return entries.orderBy(F.desc("shame_score"), "file_path").limit(n)


def pattern_stats(issues: DataFrame) -> DataFrame:
    """rule_name, counts by severity and number of files of every rule."""
    return issues.groupBy("rule_name").agg(*_counts(), F.count_distinct("file_path").alias("n_files"))


def pattern_examples(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` distinct files of every rule, by name: rule_name, file_path, position."""
    pairs = issues.select("rule_name", "file_path").where("file_path is not null").distinct()
    order = Window.partitionBy("rule_name").orderBy("file_path")
    return pairs.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def top_patterns(stats: DataFrame, n: int = 10) -> DataFrame:
    return stats.orderBy(F.desc("n_issues"), "rule_name").limit(n)


def shame_density(issues: DataFrame, files: DataFrame) -> DataFrame:
    """One row: issues, files with issues, their lines and the density over these lines only."""
    entries = issues.groupBy("file_path").agg(F.count("*").alias("n"))
    joined = entries.join(files.select("file_path", "line_count"), "file_path", "left")
    out = joined.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_issues"), F.count("*").alias("n_files"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"))
    return out.withColumn("density", density(F.col("n_issues"), F.col("n_lines")))


def family_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy(family_of(F.col("rule_name")).alias("family")).agg(F.count("*").alias("n_issues"))


def heatmap(entries: DataFrame) -> DataFrame:
    return entries.groupBy(parent_directory(F.col("file_path")).alias("directory")).agg(F.sum("shame_score").alias("shame_score"))


def anonymous_stats(issues: DataFrame, buckets: int = 100) -> DataFrame:
    """developer (a bucket of the path's hash) and its issues."""
    name = F.concat(F.lit("Developer_"), number_of(F.col("file_path")) % buckets)
    return issues.groupBy(name.alias("developer")).agg(F.count("*").alias("n_issues"))


def improvement_suggestions(stats: DataFrame, total_density: Column | float = 0.0) -> DataFrame:
    """position, rule_name, suggestion for the three most common patterns, one more line above 50 issues in a thousand lines, a default if there is nothing."""
    rule, n = F.col("rule_name"), F.col("n_issues")
    text = (
        F.when(rule.contains("naming"), "Choose names that say what a thing is for")
        .when(rule.contains("unwrap"), "Handle the error case instead of unwrapping")
        .when(rule.contains("complexity") | rule.contains("nesting"), "Split deep and long functions into small ones")
        .when(rule.contains("println"), "Log through a logging crate instead of printing")
        .when(rule.contains("clone"), "Borrow where a clone isn't needed")
        .otherwise(F.concat_ws("", F.lit("Work through the "), n.cast("string"), F.lit(" findings of "), rule))
    )
    spark = stats.sparkSession
    top = top_patterns(stats, 3).withColumn("position", F.row_number().over(Window.orderBy(F.desc("n_issues"), "rule_name")))
    out = top.select(F.col("position").cast("int").alias("position"), "rule_name", text.alias("suggestion"))
    dense = total_density if isinstance(total_density, Column) else F.lit(total_density)
    more = spark.createDataFrame([(4, None, "More than 50 findings in a thousand lines: plan a clean-up")], "position int, rule_name string, suggestion string")
    out = out.unionByName(more.where(dense > 50))
    default = spark.createDataFrame([(1, None, "Nothing stands out, keep it up")], "position int, rule_name string, suggestion string")
    return out.unionByName(default.join(out.limit(1).select(F.lit(1).alias("position")), "position", "left_anti"))


# Listings of a report.


def top_files(issues: DataFrame, n: int = 5) -> DataFrame:
    """file_name and issues by base name, so files of one name in different directories count together; n = 0 gives no row."""
    out = issues.groupBy(basename(F.col("file_path")).alias("file_name")).agg(F.count("*").alias("n_issues"))
    return out.orderBy(F.desc("n_issues"), "file_name").limit(n)


def rule_groups(issues: DataFrame, n: int = 0, by_count: bool = False) -> DataFrame:
    """file_name, rule_name, n_issues, worst (severity rank), position: the rules of every base name, by worst severity and name or by count; n = 0 keeps all."""
    groups = issues.groupBy(basename(F.col("file_path")).alias("file_name"), "rule_name").agg(F.count("*").alias("n_issues"), F.max(severity_rank(F.col("severity"))).alias("worst"))
    first = F.desc("n_issues") if by_count else F.desc_nulls_last("worst")
    out = groups.withColumn("position", F.row_number().over(Window.partitionBy("file_name").orderBy(first, "rule_name")))
    return out.where(F.col("position") <= n) if n else out


def group_details(issues: DataFrame, n: int = 0, names: int = 5) -> DataFrame:
    """rule_groups with what a report says of a group: least and greatest depth of nesting rules (null for others), the first ``names`` subjects
    of naming rules in their order (an empty list for others) and whether there are more rows than these.

    A table without subject or message has no names or depths. Depths are the first number of a subject or message that names a depth, or a subject that is a number. Names come from a window that ends at
    ``names``, so no group is gathered in one place.
    """
    rows = issues.withColumns({c: F.lit(None).cast("string") for c in ("subject", "message") if c not in issues.columns} | {"file_name": basename(F.col("file_path"))})
    nesting, naming = F.col("rule_name").contains("nesting"), F.col("rule_name").contains("naming") | F.col("rule_name").contains("single-letter")
    said = F.regexp_extract(F.coalesce("message", F.lit("")), r"(?:depth|深度): (\d+)", 1)
    depth = F.when(nesting, F.coalesce(F.when(F.col("subject").rlike(r"^\d{1,9}$"), F.col("subject")), F.when(said != "", said)).try_cast("int"))
    depths = rows.groupBy("file_name", "rule_name").agg(F.min(depth).alias("least_depth"), F.max(depth).alias("greatest_depth"))
    order = Window.partitionBy("file_name", "rule_name").orderBy(F.desc_nulls_last(severity_rank(F.col("severity"))), "emit_seq", "issue_id")
    named = rows.where(naming & F.col("subject").isNotNull()).withColumn("at", F.row_number().over(order)).where(F.col("at") <= names)
    listed = named.groupBy("file_name", "rule_name").agg(F.array_sort(F.collect_list(F.struct("at", "subject"))).alias("listed"))
    listed = listed.select("file_name", "rule_name", F.col("listed.subject").alias("names"))
    out = rule_groups(issues, n).join(depths, ["file_name", "rule_name"], "left").join(listed, ["file_name", "rule_name"], "left")
    out = out.withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    return out.withColumn("more_names", F.col("rule_name").isNotNull() & naming & (F.size("names") < F.col("n_issues")))


def issues_per_file(issues: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` issues of every base name by severity, then order of emission and issue_id; 0 keeps all."""
    rows = issues.withColumn("file_name", basename(F.col("file_path"))).withColumn("severity_rank", severity_rank(F.col("severity")))
    order = Window.partitionBy("file_name").orderBy(F.desc_nulls_last("severity_rank"), "emit_seq", "issue_id")
    out = rows.withColumn("position", F.row_number().over(order))
    return out.where(F.col("position") <= n) if n else out


def severity_sorted(issues: DataFrame) -> DataFrame:
    """All issues in a stable order: worst first, then as emitted."""
    return issues.withColumn("severity_rank", severity_rank(F.col("severity"))).orderBy(F.desc_nulls_last("severity_rank"), "emit_seq", "issue_id")


def harsh(issues: DataFrame) -> DataFrame:
    """Only Nuclear and Spicy issues, for display; scores and shame count all."""
    return issues.where(F.col("severity").isin("Nuclear", "Spicy"))
