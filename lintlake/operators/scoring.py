"""Scores of a corpus from its issues: distributions, densities, category scores, the weighted total and its level.

``issues`` needs file_path, rule_name and severity (Nuclear, Spicy, Mild or null). Counts are aggregations with map-side combination; what follows works on at most
seven categories a group. Functions with ``by`` score every group of those columns, without it the whole table as one group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.operators.dims import CATEGORIES, RULE_WEIGHTS, SEVERITY_WEIGHTS, category_of, lookup


def _count(severity: str) -> Column:
    return F.count_if(F.col("severity") == severity)


def severity_distribution(issues: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return issues.groupBy(*by).agg(F.count("*").alias("n_issues"), _count("Nuclear").alias("n_nuclear"), _count("Spicy").alias("n_spicy"), _count("Mild").alias("n_mild"))


def density(n: Column, lines: Column) -> Column:
    """Issues in a thousand lines; 0 without lines."""
    return F.when(lines > 0, n / lines * 1000).otherwise(0.0)


def category_score(d: Column, good: float, average: float, poor: float) -> Column:
    """0 (nothing found) to 90, by the limits good, average and poor of the category."""
    return (
        F.when(d <= 0, 0.0)
        .when(d <= good, d / good * 20)
        .when(d <= average, (d - good) / (average - good) * 20 + 20)
        .when(d <= poor, (d - average) / (poor - average) * 20 + 40)
        .otherwise(F.least((d - poor) * 2 + 60, F.lit(90.0)))
    )


def quality_level(score: Column) -> Column:
    whole = score.cast("int")
    return F.when(whole <= 20, "Excellent").when(whole <= 40, "Good").when(whole <= 60, "Average").when(whole <= 80, "Poor").otherwise("Terrible")


def score_status(score: Column) -> Column:
    """The band that a category's score falls in, as shown beside it; scores beyond 100 fall in none of the named bands and get the last one."""
    whole = score.cast("int")
    bands = F.when(whole.between(81, 100), "Terrible, urgent fixes needed").when(whole.between(61, 80), "Poor, refactoring recommended")
    bands = bands.when(whole.between(41, 60), "Average, needs improvement").when(whole.between(21, 40), "Good, room for improvement")
    return bands.otherwise("Excellent, keep it up")


def _wide(issues: DataFrame, lines: DataFrame | Column | int, by: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """One row a group with all counts in a single aggregation, and per category the expression of its score."""
    counts = [F.count_if(F.col("rule_name").isin(v[4])).alias(f"in_{name}") for name, v in CATEGORIES.items()]
    rows = issues.groupBy(*by).agg(F.count("*").alias("n_all"), *counts)
    if isinstance(lines, DataFrame):
        rows = rows.join(lines.select(*by, "total_lines"), by, "left")
    else:
        rows = rows.withColumn("total_lines", lines if isinstance(lines, Column) else F.lit(lines))
    # densities are columns of their own: a score names its density many times
    dense = [density(F.col(f"`in_{name}`"), F.coalesce("total_lines", F.lit(0))).alias(f"d_{name}") for name in CATEGORIES]
    rows = rows.select(*by, "n_all", *(F.col(f"`in_{name}`") for name in CATEGORIES), *dense)
    return rows, {name: category_score(F.col(f"`d_{name}`"), good, average, poor) for name, (_, good, average, poor, _) in CATEGORIES.items()}


def category_scores(issues: DataFrame, lines: DataFrame | Column | int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, category, category_weight, n_issues, category_score of all seven categories of every group, those without issues too.

    ``lines``: total lines (a number or a scalar column), or a table (by, total_lines) where groups are scored. Issues of rules outside the categories don't count here.
    """
    rows, scores = _wide(issues, lines, by)
    each = [
        F.struct(F.lit(name).alias("category"), F.lit(CATEGORIES[name][0]).alias("category_weight"), F.col(f"`in_{name}`").alias("n_issues"), score.alias("category_score"))
        for name, score in scores.items()
    ]
    return rows.select(*by, F.inline(F.array(*each)))


def total_scores(issues: DataFrame, lines: DataFrame | Column | int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """by, total_score and quality_level of every group that has issues; without ``by`` one row, for an empty table 100 and Excellent."""
    rows, scores = _wide(issues, lines, by)
    total = sum((score * CATEGORIES[name][0] for name, score in scores.items()), F.lit(0.0)) / sum(v[0] for v in CATEGORIES.values())
    out = rows.select(*by, F.when(F.col("n_all") == 0, 100.0).otherwise(total).alias("total_score"), "n_all")
    level = F.when(F.col("n_all") == 0, "Excellent").otherwise(quality_level(F.col("total_score")))
    return out.withColumn("quality_level", level).drop("n_all")


def worst_categories(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy(F.desc("category_score"), "category").limit(n)


# Scores that only count weights, optional beside the total.


def issue_weight(weights: dict[str, float] = RULE_WEIGHTS) -> Column:
    return lookup(F.col("rule_name"), weights) * lookup(F.col("severity"), SEVERITY_WEIGHTS)


def base_scores(issues: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """The sum of rule weight times severity weight; rules and severities without a weight count 1."""
    return issues.groupBy(*by).agg(F.coalesce(F.sum(issue_weight()), F.lit(0.0)).alias("base_score"))


def base_score_breakdown(issues: DataFrame, n: int = 10) -> DataFrame:
    out = issues.groupBy("rule_name").agg(F.count("*").alias("n_issues"), F.sum(issue_weight()).alias("weighted"))
    return out.orderBy(F.desc("weighted"), "rule_name").limit(n)


def raw_category_scores(issues: DataFrame) -> DataFrame:
    found = issues.withColumn("category", category_of(F.col("rule_name"))).where("category is not null")
    return found.groupBy("category").agg(F.sum(issue_weight()).alias("weighted"))


def density_penalty(n: Column, files: Column, lines: Column) -> Column:
    d = n / lines * 1000
    per_file = n / files
    by_lines = F.when(d > 50, 25.0).when(d > 30, 15.0).when(d > 20, 10.0).when(d > 10, 5.0).otherwise(0.0)
    by_files = F.when(per_file > 20, 15.0).when(per_file > 10, 10.0).when(per_file > 5, 5.0).otherwise(0.0)
    return F.when((files > 0) & (lines > 0), by_lines + by_files).otherwise(0.0)


def severity_penalty(nuclear: Column, spicy: Column, mild: Column) -> Column:
    return F.when(nuclear > 0, (nuclear - 1) * 5 + 20.0).otherwise(0.0) + F.when(spicy > 5, (spicy - 5) * 2.0).otherwise(0.0) + F.when(mild > 20, (mild - 20) * 0.5).otherwise(0.0)


def score_suggestions(scores: DataFrame, n: int = 3, above: float = 60.0) -> DataFrame:
    """The worst categories above a score, as what to work on first."""
    return worst_categories(scores.where(F.col("category_score") > above), n)
