"""Queries over the tables source_files and issues: sources, rules, scores, rankings and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lintlake.functions.text import severity_name
from lintlake.operators import rules, scoring, shame, texts
from lintlake.plans.analysis import analyze
from lintlake.plans.oracle import SQL
from lintlake.plans.samples import EXPECTED, sample_issues
from lintlake.session import shared_table, table
from lintlake.sources.files import excluded, is_rust, kept_by_owner, stored_files

QUERIES: dict = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def issue_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct issues (one row an issue_id, of repeated ones the last loaded) with severities under their three names, unknown ones null."""
    columns = ["file_path", "rule_name", "line", "emit_seq", "subject", "message", severity_name(F.col("severity")).alias("severity")]
    rows = table(spark, sf_dir, "issues").groupBy("issue_id").agg(F.max(F.struct("loaded_at", *columns)).alias("last"))
    return rows.select("issue_id", *(f"last.{c}" for c in ("file_path", "rule_name", "line", "emit_seq", "subject", "message", "severity")))


def _with_path(df: DataFrame) -> DataFrame:
    return df.where("file_path is not null")


def _lines(spark: SparkSession, sf_dir: str) -> Column:
    """All lines, as a scalar subquery: nothing runs while the query is put together."""
    return stored_files(spark, sf_dir).agg(F.coalesce(F.sum("line_count"), F.lit(0))).scalar()


# Sources and filters


@_query
def scan_line_metrics(spark, sf_dir):
    files = stored_files(spark, sf_dir)
    return files.agg(F.count("*").alias("n_files"), F.sum("line_count").alias("n_lines"), F.count_if("byte_ok").alias("n_readable"), F.count_if("parse_ok").alias("n_parsed"))


@_query
def file_line_counts(spark, sf_dir):
    return stored_files(spark, sf_dir).select("file_path", "line_count")


@_query
def extension_filter(spark, sf_dir):
    return table(spark, sf_dir, "source_files").where(is_rust(F.col("file_path"))).select("file_path").distinct()


@_query
def exclude_glob_filter(spark, sf_dir):
    patterns = ["vendor/*", "*/generated/*", "target/*", "*.pb.rs", "test_*", "[broken", "(", None]
    return table(spark, sf_dir, "source_files").where(~excluded(F.col("file_path"), patterns)).select("file_path").distinct()


@_query
def exclude_patterns_by_owner(spark, sf_dir):
    """The exclude globs of the table, each owner's by themselves."""
    return kept_by_owner(table(spark, sf_dir, "source_files"), table(spark, sf_dir, "exclude_patterns"))


@_query
def scan_faults(spark, sf_dir):
    """Files that are stored as parsed but can't be scanned, with the reason."""
    return rules.faults(stored_files(spark, sf_dir))


@_query
def harsh_filter(spark, sf_dir):
    return shame.harsh(issue_facts(spark, sf_dir)).select("issue_id", "severity")


# Rules, each by itself


def _rule(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        issues = rules.all_issues(stored_files(spark, sf_dir), [name])
        return issues.select("file_path", "line", "col", "rule_name", "severity", "roast_level", "subject")

    return query


_RULE_NAMES = [
    "terrible-naming", "single-letter-variable", "meaningless-naming", "hungarian-notation", "abbreviation-abuse", "println-debugging", "panic-abuse", "todo-comment", "magic-number", "god-function",
    "commented-code", "dead-code", "string-abuse", "vec-abuse", "iterator-abuse", "match-abuse", "deep-nesting", "long-function", "code-duplication", "unwrap-abuse", "unnecessary-clone",
    "complex-closure", "lifetime-abuse", "trait-complexity", "generic-abuse", "channel-abuse", "async-abuse", "dyn-trait-abuse", "unsafe-abuse", "ffi-abuse", "macro-abuse", "module-complexity",
    "pattern-matching-abuse", "reference-abuse", "box-abuse", "slice-abuse", "file-structure", "import-chaos", "module-nesting",
]
QUERIES |= {"rule_" + name.replace("-", "_"): _rule(name) for name in _RULE_NAMES}


@_query
def rule_line_duplication(spark, sf_dir):
    rows = rules.repeated_lines(rules.Corpus(stored_files(spark, sf_dir)))
    return rows.select("file_path", "line", F.col("subject").cast("long").alias("n_lines"), "severity")


@_query
def rules_on_samples(spark, sf_dir):
    """Every rule over a small source that triggers it: what the stored files don't contain."""
    return sample_issues(spark)


SQL["rules_on_samples"] = EXPECTED


@_query
def all_rules(spark, sf_dir):
    """All 39 rules in one plan, counted by file, rule and severity."""
    return rules.all_issues(stored_files(spark, sf_dir)).groupBy("file_path", "rule_name", "severity").agg(F.count("*").alias("n_issues"))


@_query
def analysis_keys(spark, sf_dir):
    """A whole analysis of the stored files: rows whose key or issue_id is not their own. There are none."""
    keys = analyze(stored_files(spark, sf_dir)).groupBy("file_path", "emit_seq").agg(F.count("*").alias("n"), F.min("issue_id").alias("issue_id"))
    ids = keys.groupBy("issue_id").agg(F.sum("n").alias("rows"), F.count("*").alias("keys"))
    return ids.agg(F.coalesce(F.sum(F.col("rows") - F.col("keys")), F.lit(0)).alias("shared_keys"), F.coalesce(F.sum(F.col("keys") - 1), F.lit(0)).alias("shared_ids"))


@_query
def analysis_score(spark, sf_dir):
    """From the stored files to their score: the rules, then the score over their own lines, without a stored issues table."""
    files = stored_files(spark, sf_dir)
    return scoring.total_scores(analyze(files), _lines(spark, sf_dir)).withColumn("total_score", F.round("total_score", 6))


# Scores


@_query
def severity_distribution(spark, sf_dir):
    return scoring.severity_distribution(issue_facts(spark, sf_dir))


@_query
def severity_by_rule(spark, sf_dir):
    return scoring.severity_distribution(issue_facts(spark, sf_dir), ["rule_name"])


@_query
def issue_density(spark, sf_dir):
    n = issue_facts(spark, sf_dir).agg(F.count("*").alias("n"))
    return n.select(F.round(scoring.density(F.col("n"), _lines(spark, sf_dir)), 6).alias("density"))


@_query
def category_counts(spark, sf_dir):
    return scoring.category_scores(issue_facts(spark, sf_dir), _lines(spark, sf_dir)).select("category", "n_issues")


@_query
def category_scores(spark, sf_dir):
    scores = scoring.category_scores(issue_facts(spark, sf_dir), _lines(spark, sf_dir))
    return scores.withColumn("category_score", F.round("category_score", 6))


@_query
def total_score(spark, sf_dir):
    return scoring.total_scores(issue_facts(spark, sf_dir), _lines(spark, sf_dir)).withColumn("total_score", F.round("total_score", 6))


@_query
def score_per_file(spark, sf_dir):
    lines = stored_files(spark, sf_dir).select("file_path", F.col("line_count").alias("total_lines"))
    out = scoring.total_scores(_with_path(issue_facts(spark, sf_dir)), lines, ["file_path"])
    return out.withColumn("total_score", F.round("total_score", 6))


@_query
def worst_categories(spark, sf_dir):
    scores = scoring.category_scores(issue_facts(spark, sf_dir), _lines(spark, sf_dir))
    return scoring.worst_categories(scores).select("category", F.round("category_score", 6).alias("category_score"))


@_query
def category_status(spark, sf_dir):
    """The band of every category's score and, from 60 on, the remark that the seed picks."""
    scores = scoring.category_scores(issue_facts(spark, sf_dir), _lines(spark, sf_dir))
    status = scoring.score_status(F.col("category_score"))
    return scores.select("category", status.alias("status"), texts.remark(F.col("category"), F.col("category_score"), F.lit(7)).alias("remark"))


@_query
def remark_picks(spark, sf_dir):
    """The remark that every file's own seed, its number of issues, picks for the duplication category."""
    counts = issue_facts(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"))
    return counts.select("file_path", texts.remark(F.lit("duplication"), F.lit(100.0), F.col("n")).alias("remark"))


@_query
def score_suggestions(spark, sf_dir):
    scores = scoring.category_scores(issue_facts(spark, sf_dir), _lines(spark, sf_dir))
    return scoring.score_suggestions(scores).select("category", F.round("category_score", 6).alias("category_score"))


@_query
def base_score(spark, sf_dir):
    return scoring.base_scores(issue_facts(spark, sf_dir)).select(F.round("base_score", 6).alias("base_score"))


@_query
def base_score_breakdown(spark, sf_dir):
    return scoring.base_score_breakdown(issue_facts(spark, sf_dir)).withColumn("weighted", F.round("weighted", 6))


@_query
def raw_category_scores(spark, sf_dir):
    return scoring.raw_category_scores(issue_facts(spark, sf_dir)).withColumn("weighted", F.round("weighted", 6))


@_query
def rule_dim_weights(spark, sf_dir):
    """Weights from the stored dimension instead of the fixed ones: a left lookup with the default 1, after counting, so that it meets one row a rule."""
    dim = table(spark, sf_dir, "rule_dim").groupBy("rule_name").agg(F.coalesce(F.max("weight"), F.lit(1.0)).alias("weight"))
    counts = issue_facts(spark, sf_dir).groupBy("rule_name").agg(F.count("*").alias("n_issues"))
    weighted = F.col("n_issues") * F.coalesce("weight", F.lit(1.0))
    return counts.join(dim, "rule_name", "left").select("rule_name", "n_issues", F.round(weighted, 6).alias("weighted"))


@_query
def density_penalty(spark, sf_dir):
    counts = issue_facts(spark, sf_dir).groupBy("file_path").agg(F.count("*").alias("n"))
    rows = counts.join(stored_files(spark, sf_dir).where("line_count > 0"), "file_path")
    return rows.select("file_path", scoring.density_penalty(F.col("n"), F.lit(1), F.col("line_count")).alias("penalty"))


@_query
def severity_penalty(spark, sf_dir):
    counts = scoring.severity_distribution(issue_facts(spark, sf_dir), ["file_path"])
    return counts.select("file_path", scoring.severity_penalty(F.col("n_nuclear"), F.col("n_spicy"), F.col("n_mild")).alias("penalty"))


# Rankings


@_query
def shame_entries(spark, sf_dir):
    return shame.shame_entries(issue_facts(spark, sf_dir))


@_query
def shame_top10(spark, sf_dir):
    return shame.top_entries(shame.shame_entries(_with_path(issue_facts(spark, sf_dir)))).select("file_path", "shame_score")


@_query
def worst_offenses(spark, sf_dir):
    return shame.worst_offenses(issue_facts(spark, sf_dir)).select("file_path", "rule_name", "severity")


@_query
def pattern_stats(spark, sf_dir):
    return shame.pattern_stats(issue_facts(spark, sf_dir))


@_query
def pattern_examples(spark, sf_dir):
    return shame.pattern_examples(issue_facts(spark, sf_dir))


@_query
def top_patterns(spark, sf_dir):
    stats = shame.pattern_stats(issue_facts(spark, sf_dir).where("rule_name is not null"))
    return shame.top_patterns(stats).select("rule_name", "n_issues")


@_query
def shame_density(spark, sf_dir):
    return shame.shame_density(issue_facts(spark, sf_dir), stored_files(spark, sf_dir)).withColumn("density", F.round("density", 6))


@_query
def shame_families(spark, sf_dir):
    return shame.family_counts(issue_facts(spark, sf_dir))


@_query
def shame_heatmap(spark, sf_dir):
    return shame.heatmap(shame.shame_entries(issue_facts(spark, sf_dir)))


@_query
def anonymous_stats(spark, sf_dir):
    return shame.anonymous_stats(_with_path(issue_facts(spark, sf_dir)))


@_query
def improvement_suggestions(spark, sf_dir):
    facts = issue_facts(spark, sf_dir).where("rule_name is not null")
    density = shame.shame_density(facts, stored_files(spark, sf_dir)).select("density").scalar()
    return shame.improvement_suggestions(shame.pattern_stats(facts), density)


@_query
def top_files(spark, sf_dir):
    return shame.top_files(_with_path(issue_facts(spark, sf_dir)))


@_query
def rule_groups_per_file(spark, sf_dir):
    return shame.rule_groups(issue_facts(spark, sf_dir).where("file_path is not null and rule_name is not null"), 5)


@_query
def rule_groups_by_count(spark, sf_dir):
    return shame.rule_groups(issue_facts(spark, sf_dir).where("file_path is not null and rule_name is not null"), by_count=True).drop("worst")


@_query
def rule_group_details(spark, sf_dir):
    """The rule groups of every base name with their first names and the range of their depths."""
    rows = shame.group_details(issue_facts(spark, sf_dir).where("file_path is not null and rule_name is not null"))
    return rows.select("file_name", "rule_name", "n_issues", "worst", "least_depth", "greatest_depth", F.array_join("names", ", ").alias("names"), "more_names")


@_query
def issues_per_file_topn(spark, sf_dir):
    return shame.issues_per_file(_with_path(issue_facts(spark, sf_dir))).select("file_name", "issue_id", "position")


@_query
def severity_sorted_issues(spark, sf_dir):
    """The global order with positions: range-sorted and written once, so that the places inside the partitions stay; positions by counts of the partitions before."""
    rows = shame.severity_sorted(issue_facts(spark, sf_dir)).select("issue_id", "severity_rank", F.monotonically_increasing_id().alias("id"))
    rows = shared_table(rows, "sorted").withColumn("part", F.shiftright("id", 33))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))  # one row a partition
    joined = rows.join(F.broadcast(before), "part")
    return joined.select("issue_id", "severity_rank", (F.col("id") - F.shiftleft("part", 33) + F.coalesce("before", F.lit(0)) + 1).alias("position"))


@_query
def distinct_rules(spark, sf_dir):
    return table(spark, sf_dir, "issues").select("rule_name").distinct()


@_query
def distinct_files(spark, sf_dir):
    return table(spark, sf_dir, "issues").agg(F.count_distinct("file_path").alias("n_files"))


@_query
def rule_counts(spark, sf_dir):
    return issue_facts(spark, sf_dir).groupBy("rule_name").agg(F.count("*").alias("n_issues"))


# Texts

_SQL_TOPICS = ", ".join(f"('{rule}', '{topic}')" for rule, (topic, _) in texts.TOPICS.items())


@_query
def advice_join(spark, sf_dir):
    return texts.advice_for(table(spark, sf_dir, "issues").select("rule_name").distinct())


SQL["advice_join"] = f"""with advice(rule_name, why_bad, how_to_fix) as (values {", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (r, *t)) + ")" for r, t in texts.ADVICE.items())})
    select distinct rule_name, why_bad, how_to_fix from issues join advice using (rule_name)"""


@_query
def i18n_fallback(spark, sf_dir):
    keys = spark.createDataFrame([("title",), ("score",), ("no_such_key",)], "key string")
    labels = texts.labels_dim(spark).where("not (lang = 'zh-CN' and key = 'score')")
    return texts.translate(keys, labels, "zh-CN")


SQL["i18n_fallback"] = "select * from (values ('title', '代码质量报告'), ('score', 'Score'), ('no_such_key', 'Missing translation: no_such_key')) as t(key, text)"


@_query
def message_pool_pick(spark, sf_dir):
    """The text that stands for each issue in a listing: of its rule's pool the entry by line number."""
    text = texts.pick(texts.message_pool(F.col("rule_name"), "en-US"), F.coalesce("line", F.lit(0)))
    return issue_facts(spark, sf_dir).select("issue_id", text.alias("text"))


SQL["message_pool_pick"] = f"""with topics(rule_name, topic) as (values {_SQL_TOPICS}), f as (select issue_id, any_value(rule_name) as rule_name, coalesce(any_value(line), 0) as line from issues group by issue_id)
    select issue_id, case when topic is null then 'Worth a look' when line % 3 = 0 then 'Here is ' || topic when line % 3 = 1 then 'This looks like ' || topic else 'Worth a second look: ' || topic end as text from f left join topics using (rule_name)"""
