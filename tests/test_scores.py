import pytest
from pyspark.sql import functions as F

from lintlake.operators import dims, scoring, shame, texts
from lintlake.plans.report import Options, Report

SCHEMA = "issue_id long, file_path string, rule_name string, severity string, line int, emit_seq long, message string"


def table(spark, rows):
    return spark.createDataFrame([(i, f, r, s, i, i, f"m{i}") for i, (f, r, s) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("d", "score"), [(0, 0), (2, 20), (5, 40), (10, 60), (11, 62), (25, 90), (40, 90)])
def test_score_of_a_category(spark, d, score):
    issues = table(spark, [("a.rs", "terrible-naming", "Mild")] * d)
    got = {r.category: r.category_score for r in scoring.category_scores(issues, 1000).collect()}
    assert got["naming"] == pytest.approx(score) and got["structure"] == 0


def test_total_of_the_worked_example(spark):
    rows = [("a.rs", r, "Mild") for r in ["terrible-naming", "deep-nesting", "code-duplication", "macro-abuse"] for _ in range(30)]
    (row,) = scoring.total_scores(table(spark, rows), 100).collect()
    assert row.total_score == pytest.approx(63.0) and row.quality_level == "Poor"


def test_without_issues_the_total_is_100_and_excellent(spark):
    (row,) = scoring.total_scores(table(spark, []), 100).collect()
    assert (row.total_score, row.quality_level) == (100.0, "Excellent")


@pytest.mark.parametrize(("score", "level"), [(20.9, "Excellent"), (21.0, "Good"), (60.99, "Average"), (80.9, "Poor"), (81.0, "Terrible")])
def test_levels_cut_off_decimals(spark, score, level):
    assert spark.range(1).select(scoring.quality_level(F.lit(score))).first()[0] == level


def test_no_lines_no_score(spark):
    assert all(r.category_score == 0 for r in scoring.category_scores(table(spark, [("a.rs", "macro-abuse", "Mild")]), 0).collect())


def test_penalties(spark):
    one = spark.range(1)
    assert one.select(scoring.severity_penalty(F.lit(2), F.lit(7), F.lit(22))).first()[0] == 30.0
    assert one.select(scoring.density_penalty(F.lit(60), F.lit(5), F.lit(1000))).first()[0] == 35.0
    assert one.select(scoring.density_penalty(F.lit(60), F.lit(0), F.lit(0))).first()[0] == 0.0


def test_shame(spark):
    rows = [("d/a.rs", "x", s) for s in ["Nuclear"] * 2 + ["Spicy"] * 3 + ["Mild"] * 4] + [("d/b.rs", "x", None), ("e/a.rs", "y", "Mild")]
    issues = table(spark, rows)
    entries = shame.shame_entries(issues)
    assert {r.file_path: r.shame_score for r in entries.collect()} == {"d/a.rs": 33.0, "d/b.rs": 0.0, "e/a.rs": 1.0}
    assert [tuple(r) for r in shame.top_files(issues, 2).collect()] == [("a.rs", 10), ("b.rs", 1)] and shame.top_files(issues, 0).count() == 0
    assert {r.directory: r.shame_score for r in shame.heatmap(entries).collect()} == {"d": 33.0, "e": 1.0}
    assert [r.rule_name for r in shame.rule_groups(issues, 1).where("file_name = 'a.rs'").collect()] == ["x"]


def test_families(spark):
    names = ["terrible-naming", "deep-nesting", "unwrap-abuse", "println-debugging", "file-too-long", "magic-number", "other"]
    got = [spark.range(1).select(dims.family_of(F.lit(n))).first()[0] for n in names]
    assert got == ["Naming Issues", "Complexity Issues", "Rust-specific Issues", "Student Code Issues", "Structure Issues", "Code Smells", "Other Issues"]


def test_suggestions_have_a_default(spark):
    assert [r.position for r in shame.improvement_suggestions(shame.pattern_stats(table(spark, []))).collect()] == [1]
    assert shame.improvement_suggestions(shame.pattern_stats(table(spark, [("a", "unwrap-abuse", "Mild")])), 51).count() == 2


def test_every_rule_has_a_topic_in_both_languages(spark):
    from lintlake.operators import rules

    emitted = {reported for spec in rules.rules().values() for reported, _ in spec.emissions} | {"commented-code", "dead-code"}
    assert emitted <= set(texts.TOPICS) and len(texts.TOPICS) == 40 and len(texts.ADVICE) == 20


@pytest.mark.parametrize("options", [Options(), Options(lang="zh-CN", markdown=True, verbose=True), Options(harsh=True, advice=True, hall_of_shame=True, suggestions=True), Options(summary=True), Options(top=0, issues=0, lang="fr")])
def test_reports_hold_what_they_should(spark, options):
    issues = table(spark, [("d/a.rs", "unwrap-abuse", "Nuclear"), ("d/a.rs", "todo-comment", "Mild"), ("b.rs", "unwrap-abuse", "Spicy")])
    files = spark.createDataFrame([("d/a.rs", 10), ("b.rs", 10), ("c.rs", 5)], "file_path string, line_count long")
    text = Report(issues, files, options).text()
    assert "25" in text
    if options.harsh:
        assert "todo-comment" not in text.split("Worst files")[0]
    if not options.summary:
        assert "a.rs" in text
    if options.markdown:
        assert "| --- |" in text and "问题" in text


def test_report_on_nothing(spark):
    files = spark.createDataFrame([], "file_path string, line_count long")
    assert "Nothing found" in Report(table(spark, []), files, Options()).text()


@pytest.mark.parametrize(("score", "band"), [(0, "Excellent"), (20.9, "Excellent"), (21, "Good"), (41.5, "Average"), (61, "Poor"), (81, "Terrible"), (100, "Terrible"), (101, "Excellent")])
def test_bands_of_scores(spark, score, band):
    assert spark.range(1).select(scoring.score_status(F.lit(float(score)))).first()[0].startswith(band)


def test_remarks_depend_on_the_seed_alone(spark):
    pick = lambda seed, name, score=60.0, lang="en-US": spark.range(1).select(texts.remark(F.lit(name), F.lit(score), F.lit(seed), lang)).first()[0]
    assert {pick(i, "naming") for i in range(12)} == set(texts.REMARKS["naming"]["en-US"])
    assert pick(3, "naming") == pick(3, "naming") and pick(3, "naming", 59.9) is None
    assert pick(1, "structure") == "Code needs improvement" and pick(1, "structure", lang="zh-CN") == "代码需要改进" and pick(1, "structure", lang="fr") == "Code needs improvement"


def test_groups_name_names_and_depths(spark):
    rows = [("d/a.rs", "terrible-naming", "Spicy", f"n{i}", "") for i in range(7)] + [("a.rs", "deep-nesting", "Mild", d, m) for d, m in (("4", ""), (None, "too deep (depth: 9)"), ("x", "no number"), (None, None))]
    rows += [("a.rs", "single-letter-variable", None, "q", ""), ("a.rs", "magic-number", "Mild", "42", "depth: 3"), ("a.rs", None, "Mild", None, None)]
    df = spark.createDataFrame([(i, *r[:3], 1, i, *r[3:]) for i, r in enumerate(rows)], "issue_id long, file_path string, rule_name string, severity string, line int, emit_seq long, subject string, message string")
    got = {r.rule_name: (r.n_issues, r.worst, r.least_depth, r.greatest_depth, r.names, r.more_names) for r in shame.group_details(df).collect()}
    assert got["terrible-naming"] == (7, 2, None, None, ["n0", "n1", "n2", "n3", "n4"], True) and got["deep-nesting"] == (4, 1, 4, 9, [], False)
    assert got["single-letter-variable"] == (1, None, None, None, ["q"], False) and got["magic-number"] == (1, 1, None, None, [], False)
    assert shame.group_details(df.limit(0)).collect() == []
    text = Report(df.where("rule_name is not null"), spark.createDataFrame([("a.rs", 10)], "file_path string, line_count long"), Options()).text()
    assert "terrible-naming: 7 (notable, n0, n1, n2, n3, n4, ...)" in text and "deep-nesting: 4 (minor, depth 4-9)" in text and "81-100" in text
