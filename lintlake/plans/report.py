"""Reports: small aggregates brought to the driver and written as text or Markdown."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintlake.functions.text import SEVERITIES, progress_bar
from lintlake.operators import scoring, shame
from lintlake.operators.texts import ADVICE, LABELS, LANGUAGES, LEGEND, message_pool, pick, remark
from lintlake.session import shared_table


@dataclass
class Options:
    lang: str = "en-US"
    top: int = 5
    issues: int = 5
    harsh: bool = False
    verbose: bool = False
    summary: bool = False
    markdown: bool = False
    advice: bool = False
    hall_of_shame: bool = False
    suggestions: bool = False
    seed: int = 0


class Report:
    """A report on an issues table (file_path, rule_name, severity, line, emit_seq, issue_id) over ``files`` (file_path, line_count).

    Score, density and rankings count all issues; ``harsh`` only narrows what is listed. What reaches the driver is bounded by the limits of the options
    and by the rules and categories, but for the listing by file, whose length is that of the report itself.
    """

    def __init__(self, issues: DataFrame, files: DataFrame, options: Options) -> None:
        self.o = options
        self.issues = shared_table(issues, "issues")
        self.files = files
        total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("lines")).first()
        self.n_files, self.lines = total["n"], int(total["lines"])
        self.counts = scoring.severity_distribution(self.issues).first()
        self.score = scoring.total_scores(self.issues, self.lines).first()
        self.shown = shame.harsh(self.issues) if options.harsh else self.issues

    def label(self, key: str) -> str:
        i = LANGUAGES.index(self.o.lang) if self.o.lang in LANGUAGES else 0
        return LABELS[key][i] if key in LABELS else f"Missing translation: {key}"

    def heading(self, text: str, level: int = 2) -> str:
        return f"{'#' * level} {text}" if self.o.markdown else f"{text}\n{'-' * len(text)}"

    def table(self, names: list[str], rows: list) -> list[str]:
        cells = [[str(round(v, 2) if isinstance(v, float) else v) for v in r] for r in rows]
        if self.o.markdown:
            return ["| " + " | ".join(names) + " |", "|" + " --- |" * len(names), *("| " + " | ".join(r) + " |" for r in cells), ""]
        return [*("  " + "  ".join(r) for r in cells), ""]

    def summary_part(self) -> list[str]:
        c, label = self.counts, self.label
        rows = [(label("files"), self.n_files), (label("lines"), self.lines), (label("nuclear_issues"), c["n_nuclear"]), (label("spicy_issues"), c["n_spicy"]), (label("mild_issues"), c["n_mild"])]
        rows += [(label("total"), c["n_issues"]), (label("density"), c["n_issues"] / self.lines * 1000 if self.lines else 0.0), (label("score"), f"{self.score['total_score']:.1f} ({self.score['quality_level']})")]
        out = [self.heading(label("summary")), *self.table(["", ""], rows)]
        if not c["n_issues"]:
            return out
        column = F.col("category_score")
        scores = scoring.category_scores(self.issues, self.lines).orderBy("category")
        said = remark(F.col("category"), column, F.lit(self.o.seed), self.o.lang)
        cells = scores.select("category", column, progress_bar(column).alias("bar"), scoring.score_status(column).alias("status"), F.coalesce(said, F.lit("")).alias("remark")).collect()
        second = int(self.o.lang == LANGUAGES[1])
        named = {english: (english, chinese)[second] for _, english, chinese in LEGEND}
        out += [self.heading(label("categories"), 3), *self.table([label("categories"), label("score"), "", label("status"), ""], [(*r[:3], named[r["status"]], r["remark"]) for r in cells])]
        return [*out, self.heading(label("legend"), 3), *self.table([label("score"), label("status")], [(band, texts[second]) for band, *texts in LEGEND])]

    def files_part(self) -> list[str]:
        out = []
        if self.o.top:
            out += [self.heading(self.label("top_files")), *self.table([self.label("files"), self.label("total")], shame.top_files(self.shown, self.o.top).collect())]
        if self.o.verbose:
            rows = self.shown.groupBy("rule_name").count().orderBy(F.desc("count"), "rule_name").collect()
            out += [self.heading(self.label("statistics")), *self.table([self.label("rule"), self.label("total")], rows)]
        return out

    def issues_part(self) -> list[str]:
        out = [self.heading(self.label("detailed_analysis"))]
        if self.o.markdown:
            listed = shame.issues_per_file(self.shown, self.o.issues)
            listed = listed.withColumn("text", pick(message_pool(F.col("rule_name"), self.o.lang), F.coalesce("line", F.lit(0))))
            rows = listed.orderBy("file_name", "position").select("file_name", "severity", "rule_name", "line", "text")
        else:
            rows = shame.group_details(self.shown, self.o.issues).orderBy("file_name", "position")
        last = None
        for row in rows.toLocalIterator():
            if row["file_name"] != last:
                last = row["file_name"]
                out.append(f"### {last}" if self.o.markdown else f"{last}:")
            out.append(f"- **{row['severity']}** {row['rule_name']}, {row['line']}: {row['text']}" if self.o.markdown else self.group_line(row))
        return [*out, ""]

    def group_line(self, row) -> str:
        """One rule of a file: how often, how bad at worst, and the names or depths that it is about."""
        low, high, names = row["least_depth"], row["greatest_depth"], ", ".join([*row["names"], *(["..."] if row["more_names"] and row["names"] else [])])
        depths = "" if low is None else f"{self.label('depth')} {low}" if low == high else f"{self.label('depth')} {low}-{high}"
        worst = {rank: name for name, rank in SEVERITIES.items()}.get(row["worst"])
        about = ", ".join(x for x in (self.label(f"{worst.lower()}_issues") if worst else "", depths or names) if x)
        return f"  {row['rule_name']}: {row['n_issues']}" + (f" ({about})" if about else "")

    def shame_part(self) -> list[str]:
        entries = shame.top_entries(shame.shame_entries(self.issues), 5).select("file_path", "n_issues", "n_nuclear", "shame_score").collect()
        patterns = shame.top_patterns(shame.pattern_stats(self.issues), 5).select("rule_name", "n_issues", "n_files").collect()
        out = [self.heading(self.label("hall_of_shame")), *self.table([self.label("files"), self.label("total"), self.label("nuclear_issues"), self.label("score")], entries)]
        return [*out, self.heading(self.label("patterns")), *self.table([self.label("rule"), self.label("total"), self.label("files")], patterns)]

    def suggestions_part(self) -> list[str]:
        density = shame.shame_density(self.issues, self.files).first()["density"]
        rows = shame.improvement_suggestions(shame.pattern_stats(self.issues), density).orderBy("position").collect()
        return [self.heading(self.label("suggestions")), *(f"- {r['suggestion']}" for r in rows), ""]

    def advice_part(self) -> list[str]:
        names = sorted(r[0] for r in self.shown.where(F.col("rule_name").isin(list(ADVICE))).select("rule_name").distinct().collect())
        return [self.heading(self.label("advice")), *(f"- {n}: {' '.join(ADVICE[n])}" for n in names), ""]

    def text(self) -> str:
        o = self.o
        title = self.heading(self.label("title"), 1)
        if not self.counts["n_issues"]:
            return "\n".join([title, "", self.label("clean_code"), self.label("clean_code_warning")])
        if o.summary:
            return "\n".join([title, "", *self.summary_part()])
        parts = [title, "", *self.files_part(), *self.issues_part()]
        parts += self.advice_part() if o.advice else []
        parts += self.shame_part() if o.hall_of_shame else []
        parts += self.suggestions_part() if o.suggestions else []
        return "\n".join([*parts, *self.summary_part(), *([] if o.suggestions else [self.label("keep_improving")])])
