"""python -m lintlake PATH: reports on the Rust files at a path. The exit code is 0 whatever is found."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lintlake.plans.analysis import report_on_path
from lintlake.plans.report import Options


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lintlake", description=__doc__)
    p.add_argument("path", nargs="?", default=".")
    p.add_argument("-e", "--exclude", action="append", default=[], help="glob of paths to leave out, may be repeated")
    p.add_argument("-l", "--lang", default="en-US")
    p.add_argument("-t", "--top", type=int, default=5, help="files with the most issues, 0 for none")
    p.add_argument("-i", "--issues", type=int, default=5, help="rules (Markdown: issues) listed for a file, 0 for all")
    p.add_argument("--seed", type=int, default=0, help="which of the remarks about a category is picked")
    for flag in ("verbose", "summary", "markdown", "harsh", "advice", "hall-of-shame", "suggestions"):
        p.add_argument(f"--{flag}", action="store_true")
    a = vars(p.parse_args(argv))
    path, exclude = a.pop("path"), a.pop("exclude")
    lang = a["lang"].lower().replace("_", "-")
    a["lang"] = {"en": "en-US", "en-us": "en-US", "english": "en-US", "zh": "zh-CN", "zh-cn": "zh-CN", "chinese": "zh-CN"}.get(lang, a["lang"])
    spark = SparkSession.builder.appName("lintlake").config("spark.ui.enabled", "false").getOrCreate()
    print(report_on_path(spark, path, exclude, Options(**a)))


if __name__ == "__main__":
    main()
