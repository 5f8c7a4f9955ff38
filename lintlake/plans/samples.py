"""Small sources that trigger each rule, one a file below a folder of the reported name: what the stored tables may not contain is run here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.operators.rules import all_issues
from lintlake.sources.files import FILE_SCHEMA


def _many(part: str, n: int, of: str = "fn f() {{ {} }}") -> str:
    return of.format(part * n)


def _listed(part: str, n: int, of: str, between: str = ", ") -> str:
    return of.format(between.join(part.format(i) for i in range(n)))


_NESTED_MODULES = "mod a { mod b { mod c { mod d { mod e { mod f {} } } } } }"
SAMPLES = [
    ("terrible-naming", "fn f() { let data = temp; }"), ("single-letter-variable", "fn f() { let a = 1; let i = 2; }"), ("meaningless-naming", "fn f() { let foo = thing; }"),
    ("hungarian-notation", "fn f() { let strName = iCount; let g_data = nValue; }"), ("abbreviation-abuse", "fn f() { let mgr = cfg_path; }"),
    ("println-debugging", _many('println!("a"); ', 6)), ("panic-abuse", _many('panic!("a"); ', 3)), ("panic-abuse", _many("x.unwrap(); ", 4)), ("todo-comment", "// TODO\n" * 11),
    ("magic-number", "fn f() { a(7, 1001, 100, 0xff); }"), ("god-function", _many("if a { b(); } ", 9)), ("commented-code", "// let a = b;\n// let c = d;\n// return a;\nfn f() {}\n"), ("dead-code", "fn f() { return 1; }\n// return;\n"),
    ("string-abuse", "struct S { a: String }\nfn f() { a.to_string(); }"), ("vec-abuse", _many("Vec::new(); ", 4)), ("iterator-abuse", "fn f() { for x in y {} for (a, b) in c {} }"), ("match-abuse", "fn f() { match x { Ok(a) => a, Err(b) => b } }"),
    ("deep-nesting", "fn f() " + "{" * 9 + "}" * 9), ("long-function", "fn f() {\n" + "a();\n" * 60 + "}"), ("code-duplication", "let first = second();\n" * 5), ("code-duplication", "fn f() { if a { let x = b; } if c { let y = d; } }"),
    ("unwrap-abuse", _many("x.unwrap(); ", 6)), ("unnecessary-clone", _many("x.clone(); ", 5)), ("complex-closure", "fn f() { a(|x| b(|y| c(|z| d))); e(|a, b, c, d, e, f| 1); }"),
    ("lifetime-abuse", _listed("'l{}", 7, "fn f<{}>() {{}}")), ("trait-complexity", _many("fn f(); ", 11, "trait T<A, B, C, D> {{ {} }}")), ("generic-abuse", "struct S<A, B, C, D, X, Y>(A);"),
    ("channel-abuse", _listed("a{}: Sender<u8>", 6, "fn f({}) {{}}")), ("async-abuse", _many("async { 1 }; ", 11)), ("async-abuse", _many("x.await; ", 22)), ("dyn-trait-abuse", _listed("a{}: &dyn T", 6, "fn f({}) {{}}")),
    ("unsafe-abuse", _many("unsafe { a() } ", 4)), ("unsafe-abuse", "unsafe fn a() {}\nunsafe fn b() {}\n"), ("ffi-abuse", 'extern "C" { fn a(); }\n' * 3 + "// libloading"), ("ffi-abuse", _many("fn a(); ", 11, 'extern "C" {{ {} }}')),
    ("macro-abuse", _many("m!(a); ", 12)), ("module-complexity", _NESTED_MODULES), ("pattern-matching-abuse", _listed("{0} => {0}", 11, "fn f() {{ match x {{ {} }} }}")), ("reference-abuse", _listed("a{}: &T", 21, "fn f({}) {{}}")),
    ("box-abuse", _many("Box::new(1); ", 9)), ("slice-abuse", _listed("a{}: &[T]", 16, "fn f({}) {{}}")), ("file-too-long", "\n" * 2001), ("unordered-imports", "use b;\nuse a;\nuse b;\n"), ("duplicate-imports", "use a;\nuse b;\nuse b;\n"), ("deep-module-nesting", _NESTED_MODULES),
]


def sample_issues(spark: SparkSession) -> DataFrame:
    """sample (the number of the source in SAMPLES), rule_name, severity and number of the rows of the rule that the source is for."""
    rows = [(f"{name}/{i}.rs", text, text.count("\n"), True, True) for i, (name, text) in enumerate(SAMPLES)]
    issues = all_issues(spark.createDataFrame(rows, FILE_SCHEMA))
    own = issues.where(F.col("rule_name") == F.substring_index("file_path", "/", 1))
    return own.groupBy(F.regexp_extract("file_path", r"(\d+)\.rs$", 1).cast("int").alias("sample"), "rule_name", "severity").agg(F.count("*").alias("n_issues"))


# What each source gives, counted by hand: sample, rule, severity, rows.
EXPECTED = """select * from (values (0, 'terrible-naming', 'Spicy', 4), (1, 'single-letter-variable', 'Mild', 1), (2, 'meaningless-naming', 'Spicy', 1), (2, 'meaningless-naming', 'Mild', 1),
    (3, 'hungarian-notation', 'Mild', 2), (4, 'abbreviation-abuse', 'Mild', 2), (5, 'println-debugging', 'Spicy', 1), (6, 'panic-abuse', 'Nuclear', 1), (7, 'panic-abuse', 'Spicy', 1), (8, 'todo-comment', 'Spicy', 1),
    (9, 'magic-number', 'Mild', 2), (9, 'magic-number', 'Spicy', 1), (10, 'god-function', 'Mild', 1), (11, 'commented-code', 'Mild', 1), (12, 'dead-code', 'Mild', 2), (13, 'string-abuse', 'Mild', 2), (14, 'vec-abuse', 'Mild', 1),
    (15, 'iterator-abuse', 'Mild', 1), (16, 'match-abuse', 'Mild', 2), (17, 'deep-nesting', 'Mild', 3), (17, 'deep-nesting', 'Spicy', 2), (17, 'deep-nesting', 'Nuclear', 1), (18, 'long-function', 'Mild', 1),
    (19, 'code-duplication', 'Nuclear', 1), (20, 'code-duplication', 'Spicy', 1), (21, 'unwrap-abuse', 'Mild', 2), (21, 'unwrap-abuse', 'Spicy', 3), (21, 'unwrap-abuse', 'Nuclear', 1), (22, 'unnecessary-clone', 'Spicy', 2),
    (23, 'complex-closure', 'Spicy', 1), (23, 'complex-closure', 'Mild', 1), (24, 'lifetime-abuse', 'Spicy', 2), (25, 'trait-complexity', 'Spicy', 1), (25, 'trait-complexity', 'Mild', 1),
    (26, 'generic-abuse', 'Spicy', 1), (26, 'generic-abuse', 'Mild', 6), (27, 'channel-abuse', 'Spicy', 1), (28, 'async-abuse', 'Spicy', 1), (29, 'async-abuse', 'Mild', 2), (30, 'dyn-trait-abuse', 'Spicy', 1),
    (31, 'unsafe-abuse', 'Spicy', 3), (31, 'unsafe-abuse', 'Nuclear', 1), (32, 'unsafe-abuse', 'Nuclear', 1), (33, 'ffi-abuse', 'Spicy', 2), (34, 'ffi-abuse', 'Spicy', 1), (35, 'macro-abuse', 'Mild', 2),
    (36, 'module-complexity', 'Spicy', 1), (37, 'pattern-matching-abuse', 'Spicy', 1), (38, 'reference-abuse', 'Mild', 1), (39, 'box-abuse', 'Spicy', 1), (40, 'slice-abuse', 'Mild', 1), (41, 'file-too-long', 'Nuclear', 1),
    (42, 'unordered-imports', 'Mild', 1), (43, 'duplicate-imports', 'Mild', 1), (44, 'deep-module-nesting', 'Mild', 2), (44, 'deep-module-nesting', 'Spicy', 1)) as t(sample, rule_name, severity, n_issues)"""
