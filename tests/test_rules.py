from collections import Counter

import pytest

from lintlake.operators import rules
from lintlake.sources.files import FILE_SCHEMA, scan_files


def issues(spark, text, *names, path="a.rs"):
    files = spark.createDataFrame([(path, text, len(text.splitlines()), True, True)], FILE_SCHEMA)
    return rules.all_issues(files, list(names) or None).collect()


def levels(spark, text, name):
    return "".join(sorted(r.severity[0] for r in issues(spark, text, name)))


def test_all_39_rules_are_there(spark):
    assert len(rules.rules()) == 39


@pytest.mark.parametrize(
    ("name", "text", "expected"),
    [
        ("unwrap-abuse", "fn f() { %s }" % ("x.unwrap(); " * 6), "MMNSSS"),
        ("unnecessary-clone", "fn f() { %s }" % ("x.clone(); " * 5), "SS"),
        ("unnecessary-clone", "fn f() { %s }" % ("x.clone(); " * 3), ""),
        ("deep-nesting", "fn f() " + "{" * 9 + "}" * 9, "MMMNSS"),
        ("todo-comment", "// TODO\n" * 5, ""),
        ("todo-comment", "// TODO\n" * 6, "M"),
        ("todo-comment", "// TODO\n" * 11, "S"),
        ("file-structure", "\n" * 1000, ""),
        ("file-structure", "\n" * 1001, "M"),
        ("file-structure", "\n" * 1501, "S"),
        ("file-structure", "\n" * 2001, "N"),
        ("code-duplication", "let first = second();\n" * 2, ""),
        ("code-duplication", "let first = second();\n" * 3, "M"),
        ("code-duplication", "let first = second();\nlet  first = second();\n" * 2, "S"),
        ("code-duplication", "let first = second();\n" * 5, "N"),
        ("unsafe-abuse", "fn f() { %s }" % ("unsafe { a() } " * 4), "NSSS"),
        ("macro-abuse", "fn f() { %s }" % ("m!(a); " * 10), ""),
        ("macro-abuse", "fn f() { %s }" % ("m!(a); " * 12), "MM"),
        ("lifetime-abuse", "fn f<%s>() {}" % ", ".join(f"'l{i}" for i in range(7)), "SS"),
        ("import-chaos", "use b;\nuse a;\nuse b;\n", "MM"),
        ("import-chaos", "use a;\nuse b;\n", ""),
        ("commented-code", "// let a = b;\n// let c = d;\n// return a;\nfn f() {}\n", "M"),
        ("commented-code", "// let a = b;\n// words\n// return a == b;\n", ""),
        ("dead-code", "fn f() { return 1; }\n// return;\n", "MM"),
        ("println-debugging", "fn f() { %s }" % ('println!("a"); ' * 6), "S"),
        ("panic-abuse", "fn f() { %s }" % ('panic!("a"); ' * 3), "N"),
        ("magic-number", "fn f() { a(7, 1001, 100, 0xff); }", "MMS"),
        ("vec-abuse", "fn f() { %s }" % ("Vec::new(); " * 4), "M"),
        ("box-abuse", "fn f() { %s }" % ("Box::new(1); " * 9), "S"),
        ("iterator-abuse", "fn f() { for x in y {} for (a, b) in c {} }", "M"),
        ("match-abuse", "fn f() { match x { Ok(a) => a, Err(b) => b } }", "MM"),
        ("module-nesting", "mod a { mod b { mod c { mod d { mod e { mod f {} } } } } }", "MMS"),
        ("module-complexity", "mod a { mod b { mod c { mod d { mod e { mod f {} } } } } }", "S"),
        ("hungarian-notation", "fn f() { let strName = iCount; let g_data = nValue; let g_Data = 1; }", "MMM"),
        ("abbreviation-abuse", "fn f() { let mgr = cfg_path; }", "MM"),
        ("generic-abuse", "struct S<A, B, C, D, X, Y>(A);", "MMMMMMS"),
        ("trait-complexity", "trait T<A, B, C, D> { %s }" % ("fn f(); " * 11), "MS"),
        ("complex-closure", "fn f() { a(|x| b(|y| c(|z| d))); e(|a, b, c, d, e, f| 1); }", "MS"),
        ("async-abuse", "fn f() { %s }" % ("async { 1 }; " * 11), "S"),
        ("async-abuse", "fn f() { %s }" % ("x.await; " * 22), "MM"),
        ("dyn-trait-abuse", "fn f(%s) {}" % ", ".join(f"a{i}: &dyn T" for i in range(6)), "S"),
        ("reference-abuse", "fn f(%s) {}" % ", ".join(f"a{i}: &T" for i in range(21)), "M"),
        ("slice-abuse", "fn f(%s) {}" % ", ".join(f"a{i}: &[T]" for i in range(16)), "M"),
        ("channel-abuse", "fn f(%s) {}" % ", ".join(f"a{i}: Sender<u8>" for i in range(6)), "S"),
        ("ffi-abuse", 'extern "C" { fn a(); }\n' * 3 + "// libloading", "SS"),
        ("pattern-matching-abuse", "fn f() { match x { %s } }" % ", ".join(f"{i} => {i}" for i in range(11)), "S"),
        ("long-function", "fn f() {\n" + "a();\n" * 60 + "}", "M"),
        ("god-function", "fn f() { %s }" % ("if a { b(); } " * 9), "M"),
        ("string-abuse", "struct S { a: String }\nfn f() { a.to_string(); }", "MM"),
        ("single-letter-variable", "fn f() { let a = 1; let i = 2; }", "M"),
    ],
)
def test_severities(spark, name, text, expected):
    assert levels(spark, text, name) == expected


def test_names_give_their_place_by_running_number(spark):
    rows = issues(spark, "fn f() { let data = temp; }", "terrible-naming")
    assert sorted((r.subject, r.line, r.col) for r in rows) == sorted([("f", 2, 2), ("f", 3, 2), ("data", 4, 5), ("temp", 5, 5)])


def test_a_clean_file_has_few_issues(spark):
    text = "use std::fmt;\n\n/// Adds two counts.\npub fn add(left: u32, right: u32) -> u32 {\n    left + right\n}\n\npub fn double(count: u32) -> u32 {\n    add(count, count)\n}\n"
    assert len(issues(spark, text)) <= 10


@pytest.mark.parametrize("text", ["", "// only\n// comments\n", "  \n\t\n", "fn main() {}"])
def test_trivial_files_have_none(spark, text):
    assert issues(spark, text) == []


def test_files_that_do_not_parse_and_null_contents_have_none(spark):
    files = spark.createDataFrame([("a.rs", "fn data() {", 1, True, False), ("b.rs", None, 0, False, False), ("c.rs", None, 0, True, True)], FILE_SCHEMA)
    assert rules.all_issues(files).collect() == []
    assert rules.all_issues(files.limit(0)).collect() == []


def test_unicode_and_long_names_do_not_crash(spark):
    long = "x" * 1000
    rows = issues(spark, f"fn größe() {{ let 变量 = 1; let {long} = data; }}", "terrible-naming")
    assert [r.subject for r in rows] == ["data"]


def test_order_of_emission_follows_rules_then_places(spark):
    rows = sorted(issues(spark, "fn f() { let data = a.unwrap(); return data; }"), key=lambda r: r.emit_seq)
    order = list(rules.rules())
    at = [order.index(r.rule_name) for r in rows]
    assert at == sorted(at)


def test_own_rules_join_in(spark):
    from pyspark.sql import functions as F

    rules.rules()
    rules.register("no-goto", rules.nodes("ident", F.col("name") == "goto", "Spicy", "Savage", F.col("name")))
    try:
        assert [r.rule_name for r in issues(spark, "fn main() { goto(); }", "no-goto")] == ["no-goto"]
    finally:
        del rules.RULES["no-goto"]


def test_every_issue_has_a_place_and_an_id_of_its_own(spark):
    from lintlake.plans.analysis import analyze

    text = "use b::c;\nuse a::b;\nuse b::c;\nuse b::c;\nfn f() { " + "panic!(); x.unwrap(); " * 4 + "match r { Ok(a) => a, Err(e) => e } let y = 5; let z = 5; }\n" + "let data_value = data;\n" * 5
    rows = analyze(spark.createDataFrame([(p, text, 4, True) for p in ("a.rs", "b.rs")], "file_path string, content string, line_count long, parse_ok boolean")).collect()
    panics = [r for r in rows if r.rule_name == "panic-abuse" and r.line == 1]
    assert {r.severity for r in panics} >= {"Nuclear", "Spicy"} and sum(r.rule_name == "duplicate-imports" for r in rows) == 4
    assert len({(r.file_path, r.emit_seq) for r in rows}) == len({r.issue_id for r in rows}) == len(rows)
    assert len({r.issue_id for r in analyze(spark.createDataFrame([("a.rs", text, 4, True)], "file_path string, content string, line_count long, parse_ok boolean")).collect()} & {r.issue_id for r in rows}) == len(rows) // 2


def test_faults_are_listed(spark):
    files = spark.createDataFrame([("a.rs", "fn f( {", 1, True), ("b.rs", "fn f() {}", 1, True), ("c.rs", "}", 1, False)], "file_path string, content string, line_count long, parse_ok boolean")
    assert [r.file_path for r in rules.faults(files).collect()] == ["a.rs"]


def test_patterns_by_owner(spark):
    from lintlake.sources.files import kept_by_owner

    files = spark.createDataFrame([("vendor/a.rs", 1), ("b.rs", 1), ("b.rs", 2), (None, 1)], "file_path string, owner int")
    patterns = spark.createDataFrame([("x", "vendor/*"), ("x", "[bad"), ("y", ""), ("z", None), (None, "b*"), (None, "b*")], "owner string, pattern string")
    got = {tuple(r) for r in kept_by_owner(files, patterns).collect()}
    assert got == {("x", "b.rs"), ("z", "b.rs"), ("z", "vendor/a.rs"), (None, "vendor/a.rs")}
    assert kept_by_owner(files, patterns.limit(0)).collect() == []


def test_folders_are_listed_in_rounds_and_counted_by_name(spark, tmp_path, monkeypatch):
    from lintlake.sources import files as sources

    monkeypatch.setattr(sources, "LIST_ENTRIES", 3)
    for i in range(12):
        folder = tmp_path / f"d{i % 4}" / f"e{i}" / "deep.rs"
        folder.mkdir(parents=True)
        (folder / "f.rs").write_text("fn f() {}\n")
        (tmp_path / f"d{i % 4}" / f".h{i}.rs").write_text("a\nb")
    (tmp_path / "loop").symlink_to(tmp_path)
    assert scan_files(spark, str(tmp_path)).count() == 24
    assert scan_files(spark, f"file://{tmp_path}", ["*/e1*"]).count() == 21
    assert tuple(sources.scan_metrics(spark, str(tmp_path)).first()) == (36, 36)
    assert tuple(sources.scan_metrics(spark, str(tmp_path / "none")).first()) == (0, 0)
    assert tuple(sources.scan_metrics(spark, str(tmp_path / "d0" / ".h0.rs")).first()) == (1, 2)


def test_scan_of_a_folder(spark, tmp_path):
    for name, text in {"a.rs": "fn main() { x.unwrap(); }", "sub/_b.rs": "fn data() {}", "test_c.rs": "fn data() {}", "d.txt": "fn data() {}", ".e.rs": "fn temp() {}"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    (tmp_path / "broken.rs").write_text("fn f( {")
    files = scan_files(spark, str(tmp_path), ["*_c.rs", "[broken"])
    got = {r.file_path.rsplit("/", 1)[1]: (r.byte_ok, r.parse_ok) for r in files.collect()}
    assert got == {"a.rs": (True, True), "_b.rs": (True, True), ".e.rs": (True, True), "bad.rs": (False, False), "broken.rs": (True, False)}
    assert Counter(r.rule_name for r in rules.all_issues(files, ["unwrap-abuse", "terrible-naming"]).collect()) == {"unwrap-abuse": 1, "terrible-naming": 4}
    assert scan_files(spark, str(tmp_path / "none")).count() == 0
    assert scan_files(spark, str(tmp_path / "test_c.rs"), ["*_c.rs"], single=True).count() == 1
    assert scan_files(spark, str(tmp_path / "test_c.rs"), ["*_c.rs"]).count() == 0
