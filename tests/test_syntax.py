from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lintlake.functions import syntax
from lintlake.functions.syntax import Broken, integer, nodes_of, parses, tokenize


def function_lines(lines, name):
    return syntax._Braces("\n".join(lines)).length_of(name)


def kinds(text, kind, name=None):
    return [n for n in nodes_of(text) if n[1] == kind and (name is None or n[2] == name)]


def test_tokens_skip_comments_and_keep_strings_whole():
    text = 'let s = r#"a "quoted" // no comment"#; /* out /* in */ out */ let c = \'x\'; // end\nlet l: &\'a str = "b\\"c";'
    tokens = [t for _, t, _ in tokenize(text)]
    assert 'r#"a "quoted" // no comment"#' in tokens and "'x'" in tokens and "'a" in tokens and '"b\\"c"' in tokens
    assert not any("end" in t or "out" in t for t in tokens)


@pytest.mark.parametrize("text", ["fn f( {", "}", 'let s = "open'])
def test_broken_text_is_told(text):
    with pytest.raises(Broken):
        nodes_of(text)
    assert not parses(text)


@pytest.mark.parametrize("text", ["", "   \n\t", "// only a comment\n/* and another */", "fn main() {}"])
def test_nothing_to_say_about_trivial_files(text):
    assert not [n for n in nodes_of(text) if n[1] in ("empty_name", "letter", "integer", "macro")]


def test_bodies_of_macros_are_opaque():
    text = 'fn main() { println!("{}", data); let v = vec![temp, 5]; }'
    assert not kinds(text, "empty_name") and not kinds(text, "integer", "5")
    assert [(n[2], n[5]) for n in kinds(text, "macro")] == [("println", 0), ("vec", 1)]


def test_depth_of_blocks():
    text = "impl A { fn f(&self) { if a { for x in y { match z { _ => { b(); } } } } else { c(); } } }"
    assert sorted(n[4] for n in kinds(text, "block")) == [1, 2, 2, 3, 4]


def test_struct_literals_and_match_bodies_are_no_blocks():
    assert len(kinds("fn f() { let p = Point { x: 1, y: 2 }; match p { Point { .. } => 1, } }", "block")) == 1


def test_patterns_and_single_letters():
    text = "fn f(a: i32, mut q: u8) { let (b, c) = g(); for n in 0..3 {} let h = |w, x| w; if let Some(v) = o {} match e { Ok(u) => u, Err(_) => 0 } }"
    assert sorted(n[2] for n in kinds(text, "letter")) == sorted(["a", "q", "b", "c", "n", "h", "w", "v", "u"])


def test_free_function_names_count_twice():
    text = "fn data() {} impl T { fn data(&self) {} }"
    assert len(kinds(text, "empty_name", "data")) == 3


def test_arms_of_a_match():
    (node,) = kinds("fn f() { match r { Ok(x) => x, Err(e) => { log(e); 0 } } }", "match")
    assert node[5] == 2 and "Ok" in node[2] and "Err" in node[2]


def test_types():
    text = "struct S { a: String, b: Vec<String>, c: &'static [u8] } fn f(x: &str, y: &[String]) -> Result<String, Box<dyn Error>> { let z: [u8; 4] = q; }"
    count = Counter(n[1] for n in nodes_of(text))
    assert len(kinds(text, "type_path", "String")) == 4 and count["slice_type"] == 2 and count["reference_type"] == 3 and count["dyn_type"] == 1


def test_closures_async_and_modules():
    text = "mod a { mod b { fn f() { g(|x| h(|y| i(|z, p, q, r, s, t| z))); async move { a.await; b.await } ; } } }"
    assert [n[4] for n in kinds(text, "closure")] == [1, 2, 3] and kinds(text, "closure")[-1][5] == 6
    assert [n[4] for n in kinds(text, "module")] == [1, 2] and len(kinds(text, "await")) == 2 and len(kinds(text, "async")) == 1


def test_generics_traits_and_foreign_code():
    text = 'struct P<A, B, C, D, E, F>(A); trait W<A, B, C, D> { fn a(); fn b(); type C; const D: u8; } extern "C" { fn x(); fn y(); } unsafe fn u() { unsafe { v() } }'
    assert kinds(text, "generics", "struct")[0][5] == 6 and kinds(text, "trait")[0][5:7] == (4, 4)
    assert kinds(text, "extern_block")[0][5] == 2 and len(kinds(text, "unsafe_block")) == 1 and kinds(text, "total", "unsafe_fn")[0][5] == 2


@pytest.mark.parametrize(("token", "value"), [("1_000", 1000), ("0xFFu8", 255), ("0b11", 3), ("0o17", 15), ("5i64", 5), ("1.5", None), ("99999999999999999999", None)])
def test_integers(token, value):
    assert integer(token) == value


def test_length_of_a_function_with_its_signature_on_several_lines():
    assert function_lines(["fn f(", "  a: u8,", ") {", "}"], "f") == 2
    assert function_lines(["fn g() {", "  1", "}"], "g") == 3 and function_lines([], "main") == 70 and function_lines([], "other") == 5


def test_nested_and_deep_input_ends():
    nodes_of("fn f() { " + "if a { " * 300 + "}" * 300 + " }")
    nodes_of("let x = " + "(" * 500 + "1" + ")" * 500 + ";")


_WORDS = "fn f main ( ) { } [ ] macro_rules ! extern \"C\" trait struct impl < > :: match => , ; | || let for in if else const static type = : & && -> 'a 1 # async move unsafe mod use dyn where enum . await x T loop while _".split()
_CLOSING = {"(": ")", "[": "]", "{": "}"}


def balanced(words):
    out, open_ = [], []
    for w in words:
        if w in _CLOSING:
            open_.append(_CLOSING[w])
        elif w in _CLOSING.values():
            if not open_:
                continue
            w = open_.pop()
        out.append(w)
    return " ".join(out + open_[::-1])


@settings(max_examples=1500, deadline=2000)
@given(st.lists(st.sampled_from(_WORDS), max_size=40))
def test_the_scan_of_any_balanced_tokens_ends_without_a_fault(words):
    text = balanced(words)
    if parses(text):
        nodes_of(text)


@pytest.mark.parametrize("text", ["fn f() { macro_rules! }", "macro_rules!", "extern", "trait T { fn a(); } extern", "macro_rules! name", "fn", "let", "static", "a.", "#", "fn f() { macro_rules! ; x.unwrap() }"])
def test_texts_that_end_early_are_scanned_to_their_end(text):
    assert parses(text)
    assert nodes_of(text)[-1][1] == "total"


def test_a_file_that_cannot_be_scanned_gives_a_fault_and_not_nothing(monkeypatch):
    batch = pa.RecordBatch.from_pydict({"file_path": ["broken.rs", "fine.rs", "odd.rs"], "content": ["fn f( {", "fn f() {}", "odd"]})
    real = syntax.nodes_of
    monkeypatch.setattr(syntax, "nodes_of", lambda t: real(t) if t != "odd" else [][1])
    rows = pa.Table.from_batches(syntax.node_batches([batch])).to_pylist()
    assert {r["file_path"]: r["name"].split(":")[0] for r in rows if r["kind"] == "fault"} == {"broken.rs": "not balanced", "odd.rs": "IndexError"}
    assert any(r["file_path"] == "fine.rs" and r["kind"] == "fn_free" for r in rows)


@pytest.mark.parametrize(
    ("lines", "length"),
    [
        (["fn a() { b() }"], 1), (["fn a(", "  x: u8,", ") {", "  b", "}"], 2), (["fn a() {", "  b", "}", "c"], 3), (["fn a() {", "  b"], 2), (["fn b() {}"], 5),
        (["x {", "fn a() {", "}", "}"], 2), (["fn a() {", "fn a() {", "}", "}", "c"], 3),
    ],
)
def test_length_of_a_function(lines, length):
    assert function_lines(lines, "a") == length
