"""The 39 detection rules as plans over three inputs: files, their lines and their syntax nodes.

A rule gives rows (file_path, seq, line, col, rule_name, severity, roast_level, subject). Most rules are emissions: a condition on a single row (a node, which knows
its running number, or a file with its text) and what to report then. All emissions over nodes run in one pass over them, all over files in
another, without a shuffle. Only rules on lines that belong together are plans of their own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cache, cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintlake.functions.syntax import NODE_SCHEMA, node_batches
from lintlake.functions.text import contains_any, occurrences_of, severity_rank, split_lines, trimmed

# Words, substrings and limits that the rules look for.
MEANINGLESS = [
    "foo", "bar", "baz", "qux", "quux", "quuz", "data", "info", "obj", "item", "thing", "stuff", "value", "temp", "tmp", "test", "example", "sample",
    "manager", "handler", "processor", "controller", "yonghu", "mima", "denglu", "zhuce", "shuju",
]
WORST_MEANINGLESS = ["foo", "bar", "baz", "data", "temp"]
HUNGARIAN = ["str", "int", "bool", "float", "double", "char", "arr", "vec", "list", "map", "set", "g_", "m_", "s_", "p_", "b", "n", "sz", "lp", "dw"]
ABBREVIATIONS = {
    "mgr": "manager", "mngr": "manager", "ctrl": "controller", "proc": "processor", "hdlr": "handler",
    "usr": "user", "pwd": "password", "auth": "authentication", "cfg": "config", "prefs": "preferences",
    "btn": "button", "lbl": "label", "txt": "text", "img": "image", "pic": "picture",
    "db": "database", "tbl": "table", "col": "column", "idx": "index", "cnt": "count",
    "calc": "calculate", "init": "initialize", "exec": "execute", "impl": "implementation", "util": "utility",
}
TODO_MARKS = ["TODO", "FIXME", "XXX", "HACK", "BUG", "NOTE", "todo!", "unimplemented!", "unreachable!"]
CODE_SIGNS = [
    "let ", "fn ", "if ", "else", "for ", "while ", "match ", "struct ", "enum ", "impl ", "use ", "mod ", "return ", "break", "continue",
    "{", "}", "(", ")", "[", "]", ";", "=", "==", "!=", "&&", "||", "->", "::",
]
CODE_WORDS = ["pub", "const", "static", "mut", "ref", "move", "async", "await", "unsafe", "extern", "crate"]
DEAD_ENDS = ["return;", "return ", "break;", "continue;", "panic!(", "unreachable!(", "std::process::exit("]
PLAIN_NUMBERS = [-1, 0, 1, 2, 10, 100, 1000]
DANGEROUS = [
    "std::ptr::write", "std::ptr::read", "std::ptr::copy", "std::mem::transmute", "std::mem::forget", "std::mem::uninitialized", "std::slice::from_raw_parts",
    "std::str::from_utf8_unchecked", "Box::from_raw", "Vec::from_raw_parts", "String::from_raw_parts",
]
C_OPERATIONS = ["CString", "CStr", "c_char", "c_void", "c_int", "c_long", "std::ffi::", "libc::", "std::os::raw::"]
LIBRARY_LOADS = ["libloading", "dlopen", "LoadLibrary", "GetProcAddress"]

#: A row's place is rule, place in the file, part of the rule, in this order and as one number, so no two rows of a file share one: places of a rule in a
#: file, parts of a rule, and the place after all nodes and lines where measures of the whole text stand.
_ORDER, _PARTS, _AFTER_NODES = 10**14, 16, 10**12

OUTPUT = ["file_path", "seq", "line", "col", "rule_name", "severity", "roast_level", "subject"]
M, S, N = "Mild", "Spicy", "Nuclear"
GENTLE, SARCASTIC, SAVAGE = "Gentle", "Sarcastic", "Savage"


@dataclass
class Corpus:
    """The inputs of the rules. ``files`` has file_path, content, line_count and parse_ok; only files that parse reach a rule."""

    files: DataFrame

    @cached_property
    def parsed(self) -> DataFrame:
        return self.files.where("parse_ok and content is not null").select("file_path", "content", "line_count")

    @cached_property
    def lines(self) -> DataFrame:
        """file_path, line_no (from 1), raw and trimmed."""
        rows = self.parsed.select("file_path", F.posexplode(split_lines(F.col("content"))).alias("pos", "raw"))
        return rows.select("file_path", (F.col("pos") + 1).alias("line_no"), "raw", trimmed(F.col("raw")).alias("trimmed"))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.parsed.select("file_path", "content").mapInArrow(node_batches, NODE_SCHEMA)


def _value(x, kind: str) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(kind)


@dataclass(frozen=True)
class Emission:
    """Report ``times`` rows where the condition holds on a row of nodes (of ``kinds``) or files."""

    source: str
    when: Column
    severity: Column | str
    roast: Column | str
    subject: Column | str | None = None
    line: Column | int = 1
    col: Column | int = 1
    seq: Column | int = 0
    times: Column | int = 1
    kinds: tuple[str, ...] = ()

    def struct(self, rule: str, order: Column) -> Column:
        """An array of the rows that this emission gives for one input row, or null; ``order`` is the place of the first, further ones follow it."""
        row = lambda seq: F.struct(
            seq.alias("seq"), _value(self.line, "int").alias("line"), _value(self.col, "int").alias("col"), F.lit(rule).alias("rule_name"),
            _value(self.severity, "string").alias("severity"), _value(self.roast, "string").alias("roast_level"), _value(self.subject, "string").alias("subject"),
        )
        times = F.greatest(_value(self.times, "int"), F.lit(1))
        rows = F.array(row(order)) if isinstance(self.times, int) else F.transform(F.sequence(F.lit(0), times - 1), lambda copy: row(order + copy * _PARTS))
        return F.when(self.when, rows)


@dataclass(frozen=True)
class RuleSpec:
    """A rule: the names that its rows carry, its emissions by name, and the plans (Corpus -> rows of OUTPUT) of what isn't an emission."""

    name: str
    emissions: list[tuple[str, Emission]] = field(default_factory=list)
    plans: list[Callable[[Corpus], DataFrame]] = field(default_factory=list)


RULES: dict[str, RuleSpec] = {}


def register(name: str, *parts) -> RuleSpec:
    """Add a rule, also one of a user's own. Parts are emissions, pairs of another reported name and an emission, or plans."""
    emissions = [p if isinstance(p, tuple) else (name, p) for p in parts if isinstance(p, (tuple, Emission))]
    RULES[name] = RuleSpec(name, emissions, [p for p in parts if not isinstance(p, (tuple, Emission))])
    return RULES[name]


def nodes(kinds: str | list[str], condition: Column | None, severity, roast, subject=None, line=1, col=1) -> Emission:
    kinds = (kinds,) if isinstance(kinds, str) else tuple(kinds)
    return Emission("node", F.lit(True) if condition is None else condition, severity, roast, subject, line, col, F.col("seq"), kinds=kinds)


def beyond(kind: str, limit: int, severity: str, roast: str, name: str | None = None) -> Emission:
    """Every node of a kind (and name) after the first ``limit`` of the file."""
    condition = F.col("nth") > limit
    return nodes(kind, condition & (F.col("name") == name) if name else condition, severity, roast, F.col("nth"))


def counts(literals: list[str], limit: int, severity, roast) -> Emission:
    """One row if the literals occur more than ``limit`` times in the text; the severity may be a function of the count."""
    n = occurrences_of(F.col("content"), literals)
    return Emission("file", n > limit, severity(n) if callable(severity) else severity, roast, n, seq=_AFTER_NODES)


def _total(name: str, limit: int, severity: str, roast: str) -> Emission:
    return nodes("total", (F.col("name") == name) & (F.col("n") > limit), severity, roast, F.col("n"))


def _rows(df: DataFrame, rule: str, severity, roast, subject=None, line=1, col=1, seq="seq") -> DataFrame:
    return df.select(
        "file_path", F.col(seq).cast("long").alias("seq"), _value(line, "int").alias("line"), _value(col, "int").alias("col"),
        F.lit(rule).alias("rule_name"), _value(severity, "string").alias("severity"), _value(roast, "string").alias("roast_level"), _value(subject, "string").alias("subject"),
    )


def commented_runs(lines: DataFrame) -> DataFrame:
    """file_path, size, line and first line of every run of comment lines that look like code."""
    comment = F.col("trimmed").startswith("//")
    body = trimmed(F.regexp_replace("trimmed", "^(?://)+", ""))
    signs = reduce(lambda a, b: a + b, [body.contains(s).cast("int") for s in CODE_SIGNS])
    code = comment & ((signs >= 2) | contains_any(body, CODE_WORDS))
    marked = lines.select("file_path", "line_no", comment.alias("comment"), code.alias("code"))
    order = Window.partitionBy("file_path").orderBy("line_no")
    marked = marked.withColumn("run", F.sum(F.when(F.col("code"), 0).otherwise(1)).over(order)).withColumn("next_comment", F.lead("comment").over(order))
    last = F.max(F.struct("line_no", "next_comment"))
    runs = marked.where("code").groupBy("file_path", "run").agg(F.count("*").alias("size"), F.min("line_no").alias("seq"), last.alias("last"))
    # the reported line depends on what ends the run: a comment that isn't code, another line, or the end of the file
    line = F.when(F.col("last.next_comment"), F.col("seq")).otherwise(F.col("seq") - 1)
    return runs.select("file_path", "size", line.alias("line"), "seq")


def commented_code(c: Corpus) -> DataFrame:
    runs = commented_runs(c.lines).where("size >= 3")
    return _rows(runs, "commented-code", F.when(F.col("size") > 10, S).otherwise(M), SARCASTIC, F.col("size"), F.col("line"))


def dead_code(c: Corpus) -> DataFrame:
    found = c.lines.where(contains_any(F.col("trimmed"), DEAD_ENDS))
    return _rows(found, "dead-code", M, SARCASTIC, F.col("trimmed"), F.col("line_no"), seq="line_no")


def normalised_lines(lines: DataFrame) -> DataFrame:
    """file_path, norm_line and line_no of the lines that count for duplication."""
    text = F.col("trimmed")
    kept = lines.where(~text.startswith("//") & ~text.startswith("/*") & (F.octet_length(text) >= 10))
    norm = F.regexp_replace(text, r"(?U)\s", "")
    norm = F.lower(F.replace(F.replace(norm, F.lit("let"), F.lit("VAR")), F.lit("mut"), F.lit("")))
    return kept.select("file_path", norm.alias("norm_line"), "line_no")


def repeated_lines(c: Corpus) -> DataFrame:
    groups = normalised_lines(c.lines).groupBy("file_path", "norm_line").agg(F.count("*").alias("n"), F.min("line_no").alias("line_no")).where("n >= 3")
    n = F.col("n")
    return _rows(groups, "code-duplication", F.when(n >= 5, N).when(n >= 4, S).otherwise(M), SARCASTIC, n, F.col("line_no"), seq="line_no")


@cache
def _register_own() -> None:
    """The built-in rules; columns need a session, so not at import."""
    name, nth, n, m, depth = (F.col(c) for c in ("name", "nth", "n", "m", "depth"))
    number = F.col("name").try_cast("long")
    abbreviation = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])[F.regexp_extract(F.lower("name"), "^([^_]+)", 1)]
    god = F.greatest(n - 5, F.lit(0)) * 2 + m
    uses = F.filter(split_lines(F.col("content")), lambda x: trimmed(x).startswith("use "))
    repeated_uses = F.size(uses) - F.size(F.array_distinct(uses))
    line_count = F.col("line_count")
    level = lambda x, spicy, nuclear: F.when(x > nuclear, N).when(x > spicy, S).otherwise(M)

    # Names
    register("terrible-naming", nodes("empty_name", None, S, SARCASTIC, name, nth + 1, F.octet_length("name") % 10 + 1))
    register("single-letter-variable", nodes("letter", None, M, GENTLE, name, nth + 9, F.octet_length("name") % 5 + 1))
    register("meaningless-naming", nodes("ident", F.lower("name").isin(MEANINGLESS), F.when(name.isin(WORST_MEANINGLESS), S).otherwise(M), SARCASTIC, name))
    register("hungarian-notation", nodes("ident", name.rlike(r"^(?:" + "|".join(HUNGARIAN) + r")(?:\p{Lu}|_)"), M, SARCASTIC, name))
    register("abbreviation-abuse", nodes("ident", abbreviation.isNotNull(), M, GENTLE, F.concat_ws(" -> ", "name", abbreviation)))

    # Habits of beginners
    register("println-debugging", nodes("macro", (name == "println") & (n == 1), M, GENTLE, name), counts(["println!"], 5, S, SAVAGE))
    register("panic-abuse", nodes("macro", (name == "panic") & (n == 1), S, SARCASTIC, name), counts(["panic!"], 2, N, SAVAGE), counts([".unwrap()"], 3, S, SARCASTIC))
    register("todo-comment", counts(TODO_MARKS, 5, lambda n: F.when(n > 10, S).otherwise(M), SARCASTIC))

    # Smells. god-function is approximate: control words are counted in the source, where the original counts them in a dump of the syntax tree.
    register("magic-number", nodes("integer", ~number.isin(PLAIN_NUMBERS), F.when((number < -100) | (number > 1000), S).otherwise(M), GENTLE, name))
    register("god-function", nodes(["fn_free", "fn_unsafe"], god > 15, F.when(god > 25, S).otherwise(M), SARCASTIC, name))
    register("commented-code", commented_code)
    register("dead-code", dead_code)

    # Habits of the language. match-abuse is approximate: every match of two arms counts as one over an option, and once more if its patterns have Ok and Err.
    register(
        "string-abuse",
        nodes("method_call", name == "to_string", M, GENTLE, name),
        nodes("type_path", name == "String", M, GENTLE, name),
        counts(["String::new()", "String::from(", ".to_string()"], 5, S, SARCASTIC),
    )
    register("vec-abuse", counts(["Vec::new()"], 3, M, GENTLE))
    register("iterator-abuse", nodes("for_loop", n == 1, M, GENTLE))
    register("match-abuse", nodes("match", n == 2, M, GENTLE, "Option"), nodes("match", (n == 2) & name.contains("Ok") & name.contains("Err"), M, GENTLE, "Result"))

    # Complexity. Repeated blocks are approximate, by how their first statement begins.
    register("deep-nesting", nodes("block", depth > 3, level(depth, 6, 8), F.when(depth > 8, SAVAGE).otherwise(SARCASTIC), depth))
    register("long-function", nodes("lines", n > 50, level(n, 75, 100), F.when(n > 100, SAVAGE).otherwise(SARCASTIC), F.concat_ws(": ", "name", "n")))
    register("code-duplication", repeated_lines, nodes("repeated_block", None, S, SARCASTIC, n))
    register("unwrap-abuse", nodes("method_call", name == "unwrap", level(nth, 2, 5), F.when(nth > 5, SAVAGE).when(nth > 2, SARCASTIC).otherwise(GENTLE), nth))
    register("unnecessary-clone", beyond("method_call", 3, S, SARCASTIC, "clone"))

    # Advanced features
    register("complex-closure", nodes("closure", depth > 2, S, SARCASTIC, F.concat_ws(" ", F.lit("depth"), "depth")), nodes("closure", n > 5, M, GENTLE, F.concat_ws(" ", F.lit("parameters"), "n")))
    register("lifetime-abuse", beyond("lifetime", 5, S, SARCASTIC))
    register("trait-complexity", nodes("trait", n > 10, S, SARCASTIC, name), nodes("trait", m > 3, M, GENTLE, name))
    register(
        "generic-abuse",
        nodes("generics", name.isin("fn", "struct", "enum", "impl") & (n > 5), S, SARCASTIC, n),
        nodes("type_param", (F.octet_length("name") == 1) & ~name.isin("T", "U", "V", "E", "K"), M, GENTLE, name),
    )

    # Features of the language
    register("channel-abuse", _total("channel", 5, S, SARCASTIC))
    register("async-abuse", nodes(["async", "await"], m > 10, S, SARCASTIC, m), nodes(["async", "await"], n > 20, M, GENTLE, n))
    register("dyn-trait-abuse", beyond("dyn_type", 5, S, SARCASTIC))
    register(
        "unsafe-abuse",
        nodes("unsafe_block", None, F.when(nth <= 3, S).otherwise(N), SAVAGE, nth),
        _total("unsafe_fn", 2, N, SAVAGE),
        counts(["*const", "*mut"], 5, N, SAVAGE),
        counts(DANGEROUS, 3, N, SAVAGE),
    )
    register(
        "ffi-abuse",
        nodes("extern_block", n > 10, S, SARCASTIC, n),
        _total("extern_block", 2, S, SARCASTIC),
        counts(C_OPERATIONS, 10, N, SAVAGE),
        counts(LIBRARY_LOADS, 0, S, SARCASTIC),
        counts(["#[repr(C)]"], 5, S, SARCASTIC),
    )
    register("macro-abuse", beyond("macro", 10, M, GENTLE))
    register("module-complexity", nodes("module", depth > 5, S, SARCASTIC, depth))
    register("pattern-matching-abuse", beyond("list_pattern", 15, M, GENTLE), nodes("match", n > 10, S, SARCASTIC, n))
    register("reference-abuse", beyond("reference_type", 20, M, GENTLE))
    register("box-abuse", counts(["Box::new", "Box<"], 8, S, SARCASTIC))
    register("slice-abuse", beyond("slice_type", 15, M, GENTLE))

    # Structure of files
    register("file-structure", ("file-too-long", Emission("file", line_count > 1000, level(line_count, 1500, 2000), SARCASTIC, line_count)))
    register(
        "import-chaos",
        ("unordered-imports", Emission("file", (F.size(uses) > 1) & (uses != F.array_sort(uses)), M, SARCASTIC)),
        ("duplicate-imports", Emission("file", (F.size(uses) > 1) & (repeated_uses > 0), M, SARCASTIC, times=repeated_uses, seq=1)),
    )
    register("module-nesting", ("deep-module-nesting", nodes("module", depth > 3, F.when(depth > 5, S).otherwise(M), SARCASTIC, depth)))


def rules() -> dict[str, RuleSpec]:
    """All rules by name, in the order in which they report; a user's own after the built-in ones unless registered before the first call."""
    _register_own()
    return RULES


def faults(files: DataFrame) -> DataFrame:
    """file_path and reason of the files that are given as parsed but can't be scanned; no rule sees their nodes, rules on text and lines do."""
    return Corpus(files).nodes.where("kind = 'fault'").select("file_path", F.col("name").alias("reason"))


def all_issues(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Issues of all rules (or the named ones) over a table of files: OUTPUT plus severity_rank and emit_seq, the order of rules, then of places in the file.

    Within a file emit_seq is unique. Files that don't parse give none, null contents neither, and an empty table gives an empty one; ``faults`` lists those that
    count as parsed but can't be scanned. Two parts of the plan read the files for emissions, one
    of them through the parser; further parts are those of line rules.
    """
    corpus = Corpus(files)
    by_kind: dict[str, list[Column]] = {}
    on_files: list[Column] = []
    parts = []
    for i, (name, spec) in enumerate(rules().items()):
        if names is not None and name not in names:
            continue
        for part, (reported, e) in enumerate(spec.emissions, len(spec.plans)):
            rows = e.struct(reported, _value(e.seq, "long") * _PARTS + (i * _ORDER + part))
            for found in [by_kind.setdefault(k, []) for k in e.kinds] if e.source == "node" else [on_files]:
                found.append(rows)
        parts += [plan(corpus).withColumn("seq", F.col("seq") * _PARTS + (i * _ORDER + part)) for part, plan in enumerate(spec.plans)]
    found = lambda rows: F.flatten(F.filter(F.array(*rows), lambda x: x.isNotNull())) if len(rows) > 1 else rows[0]
    if by_kind:
        # a node meets the emissions of its own kind only
        rows = F.coalesce(*(F.when(F.col("kind") == k, found(r)) for k, r in by_kind.items()))
        parts.append(corpus.nodes.where(F.col("kind").isin(list(by_kind))).select("file_path", F.inline(rows)))
    if on_files:
        parts.append(corpus.parsed.select("file_path", F.inline(found(on_files))))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("severity_rank", severity_rank(F.col("severity"))).withColumnRenamed("seq", "emit_seq")
