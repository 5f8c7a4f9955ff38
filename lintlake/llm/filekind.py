"""Generated, minified, vendored and data files among hand-written source, by belief propagation over directory trees.

Every file has evidence of its own (content, file name, lines that it shares with vendored files), every directory that of its name.
Files and directories form a tree. Messages go up from files to the root and down again; on a tree
this gives exact marginals, in which a file's siblings speak through their common directory.

What headers say is learned: beliefs are propagated once without reading any, then the word sequences of all header comments are counted under these
beliefs (and the hand labels), which gives the odds of each sequence for generated and for vendored files; with these odds as further evidence
beliefs are propagated again. The chances between a directory and what lies in it are counted under the first beliefs too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.session import shared_table, spread

LABELS = ["handwritten", "generated", "minified", "vendored", "data_blob"]
#: Labelled files that the classifier is fitted on, at most; those of least hashed id.
MOST_LABELS = 20_000
#: A line that can tell where a file is from has at least so many characters.
TELLING = 30
#: Bytes of distinct exclude globs at most; beyond that it is no list written by hand and an error is raised.
MOST_GLOB_BYTES = 1 << 22
#: Directories with files below one directory up to which its whole tree is worked on in one task.
SUBTREE = 20_000
#: Words of a sequence in a header, files that must have it, what a count starts from, the power of its odds (the sequences of one phrase support each
#: other), the logarithm of odds from which a sequence says anything and up to which it counts, and from which a header marks lines as vendored.
GRAMS, GRAM_FILES, GRAM_START, GRAM_POWER, GRAM_LEAST, GRAM_MOST, GRAM_MARKS = (2, 3), 4, 0.5, 1.3, 1.5, 10.0, 4.0
#: Labels that headers tell, and the weight of the typed chances below against those counted, in files and directories.
TOLD, FILES_WEIGH, DIRECTORIES_WEIGH = ("generated", "vendored"), 50.0, 200.0

# The marks that generators have agreed on, and endings of file names.
_MARK = regex.compile(r"@generated\b|\bcode generated\b.*\bdo not (?:edit|modify)\b", regex.I)
_WORD = regex.compile(r"\p{Han}|[^\W\d_\p{Han}]+")
_NAME_GENERATED = regex.compile(r"(?:\.pb|\.g|_gen|_autogen|_generated|\.generated|_bindings|_pb2?)\.\w+$")
_NAME_MINIFIED = regex.compile(r"\.min\.\w+$|\.bundle\.\w+$")
_NAME_HASHED = regex.compile(r"-[0-9a-f]{8,}\.\w+$")

#: Directories whose name tells a label, and by what log-odds. Such a directory may stand anywhere, so it neither takes its label from the
#: directory above nor says anything about that one. Below a ``src`` directory names are those of
#: the project's own modules, so that a module called vendor says nothing.
DIRECTORIES = {
    "vendor": ("vendored", 6.0), "third_party": ("vendored", 6.0), "external": ("vendored", 6.0), "deps": ("vendored", 6.0), "node_modules": ("vendored", 6.0), "3rdparty": ("vendored", 6.0),
    "generated": ("generated", 5.0), "gen": ("generated", 4.0), "autogen": ("generated", 5.0), "target": ("generated", 6.0), "out": ("generated", 4.0),
    "dist": ("minified", 5.0),
}

#: Chance of a file's label given its directory's, and of a directory's given that of the one above, in the order of LABELS: where counting starts from. A
#: directory without a telling name is hardly ever of another kind than the one above; single files are.
FILE_GIVEN_DIRECTORY = np.array([
    [0.930, 0.020, 0.015, 0.020, 0.015],
    [0.200, 0.740, 0.020, 0.020, 0.020],
    [0.300, 0.020, 0.640, 0.020, 0.020],
    [0.020, 0.010, 0.010, 0.950, 0.010],
    [0.400, 0.020, 0.020, 0.020, 0.540],
])
DIRECTORY_GIVEN_PARENT = np.array([
    [0.99878, 2e-4, 2e-4, 2e-5, 8e-4],
    [0.050, 0.930, 0.005, 0.005, 0.010],
    [0.100, 0.010, 0.870, 0.010, 0.010],
    [0.010, 0.005, 0.005, 0.975, 0.005],
    [0.200, 0.010, 0.010, 0.010, 0.770],
])

#: Features and the weights that they start from: the fitted ones stay near them while few labels speak against.
FEATURES: dict[str, dict[str, float]] = {
    "bias": {"handwritten": 1.0},
    "head_marked": {"generated": 6.0},
    "name_generated": {"generated": 6.0},
    "name_minified": {"minified": 6.0},
    "name_hashed": {"minified": 2.0},
    "regular": {"generated": 0.5, "data_blob": 0.5},
    "tabular": {"generated": 8.0},
    "varied": {"handwritten": 2.0, "vendored": 2.0},
    "literals": {"data_blob": 10.0},
    "records": {"data_blob": 10.0},
    "packed": {"minified": 10.0, "data_blob": 2.0},
    "long_lines": {"minified": 0.5, "data_blob": 0.5},
    "dense": {"minified": 0.5, "data_blob": 0.5},
    "spaced": {"handwritten": 3.0, "generated": 3.0, "vendored": 3.0, "data_blob": 2.0},
    "short_names": {"minified": 4.0},
    "prose": {"handwritten": 1.0, "vendored": 1.0},
    "vendored_lines": {"vendored": 12.0},
    "excluded": {"generated": 0.3, "minified": 0.3, "vendored": 0.3},
}

_STRING = re.compile(r'"(?:\\.|[^"\\\n])*"')
_NUMBER = re.compile(r"\b0x[0-9a-fA-F]+|\b\d[\d_]*(?:\.\d+)?")
_BASE64 = re.compile(r"[A-Za-z0-9+/=]{48,}")
_CONSTANT = re.compile(r"\b[A-Z][A-Z0-9]*_[A-Z0-9_]+\b")
_IDENTIFIER = re.compile(r"\b[A-Za-z_]\w*")
#: Comments over lines with their ends, and lines before the first code that begin like comments of some language but are none.
_COMMENTS = {"/*": "*/", "<!--": "-->"}
_DIRECTIVE = re.compile(r"#!?\[|#(?:include|define|undef|ifn?def|if|elif|else|endif|pragma)\b")
_TYPE, _BLANK = re.compile(r"a<[^<>\n]*>|&a"), re.compile(r"[^\S\n]+")
_REPEATED = re.compile(r"(?:[0a],)+")
_NOT_FIELDS = re.compile(r"[(){}=;\"]")
_CODE = re.compile(r"\b(?:fn|let|if|for|while|match|return|use|pub|impl|function|var|def|import)\b|[;]\s*$")


def _clip(x: float) -> float:
    return min(1.0, max(0.0, x))


def _header(lines: list[str]) -> list[str]:
    """What may be comments among the first five of the stripped lines, and all comment lines before the first line of code."""
    out, end = [], ""
    for i, x in enumerate(lines):
        inside = bool(end)
        if inside:
            end = "" if end in x else end
        else:
            opened = next((c for c in _COMMENTS if x.startswith(c)), "")
            end = _COMMENTS[opened] if opened and _COMMENTS[opened] not in x[len(opened) :] else ""
        if inside or opened or x.startswith(("//", ";", "--")) or (x.startswith("#") and not _DIRECTIVE.match(x)):
            out.append(x)
        elif i < 5 and x[:1] in "/#*<;":
            out.append(x)
        if not inside and not opened and not x.startswith(("//", "#", ";", "--")):
            out += [y for y in lines[i + 1 : 5] if y[:1] in "/#*<;" or y[:2] == "--"]
            break
    return out


def _is_record(line: str) -> bool:
    """Whether a stripped line is three or more fields with commas between, or a JSON array or object; by searches that are linear in its length."""
    inside = line.removesuffix(",")
    if line[:1] in ("[", "{") and inside[-1:] in ("]", "}") and ("," in inside[1:-1] or ":" in inside[1:-1]):
        return True
    first = line.find(",", 1)
    return first > 0 and line.rfind(",", 0, len(line) - 1) > first + 1 and not _NOT_FIELDS.search(line)


def _shapes(body: str) -> list[str]:
    """The lines of ``body`` without their names and values."""
    body = _NUMBER.sub("0", _STRING.sub("s", body))
    body = _BLANK.sub("", _TYPE.sub("a", _IDENTIFIER.sub("a", body)))
    return _REPEATED.sub("", body).split("\n")


def content_features(path: str, text: str) -> dict[str, float]:
    """The features that a file shows by itself; all are between 0 and 1."""
    lines = [x for x in (y.strip() for y in text.splitlines()) if x]
    head = "\n".join(_header(lines))
    code = [x for x in lines if not x.startswith(("//", "/*", "*", "#"))]
    n = len(code)
    shapes: dict[str, int] = {}
    for s in _shapes("\n".join(code)) if n else ():
        shapes[s] = shapes.get(s, 0) + 1
    counts = sorted(shapes.values(), reverse=True)
    entropy = -sum(c / n * math.log2(c / n) for c in counts) if n else 0.0
    solid = sum(map(len, code)) or 1
    spaces = 1 - len("".join(text.split())) / (len(text) or 1)
    body = "\n".join(code)
    strings = _STRING.findall(body)
    bare = _STRING.sub("", body)
    names = _IDENTIFIER.findall(bare)
    literal = sum(map(len, _NUMBER.findall(bare))) + sum(len(b) for b in _BASE64.findall(body))
    records = sum(1 for x in code if _is_record(x) and not _CODE.search(x))
    regular = _clip((sum(counts[:6]) / max(1, n) - 0.7) / 0.3) * _clip((n - 3) / 3)
    constants = _clip(len(_CONSTANT.findall(body)) / max(1, n) / 0.5)
    dunder = _clip(body.count("__") / max(1, n) / 0.5)
    snake = [x for x in names if "_" in x]
    compound = _clip((sum(x.strip("_").count("_") > 1 for x in snake) / max(1, len(snake)) - 0.25) / 0.5) if len(snake) > 3 else 0.0
    long_lines = _clip((math.log2(solid / max(1, n) + 1) - 6) / 2)
    dense = _clip((0.13 - spaces) / 0.05)
    return {
        "bias": 1.0,
        "head_marked": float(bool(_MARK.search(head))),
        "name_generated": float(bool(_NAME_GENERATED.search(path))),
        "name_minified": float(bool(_NAME_MINIFIED.search(path))),
        "name_hashed": float(bool(_NAME_HASHED.search(path))),
        "regular": regular,
        "tabular": regular * max(constants, dunder, compound),
        "varied": _clip((entropy - 2.5) / 1.5),
        "literals": _clip((literal / solid - 0.3) / 0.2),
        "records": _clip((records / max(1, n) - 0.4) / 0.4) * _clip(n / 6),
        "packed": long_lines * dense,
        "long_lines": long_lines,
        "dense": dense,
        "spaced": float(not dense and not long_lines),
        "short_names": _clip((4.0 - sum(map(len, names)) / max(1, len(names))) / 1.5) if len(names) > 20 else 0.0,
        "prose": _clip((len(lines) - n) / max(1, len(lines)) / 0.15),
    }


def header_grams(text: str) -> set[int]:
    """Hashes of the sequences of GRAMS words in the lines of the header; numbers are no words, and each Han character is one."""
    out = set()
    for line in _header([x for x in (y.strip() for y in text.splitlines()) if x]):
        words = _WORD.findall(line.lower())
        for n in GRAMS:
            out.update(xxhash.xxh64_intdigest(" ".join(words[i : i + n])) - (1 << 63) for i in range(len(words) - n + 1))
    return out


_OWN = [f for f in FEATURES if f not in ("vendored_lines", "excluded")]


def _features(expressions: list[str]):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        globs = [re.compile(x) for x in expressions]
        for batch in batches:
            rows, lines, grams = [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                f = content_features(path or "", text)
                excluded = sum(path is not None and g.search(path) is not None for g in globs)
                rows.append([*(f[name] for name in _OWN), min(1.0, excluded / 2)])
                lines.append(list({xxhash.xxh64_intdigest(x) - (1 << 63) for x in (y.strip() for y in text.splitlines()) if len(x) >= TELLING}))
                grams.append(list(header_grams(text)))
            columns = [batch.column("id"), batch.column("path"), pa.array(rows, pa.list_(pa.float64())), pa.array(lines, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "path", "own", "lines", "grams"])

    return split


def _in_vendored_directory(path: Column) -> Column:
    names = [d for d, (label, _) in DIRECTORIES.items() if label == "vendored"]
    above_src = F.regexp_extract(F.concat(F.lit("/"), path), "^(.*?)(/src/|$)", 1)
    return F.concat(above_src, F.lit("/")).rlike("/(" + "|".join(names) + ")/")


def _vendored_lines(files: DataFrame, marked: Column) -> DataFrame:
    """id and the share of a file's telling lines that marked files other than itself have, and the number of its telling lines."""
    lines = files.select("id", marked.cast("int").alias("marked"), F.explode("lines").alias("line"))
    seen = shared_table(lines.groupBy("line").agg(F.sum("marked").alias("n")).where("n > 0"), "vendored-lines")
    # one row a line on the right, so a line that a third of all files have only makes a long partition, which adaptive execution splits
    joined = lines.join(seen, "line", "left")
    elsewhere = (F.coalesce("n", F.lit(0)) > F.col("marked")).cast("double")
    return joined.groupBy("id").agg(F.avg(elsewhere).alias("share"), F.count("*").alias("n_lines"))


def _expressions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for glob in batch.column("glob").to_pylist():
            if not glob or not glob.strip("*? "):
                continue
            expression = glob.replace(".", r"\.").replace("*", ".*").replace("?", ".")
            try:
                regex.compile(expression)
            except regex.error:
                continue
            out.append(expression)
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["expression"])


def valid_globs(patterns: DataFrame, column: str = "pattern") -> DataFrame:
    """expression: the regular expressions of the distinct globs that say anything: null, empty and invalid ones drop out, as do those that match every path.

    A glob becomes an expression by escaping dots, then * for any run and ? for any character; it may match anywhere in the path.
    """
    return patterns.select(F.col(column).alias("glob")).distinct().mapInArrow(_expressions, "expression string")


def _globs(patterns: DataFrame | None) -> list[str]:
    if patterns is None:
        return []
    globs = valid_globs(patterns)
    size = globs.agg(F.coalesce(F.sum(F.octet_length("expression")), F.lit(0))).first()[0]
    if size > MOST_GLOB_BYTES:
        raise ValueError(f"more than {MOST_GLOB_BYTES} bytes of exclude globs")
    return sorted(r[0] for r in globs.collect())


def own_features(files: DataFrame, key: Column, path: Column, text: Column, patterns: DataFrame | None = None) -> DataFrame:
    """id, path, own (features in the order of _OWN, then ``excluded``), lines and grams (hashes) of every distinct file whose text is not null."""
    rows = spread(files.select(key.cast("long").alias("id"), path.alias("path"), text.alias("text")).where("id is not null and text is not null"))
    own = rows.mapInArrow(_features(_globs(patterns)), "id long, path string, own array<double>, lines array<long>, grams array<long>")
    return shared_table(own.dropDuplicates(["id"]), "features")


_TOLD = [f"told_{label}" for label in TOLD]


def evidence_of(own: DataFrame, told: DataFrame | None = None) -> DataFrame:
    """id, path, grams, features (in the order of _ORDER) and the odds that the header gives for TOLD; without ``told`` (id, told_...) headers say nothing."""
    told_columns = [F.coalesce(c, F.lit(0.0)).alias(c) for c in _TOLD] if told is not None else [F.lit(0.0).alias(c) for c in _TOLD]
    rows = (own.join(told, "id", "left") if told is not None else own).select("id", "path", "own", "lines", "grams", *told_columns)
    shared = _vendored_lines(rows, _in_vendored_directory(F.col("path")) | (F.col("told_vendored") > GRAM_MARKS))
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("share") - 0.3) / 0.2)) * F.least(F.lit(1.0), F.col("n_lines") / 5)
    out = rows.drop("lines").join(shared.select("id", clipped.alias("vendored_lines")), "id", "left")
    features = F.concat("own", F.array(F.coalesce("vendored_lines", F.lit(0.0))))
    return shared_table(out.select("id", "path", "grams", features.alias("features"), *_TOLD), "evidence")


_ORDER = [*_OWN, "excluded", "vendored_lines"]


def starting_weights() -> np.ndarray:
    return np.array([[FEATURES[f].get(label, 0.0) for label in LABELS] for f in _ORDER])


def fit(features: np.ndarray, labels: np.ndarray, pull: float = 2.0, doubt: float = 0.05, rounds: int = 300) -> np.ndarray:
    """Weights (features x labels) of a softmax fitted to the labels, held near the starting weights by a quadratic pull.

    A label is taken to be wrong with the chance ``doubt``, which bounds what a single wrong one can move. All labels weigh the same in
    sum, so that the result stands for the likelihood of the features; how common a label is follows from the tree.
    """
    start = starting_weights()
    w = start.copy()
    if not len(labels):
        return w
    onehot = np.eye(len(LABELS))[labels]
    counts = onehot.sum(axis=0)
    weight = np.minimum(len(labels) / np.maximum(counts, 1) / len(LABELS), 5.0)[labels][:, None]
    step = 1.0 / (0.5 * len(FEATURES) * weight.sum() / 4 + pull)
    for _ in range(rounds):
        z = features @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        given = (p * onehot).sum(axis=1, keepdims=True)
        trust = (1 - doubt) * given / ((1 - doubt) * given + doubt / len(LABELS))
        w -= step * (features.T @ (weight * trust * (p - onehot)) + pull * (w - start))
    return w


def agreed_labels(labels: DataFrame | None) -> DataFrame | None:
    """id and label of the hand-labelled files on whose label all annotators agree; null and unknown labels say nothing. At most MOST_LABELS, those of least hashed id."""
    if labels is None:
        return None
    agreed = labels.where(F.col("label").isin(LABELS)).groupBy(F.col("file_id").alias("id")).agg(F.min("label").alias("label"), F.max("label").alias("other"))
    return shared_table(agreed.where("label = other").select("id", "label").orderBy(F.xxhash64("id"), "id").limit(MOST_LABELS), "labels")


def fitted_weights(evidence: DataFrame, agreed: DataFrame | None) -> np.ndarray:
    if agreed is None:
        return starting_weights()
    rows = evidence.join(F.broadcast(agreed), "id").select("features", "label").collect()
    return fit(np.array([r[0] for r in rows]).reshape(len(rows), len(FEATURES)), np.array([LABELS.index(r[1]) for r in rows], int))


# Messages are rows of five logarithms, up to a constant.

_P, _U, _B, _M, _T = ([f"{c}{i}" for i in range(len(LABELS))] for c in "pubmt")
_FIVE = lambda names: ", ".join(f"{c} double" for c in names)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    return (np.log(np.exp(x - most).sum(axis=axis, keepdims=True)) + most).squeeze(axis)


def _upward(values: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The messages of children to their directory: over the labels of the directory."""
    return _log_sum(values[:, None, :] + np.log(given)[None], 2)


def _downward(values: np.ndarray, given: np.ndarray) -> np.ndarray:
    return _log_sum(values[:, :, None] + np.log(given)[None], 1)


def _joint(above: np.ndarray, below: np.ndarray, given: np.ndarray) -> np.ndarray:
    """Expected counts of (directory's label, child's label) over all rows, as 25 numbers."""
    if not len(above):
        return np.zeros(len(LABELS) ** 2)
    x = above[:, :, None] + np.log(given)[None] + below[:, None, :]
    x = np.exp(x - x.max(axis=(1, 2), keepdims=True))
    return (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0).ravel()


def _matrix(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in names], axis=1)


def _score(weights: np.ndarray, given: np.ndarray):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1) @ weights
            for name in TOLD:
                values[:, LABELS.index(name)] += batch.column(f"told_{name}").to_numpy()
            up = _upward(values, given)
            columns = [batch.column(c) for c in ("id", "path", "grams")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, values.T.copy()), *map(pa.array, up.T.copy())], ["id", "path", "grams", *_P, *_U])

    return split


def scored(evidence: DataFrame, weights: np.ndarray, given: np.ndarray = FILE_GIVEN_DIRECTORY) -> DataFrame:
    """id, path, grams, own log evidence p0 ... p4 and the message to the directory u0 ... u4 of every file."""
    return evidence.mapInArrow(_score(weights, given), f"id long, path string, grams array<long>, {_FIVE(_P)}, {_FIVE(_U)}")


def _parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def _telling(directory: str, path: str) -> bool:
    return directory in DIRECTORIES and not (DIRECTORIES[directory][0] == "vendored" and "/src/" in f"/{path}")


class _Tree:
    """Some of the directories with their own log evidence; those whose parent is not among them are roots here."""

    def __init__(self, table: pa.Table, given: np.ndarray) -> None:
        self.given = given
        self.paths = table.column("dir").to_pylist()
        at = {p: i for i, p in enumerate(self.paths)}
        self.parents = [None if not p else p.rpartition("/")[0] for p in self.paths]
        self.parent = np.array([-1 if p is None else at.get(p, -1) for p in self.parents], np.int64)
        names = [p.rpartition("/")[2] for p in self.paths]
        self.named = np.array([_telling(n, p) for n, p in zip(names, self.paths)], bool)
        self.values = _matrix(table, _U)
        self.values[:, 0] += 0.2
        for i in np.flatnonzero(self.named).tolist():
            label, weight = DIRECTORIES[names[i]]
            self.values[i, LABELS.index(label)] += weight - 0.2 * (label == LABELS[0])
        depth = np.array([p.count("/") + 1 if p else 0 for p in self.paths], np.int64)
        self.levels = [np.flatnonzero(depth == d) for d in np.unique(depth)]
        self.sent = np.zeros_like(self.values)

    def up(self) -> None:
        for level in reversed(self.levels):
            message = _upward(self.values[level], self.given)
            message[self.named[level]] = 0.0
            self.sent[level] = message
            inside = self.parent[level] >= 0
            np.add.at(self.values, self.parent[level][inside], message[inside])

    def down(self, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log beliefs of all, and the joint counts of directories and those above; ``above``: what the parents outside believe, NaN where there is none."""
        beliefs, joint = self.values.copy(), np.zeros(len(LABELS) ** 2)
        for level in self.levels:
            inside = self.parent[level] >= 0
            before = np.where(inside[:, None], beliefs[self.parent[level]], above[level])
            at = level[~np.isnan(before).any(axis=1) & ~self.named[level]]
            m = before[np.isin(level, at)] - self.sent[at]
            beliefs[at] = self.values[at] + _downward(m, self.given)
            joint += _joint(m, self.values[at], self.given)
        return beliefs, joint


def _roots_up(given: np.ndarray):
    def subtrees(table: pa.Table) -> pa.Table:
        tree = _Tree(table, given)
        tree.up()
        at = np.flatnonzero(tree.parent < 0)
        parents = [tree.parents[i] for i in at.tolist()]
        return pa.table({"dir": pa.array(parents, pa.string()), **{c: tree.sent[at, i] for i, c in enumerate(_U)}})

    return subtrees


def _both_ways(given: np.ndarray):
    def subtrees(table: pa.Table) -> pa.Table:
        tree = _Tree(table, given)
        tree.up()
        beliefs, joint = tree.down(np.stack([table.column(c).to_numpy() for c in _T], axis=1).astype(float))
        # the last row has no directory but the joint counts
        rows = {"dir": pa.array([*tree.paths, None], pa.string()), **{c: np.append(beliefs[:, i], 0.0) for i, c in enumerate(_B)}}
        return pa.table(rows | {"joint": pa.array([*[None] * len(tree.paths), joint.tolist()], pa.list_(pa.float64()))})

    return subtrees


_DIR_BELIEFS = f"dir string, {_FIVE(_B)}, joint array<double>"


def _directories(received: DataFrame, given: np.ndarray) -> DataFrame:
    """Log beliefs (dir, b0 ... b4, joint) of all directories that have files below, and rows without a dir that hold joint counts; received: dir, u0 ... u4.

    A directory with no more than SUBTREE directories below it is worked on in one task with all of them, many small such trees together. Those above, at most
    a SUBTREE-th of all for each level of depth, are a tree of their own, in one task: the trees below send up what their roots say, and
    get what the top believes.
    """
    every = F.expr("transform(sequence(0, size(split(dir, '/'))), i -> array_join(slice(split(dir, '/'), 1, i), '/'))")
    every = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(every)
    counts = shared_table(received.select(F.explode(every).alias("dir")).groupBy("dir").agg(F.count("*").alias("n")), "directories")
    dirs = counts.select("dir").join(received, "dir", "left").na.fill(0.0)
    top = counts.where(F.col("n") > SUBTREE).select(F.col("dir").alias("top"))
    nothing = [F.lit(None).cast("double").alias(c) for c in _T]
    if top.isEmpty():
        return dirs.select(F.lit(0).alias("one"), "dir", *_U, *nothing).groupBy("one").applyInArrow(_both_ways(given), _DIR_BELIEFS)
    levels_in_top = counts.select("dir", F.explode(every).alias("top")).join(top, "top").groupBy("dir").agg(F.count("*").cast("int").alias("k"))
    placed = dirs.join(levels_in_top, "dir", "left").withColumn("root", F.get(every, F.coalesce("k", F.lit(0))))
    buckets = max(1, 2 * (counts.where("dir = ''").first()["n"] // SUBTREE))
    placed = shared_table(placed.select("dir", "root", F.pmod(F.xxhash64("root"), F.lit(buckets)).alias("bucket"), *_U), "placed")
    trees = placed.where("root is not null")
    sums = [F.sum(c).alias(c) for c in _U]
    upper = trees.groupBy("bucket").applyInArrow(_roots_up(given), f"dir string, {_FIVE(_U)}").unionByName(placed.where("root is null").select("dir", *_U))
    upper = upper.groupBy("dir").agg(*sums).select(F.lit(0).alias("one"), "dir", *_U, *nothing)
    upper = shared_table(upper.groupBy("one").applyInArrow(_both_ways(given), _DIR_BELIEFS), "top")
    believed = upper.where("dir is not null").select(F.col("dir").alias("parent"), *(F.col(b).alias(t) for b, t in zip(_B, _T)))
    at_root = F.when(F.col("dir") == F.col("root"), _parent(F.col("dir")))
    lower = trees.withColumn("parent", at_root).join(believed, "parent", "left").select("dir", "bucket", *_U, *_T)
    return lower.groupBy("bucket").applyInArrow(_both_ways(given), _DIR_BELIEFS).unionByName(upper)


def _believe(given: np.ndarray):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch, _P)
            above = _matrix(batch, _B) - _matrix(batch, _U)
            log = own + _downward(above, given)
            belief = np.exp(log - _log_sum(log, 1)[:, None])
            joint = pa.array([*[None] * (batch.num_rows - 1), _joint(above, own, given).tolist()], pa.list_(pa.float64()))
            columns = [batch.column(c) for c in ("id", "path", "grams")]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, belief.T.copy()), joint], ["id", "path", "grams", *_B, "joint"])

    return split


def propagate(files: DataFrame, file_given: np.ndarray = FILE_GIVEN_DIRECTORY, directory_given: np.ndarray = DIRECTORY_GIVEN_PARENT) -> tuple[DataFrame, DataFrame]:
    """Beliefs (id, path, grams, b0 ... b4 that sum to 1, joint) of the files (id, path, grams, p0 ..., u0 ...) after one sweep up and one down, and those of the directories.

    Messages to a directory are added up by an aggregation, so a directory of any number of files costs one row per split. ``joint`` holds expected counts of
    (directory's label, file's label), for many files in one of their rows.
    """
    files = shared_table(files.withColumn("dir", _parent(F.coalesce("path", F.lit("")))), "files")
    received = shared_table(files.groupBy("dir").agg(*(F.sum(c).alias(c) for c in _U)), "received")
    directories = shared_table(_directories(received, directory_given), "beliefs")
    joined = files.join(directories.where("dir is not null").drop("joint"), "dir")
    columns = ["id", "path", "grams", *_P, *_U, *_B]
    beliefs = joined.select(*columns).mapInArrow(_believe(file_given), f"id long, path string, grams array<long>, {_FIVE(_B)}, joint array<double>")
    return beliefs, directories


def _counted(beliefs: DataFrame, typed: np.ndarray, weigh: float) -> np.ndarray:
    """Chances counted under the beliefs, the typed ones counting as ``weigh`` cases of each label above."""
    n = len(LABELS)
    sums = beliefs.where("joint is not null").agg(*(F.coalesce(F.sum(F.col("joint")[i]), F.lit(0.0)) for i in range(n * n))).first()
    counts = np.array(list(sums)).reshape(n, n) + weigh * typed
    return counts / counts.sum(axis=1, keepdims=True)


def header_odds(beliefs: DataFrame, agreed: DataFrame | None) -> DataFrame:
    """gram and the logarithm of its odds for TOLD against handwritten, of the word sequences that say anything: counted over all files under their beliefs, or under the agreed label."""
    rows = beliefs.select("id", "grams", *_B)
    if agreed is not None:
        rows = rows.join(F.broadcast(agreed), "id", "left")
        sure = [F.when(F.col("label").isNull(), F.col(b)).otherwise(0.97 * (F.col("label") == name).cast("double") + 0.03 * F.col(b)).alias(b) for b, name in zip(_B, LABELS)]
        rows = rows.select("id", "grams", *sure)
    rows = shared_table(rows, "believed")
    whole = rows.agg(*(F.coalesce(F.sum(b), F.lit(0.0)) for b in _B)).first()
    by_hand = LABELS.index("handwritten")
    counts = rows.select(F.explode("grams").alias("gram"), *_B).groupBy("gram").agg(F.count("*").alias("n"), *(F.sum(b).alias(b) for b in _B)).where(F.col("n") >= GRAM_FILES)
    share = lambda i: F.log((F.col(_B[i]) + GRAM_START) / (whole[i] + 1))
    odds = counts.select("gram", *((share(LABELS.index(name)) - share(by_hand)).alias(f"told_{name}") for name in TOLD))
    least = GRAM_LEAST / GRAM_POWER
    return shared_table(odds.where(" or ".join(f"{c} >= {least}" for c in _TOLD)), "odds")


def told_by_headers(own: DataFrame, odds: DataFrame) -> DataFrame:
    """id and, for TOLD, the greatest odds among the word sequences of the file's header, raised and bounded; 0 below what says anything."""
    best = own.select("id", F.explode("grams").alias("gram")).join(odds, "gram").groupBy("id").agg(*(F.max(c).alias(c) for c in _TOLD))
    raised = lambda c: F.least(F.col(c) * GRAM_POWER, F.lit(GRAM_MOST))
    return best.select("id", *(F.when(raised(c) >= GRAM_LEAST, raised(c)).otherwise(0.0).alias(c) for c in _TOLD))


def file_kinds(files: DataFrame, key: Column, path: Column, text: Column, labels: DataFrame | None = None, patterns: DataFrame | None = None) -> DataFrame:
    """id, path, label and belief of every distinct file.

    Files with a null text or id give no row. An empty text is a file without evidence but that of its name and place; a null path is a file in the
    root. Of rows that repeat an id one counts.
    """
    own = own_features(files, key, path, text, patterns)
    agreed = agreed_labels(labels)
    evidence = evidence_of(own)
    first, directories = propagate(scored(evidence, fitted_weights(evidence, agreed)))
    first = shared_table(first, "first")
    of_file, of_directory = _counted(first, FILE_GIVEN_DIRECTORY, FILES_WEIGH), _counted(directories, DIRECTORY_GIVEN_PARENT, DIRECTORIES_WEIGH)
    evidence = evidence_of(own, told_by_headers(own, header_odds(first, agreed)))
    beliefs, _ = propagate(scored(evidence, fitted_weights(evidence, agreed), of_file), of_file, of_directory)
    best = F.greatest(*_B)
    label = F.lit(LABELS[-1])
    for i in reversed(range(len(LABELS) - 1)):
        label = F.when(F.col(_B[i]) == best, LABELS[i]).otherwise(label)
    return beliefs.select("id", "path", label.alias("label"), best.alias("belief"))
