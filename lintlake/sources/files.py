"""Source-file tables: from a stored table or from a file system."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintlake.functions.syntax import parses
from lintlake.functions.text import line_count
from lintlake.session import partitions, shared_table, table

#: Entries that one folder's walk lists before it hands on what is left.
LIST_ENTRIES = 10_000
#: Bytes of exclude patterns at most.
MOST_PATTERN_BYTES = 1 << 22
_RUST = re.compile(r"[^/]\.rs$")

FILE_SCHEMA = "file_path string, content string, line_count long, byte_ok boolean, parse_ok boolean"


def glob_expression(pattern: str) -> str | None:
    """The expression of an exclude glob: dots escaped, * any run, ? any character, not anchored; None if it doesn't compile."""
    expression = pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".")
    try:
        re.compile(expression)
    except re.error:
        return None
    return expression


def excluded(path: Column, patterns: list[str | None]) -> Column:
    """Whether any valid pattern of a given list matches anywhere in the path. Invalid and null patterns match nothing; an empty one matches everything."""
    out = F.lit(False)
    for expression in {glob_expression(p) for p in patterns if p is not None} - {None}:
        out = out | path.rlike(expression)
    return out


def kept_by_owner(files: DataFrame, patterns: DataFrame) -> DataFrame:
    """owner and file_path of the distinct files that none of the owner's patterns excludes, for every owner of ``patterns`` (owner, pattern).

    Files: a table with file_path. Invalid and null patterns match nothing, so an owner of only such keeps all files; an empty pattern matches everything. A null
    owner is an owner of its own. Each owner's patterns become one expression, so a path is matched once for each owner; owners are a list
    written by hand and are sent to every task, of patterns at most ``MOST_PATTERN_BYTES``: beyond that an error is raised.
    """
    size = patterns.agg(F.coalesce(F.sum(F.octet_length("pattern") + 16), F.lit(0))).first()[0]
    if size > MOST_PATTERN_BYTES:
        raise ValueError(f"more than {MOST_PATTERN_BYTES} bytes of patterns")
    by_owner: dict[str | None, set[str]] = {}
    for owner, pattern in patterns.select("owner", "pattern").collect():
        expression = None if pattern is None else glob_expression(pattern)
        by_owner.setdefault(owner, set()).update(() if expression is None else (expression,))
    paths = files.where("file_path is not null").select("file_path").distinct()
    if not by_owner:
        return paths.limit(0).select(F.lit(None).cast("string").alias("owner"), "file_path")
    kept = [F.when(~(F.col("file_path").rlike("|".join(f"(?:{x})" for x in sorted(xs))) if xs else F.lit(False)), F.struct(F.lit(o).cast("string").alias("owner"))) for o, xs in by_owner.items()]
    return paths.select(F.inline(F.filter(F.array(*kept), lambda x: x.isNotNull())), "file_path")


def is_rust(path: Column) -> Column:
    """Extension exactly rs, on a name that has more than the extension."""
    return path.rlike(r"[^/]\.rs$")


def stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct Rust files of the table source_files with a path, by the schema FILE_SCHEMA; files that aren't UTF-8 have no content and no lines."""
    files = table(spark, sf_dir, "source_files").where(F.col("file_path").isNotNull() & is_rust(F.col("file_path")))
    # the one shuffle of the deduplication, in as many parts as the session wants: by its bytes alone it would be joined into few, and the parser works long on a byte
    files = files.repartition(partitions(spark), "file_path").dropDuplicates(["file_path"])
    ok = F.coalesce("byte_ok", F.lit(False)) & F.col("content").isNotNull()
    content = F.when(ok, F.col("content"))
    lines = F.coalesce(line_count(content), F.lit(0)).cast("long")
    return files.select("file_path", content.alias("content"), lines.alias("line_count"), ok.alias("byte_ok"), (ok & F.coalesce("parse_ok", F.lit(False))).alias("parse_ok"))


def _list(expressions: list[str], entries: int):
    """Rows (path, kind, parent_kind) of what lies below the given folders: files and folders by the name of a source file, and the folders that are left to list."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [re.compile(x) for x in expressions]
        for batch in batches:
            paths, kinds = [], []
            for root in batch.column("path").to_pylist():
                system, start = _file_system(root)
                waiting, seen = [start], 0
                while waiting:
                    if seen >= entries:
                        paths += waiting
                        kinds += ["folder"] * len(waiting)
                        break
                    folder = waiting.pop()
                    try:
                        found = system.get_file_info(fs.FileSelector(folder, recursive=False))
                    except OSError:
                        continue
                    seen += len(found)
                    for info in found:
                        if info.type == fs.FileType.Directory and not _is_link(system, info.path):
                            waiting.append(info.path)
                        if _RUST.search(info.path) and not any(x.search(info.path) for x in wanted):
                            paths.append(info.path)
                            kinds.append("source" if info.type == fs.FileType.File else "named")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(kinds, pa.string())], ["path", "kind"])

    return split


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z][a-z0-9+.\-]+://", path) else (fs.LocalFileSystem(), path)


def _is_link(system: fs.FileSystem, path: str) -> bool:
    return isinstance(system, fs.LocalFileSystem) and os.path.islink(path)


def list_sources(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """path and kind ('source' for a file, 'named' for a folder) of everything below a folder that is named like a source file, hidden ones included.

    Folders are listed by tasks: each walks down its folders until it has seen ``LIST_ENTRIES`` entries and hands on those it didn't come to, which are
    spread over the tasks of the next round. So neither names nor contents pass through the driver, however many there are.
    """
    expressions = [x for x in map(glob_expression, exclude or []) if x is not None]
    scheme = re.match(r"^[a-z][a-z0-9+.\-]+://[^/]*", path)
    folders, out = spark.createDataFrame([(path,)], "path string"), None
    while True:
        found = shared_table(folders.mapInArrow(_list(expressions, LIST_ENTRIES), "path string, kind string"), "listed")
        out = found.where("kind <> 'folder'") if out is None else out.unionByName(found.where("kind <> 'folder'"))
        folders = found.where("kind = 'folder'").select(F.concat(F.lit(scheme.group() + "/"), F.ltrim("path", F.lit("/"))).alias("path") if scheme else "path")
        if folders.isEmpty():
            return out.distinct()
        folders = folders.repartition(partitions(spark))


def _read(root: str):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = _file_system(root)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    with system.open_input_file(name) as f:
                        content = f.read().decode("utf-8")
                except (OSError, UnicodeDecodeError):
                    content = None
                columns = [pa.array([name]), pa.array([content], pa.string()), pa.array([content is not None and parses(content)])]
                yield pa.RecordBatch.from_arrays(columns, ["file_path", "content", "parse_ok"])

    return split


def scan_files(spark: SparkSession, path: str, exclude: list[str] | None = None, single: bool = False) -> DataFrame:
    """Rust files at a path or URI: one file or a folder with all below it, hidden files included; an empty table for a path that doesn't exist.

    Listing and reading are done by tasks, which must see the path. ``single`` reads the file whatever the patterns say. Contents that aren't UTF-8 and files that can't be read stay null.
    """
    system, start = _file_system(path)
    kind = system.get_file_info(start).type
    if kind == fs.FileType.File:
        expressions = [] if single else [x for x in map(glob_expression, exclude or []) if x is not None]
        wanted = _RUST.search(start) and not any(re.search(x, start) for x in expressions)
        listed = spark.createDataFrame([(start,)] if wanted else [], "path string")
    elif kind == fs.FileType.Directory:
        listed = list_sources(spark, path, None if single else exclude).where("kind = 'source'").select("path").repartition(partitions(spark))
    else:
        return spark.createDataFrame([], FILE_SCHEMA)
    files = listed.mapInArrow(_read(path), "file_path string, content string, parse_ok boolean")
    lines = F.coalesce(line_count(F.col("content")), F.lit(0)).cast("long")
    return files.select("file_path", "content", lines.alias("line_count"), F.col("content").isNotNull().alias("byte_ok"), "parse_ok")


def scan_metrics(spark: SparkSession, path: str, exclude: list[str] | None = None) -> DataFrame:
    """One row: n_files, everything at or below the path that is named like a source file, folders and unreadable files too, and n_lines of those that can be read."""
    lines = scan_files(spark, path, exclude).agg(F.count("*").alias("n"), F.coalesce(F.sum("line_count"), F.lit(0)).alias("n_lines"))
    system, start = _file_system(path)
    if system.get_file_info(start).type != fs.FileType.Directory:
        return lines.select(F.col("n").alias("n_files"), "n_lines")
    named = list_sources(spark, path, exclude).where("kind = 'named'").agg(F.count("*").alias("named"))
    own = F.lit(int(bool(_RUST.search(start.rstrip("/"))) and not any(re.search(x, start) for x in map(glob_expression, exclude or []) if x is not None)))
    return lines.select((F.col("n") + named.scalar() + own).alias("n_files"), "n_lines")
