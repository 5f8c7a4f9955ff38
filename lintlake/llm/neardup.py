"""Near-duplicate texts by an LSH forest of minhash signatures, with exact verification.

Texts with the same set of shingles form one class with one representative, so a group of copies of any size is one
entry from here on. Every tree of the forest is a sorted order of the representatives by their signature in it: the tree, then seven minhash
values. What neighbours in the order have in common is a longest common prefix of values; a region is a run of entries in which it has a
given depth. Regions of three values give the candidates. One of more than ``REGION`` members is too shallow there and is taken apart
in the same order, by prefixes of five values and then of seven; as a pair meets more rarely at that depth, its members, and only they,
are sorted in further trees, as many as keep the chance to meet (see ``trees``). What is still too large at seven values is
compared whole, tile by tile. So no region is cut and no partner is dropped anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.llm.hashing import mixed
from lintlake.session import partitions, release, shared_table, spread

#: Prefix lengths of regions, and the chance that a pair right at the threshold shares none of a length in all trees that have it.
DEPTHS, MISS = (3, 5, 7), 1e-4
#: Members of a region that are compared with each other; beyond it the region is taken apart by longer prefixes.
REGION = 1000
#: Members of a region of the first depth up to which it gives its pairs at once; larger ones are compared by sketches first.
FEW = 8
#: Members of a tile, and rows of it that are compared at a time.
TILE, STRIP = 8192, 512
#: Minhashes of the sketch of a class, two bits of each, and how many deviations below the threshold their agreement may lie. At a
#: threshold of 0.6 this lets one pair in a hundred thousand at the threshold slip, and one in two thousand with a similarity of a third pass.
SKETCH, DEVIATIONS = 320, 4.3
_BYTES, _LOW = SKETCH // 4, np.uint64(0x5555555555555555)

_TOKEN = regex.compile(r"[a-z0-9_]+")


def shingle_hashes(text: str | None, size: int, fewest_tokens: int) -> np.ndarray | None:
    """Sorted distinct 64-bit hashes of the sequences of ``size`` consecutive tokens; None for texts with too few tokens."""
    tokens = _TOKEN.findall(text.lower()) if text else []
    if len(tokens) < max(fewest_tokens, size):
        return None
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(" ".join(tokens[i : i + size])) for i in range(len(tokens) - size + 1)), np.uint64))


def trees(depth: int, threshold: float) -> int:
    """Trees of prefix length ``depth`` in which a pair at the threshold has a common prefix at least once, but for a chance of MISS."""
    return math.ceil(math.log(MISS) / math.log1p(-(threshold**depth)))


def _minima(values: np.ndarray, starts: np.ndarray, factor: np.uint64) -> np.ndarray:
    return np.minimum.reduceat(values * factor, starts)


def _sketches(sets: list[np.ndarray]) -> pa.Array:
    """SKETCH minhashes of every set, two bits of each."""
    sketch = np.zeros((len(sets), _BYTES), np.uint8)
    if sets:
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        starts, values = np.cumsum(size) - size, mixed(np.concatenate(sets))
        for i, f in enumerate(_factors(SKETCH, 1_000_003)):
            sketch[:, i // 4] |= (mixed(_minima(values, starts, f)) & np.uint64(3)).astype(np.uint8) << np.uint8(2 * (i % 4))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(_BYTES), len(sets), [None, pa.py_buffer(sketch.tobytes())]).cast(pa.binary())


def _sets(size: int, fewest: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, sets = [], [], []
            for i, t in zip(batch.column("id").to_pylist(), batch.column("text__").to_pylist()):
                s = shingle_hashes(t, size, fewest)
                if s is not None:
                    ids.append(i)
                    keys.append(xxhash.xxh128_digest(s.tobytes()))
                    sets.append(s)
            lists = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), lists, _sketches(sets)], ["id", "set_key", "shingles", "sketch"])

    return split


def shingle_sets(df: DataFrame, key: Column, text: Column, size: int, fewest_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Classes (class_id, shingles, sketch) and members (id, class_id): the class of a text is the least id with the same set of shingles."""
    rows = spread(df.select(key.cast("long").alias("id"), text.alias("text__")).where("id is not null"))
    sets = shared_table(rows.mapInArrow(_sets(size, fewest_tokens), "id long, set_key binary, shingles array<long>, sketch binary"), "sets")
    first = sets.groupBy("set_key").agg(F.min("id").alias("class_id"))
    members = shared_table(sets.select("id", "set_key").join(first, "set_key").select("id", "class_id").distinct(), "members")
    classes = sets.join(members.where("id = class_id").select("id"), "id").dropDuplicates(["id"]).select(F.col("id").alias("class_id"), "shingles", "sketch")
    classes = shared_table(classes, "classes")
    release(sets)
    return classes, members


def _factors(n: int, seed: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(2 * seed + 3)) | np.uint64(1)


#: An entry's place in the order of the forest is its tree and three values of 16 bits (head), then four of 8 bits (tail), which only take large regions apart.
_HEAD_VALUES, _HEAD_BITS, _TAIL_VALUES, _TAIL_BITS = 3, 16, 4, 8


def _grow(first: int, last: int):
    """Rows (head, tail, class_id) for every tree from ``first`` on, ``last`` excluded."""
    values_of_tree = _HEAD_VALUES + _TAIL_VALUES
    factors = _factors(values_of_tree * last, 0)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("shingles")
            sizes = lists.value_lengths().to_numpy()
            starts, values = np.cumsum(sizes) - sizes, mixed(lists.flatten().to_numpy().view(np.uint64))
            for tree in range(first, last):
                head, tail = np.full(len(sizes), tree, np.int64), np.zeros(len(sizes), np.int64)
                for i, f in enumerate(factors[tree * values_of_tree : (tree + 1) * values_of_tree]):
                    least = mixed(_minima(values, starts, f))
                    if i < _HEAD_VALUES:
                        head = head << _HEAD_BITS | (least >> np.uint64(64 - _HEAD_BITS)).astype(np.int64)
                    else:
                        tail = tail << _TAIL_BITS | (least >> np.uint64(64 - _TAIL_BITS)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(head), pa.array(tail), batch.column("class_id")], ["head", "tail", "class_id"])

    return split


def _in_order(rows: DataFrame, trees_from: int, trees_to: int) -> DataFrame:
    """The sorted orders of the trees, one after the other, over partitions of equal ranges of tree and first value.

    Values are hashes, so these bounds need no sample, and a region, whose members share their first value, lies in one partition.
    """
    n = max(partitions(rows.sparkSession), rows.rdd.getNumPartitions())
    place = F.shiftright("head", (_HEAD_VALUES - 1) * _HEAD_BITS) - F.lit(trees_from << _HEAD_BITS)
    part = F.floor(place * F.lit(n) / F.lit((trees_to - trees_from) << _HEAD_BITS)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("head", "tail", "class_id")


def _least_agreement(threshold: float) -> int:
    """Equal two-bit values of two sketches that a pair at the threshold falls short of only by DEVIATIONS standard deviations."""
    equal = threshold + (1 - threshold) / 4
    return max(1, math.floor(SKETCH * equal - DEVIATIONS * math.sqrt(SKETCH * equal * (1 - equal))))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two-bit values in which words of 64 bits differ."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x &= _LOW
    return np.bitwise_count(x)


def _agreeing(left: np.ndarray, right: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``left`` and j of ``right`` whose sketches agree in at least ``least`` values, counted word by word over the whole table of pairs."""
    differing = np.zeros((len(left), len(right)), np.uint16)
    for a, b in zip(np.ascontiguousarray(left.T), np.ascontiguousarray(right.T)):
        differing += _differing(a[:, None], b[None, :])
    return np.nonzero(differing <= SKETCH - least)


PAIR, MEMBER, LARGE = 0, 1, 2
_FOUND = "kind int, level int, head long, tail long, a long, b long"


def _found(kind: int, level: int, head: np.ndarray, tail: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    n = len(a)
    columns = [pa.array(np.full(n, kind, np.int32)), pa.array(np.full(n, level, np.int32)), pa.array(head), pa.array(tail), pa.array(a), pa.array(b) if b is not None else pa.nulls(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "level", "head", "tail", "a", "b"])


def _runs(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (tail[1:] != tail[:-1]))) if len(head) else np.zeros(0, np.int64)


class _Region:
    """Takes the sorted entries of a partition apart into runs with a common prefix of DEPTHS[level] values, as they come; holds no more than a batch and a region."""

    def __init__(self, level: int, first: int) -> None:
        self.level, self.first = level, first
        below = _TAIL_BITS * (_HEAD_VALUES + _TAIL_VALUES - DEPTHS[level])
        self.mask = -1 << below
        self.held = [np.zeros(0, np.int64)] * 3
        self.inner: _Region | None = None  # of the run now coming, if that is known to be too large
        self.key = (0, 0)

    def feed(self, head: np.ndarray, tail: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.inner:
            same = (head == self.key[0]) & (tail & self.mask == self.key[1])
            n = len(head) if same.all() else int(np.argmin(same))
            yield from self._large(head[:n], tail[:n], ids[:n])
            head, tail, ids = head[n:], tail[n:], ids[n:]
            if not len(head):
                return
            yield from self._leave()
        head, tail, ids = (np.concatenate([h, x]) for h, x in zip(self.held, (head, tail, ids)))
        start = _runs(head, tail & self.mask)
        last = int(start[-1]) if len(start) else 0
        yield from self._whole(head[:last], tail[:last], ids[:last])
        self.held = [x[last:].copy() for x in (head, tail, ids)]
        if len(self.held[0]) > REGION:
            self.key = (int(self.held[0][0]), int(self.held[1][0]) & self.mask)
            self.inner = _Region(self.level + 1, self.first) if self.level + 1 < len(DEPTHS) else self
            yield from self._large(*self.held)
            self.held = [x[:0] for x in self.held]

    def _large(self, head: np.ndarray, tail: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield _found(LARGE, self.level, head, tail & self.mask, ids)
        if self.inner is not self:
            yield from self.inner.feed(head, tail, ids)

    def _leave(self) -> Iterator[pa.RecordBatch]:
        if self.inner is not None and self.inner is not self:
            yield from self.inner.finish()
        self.inner = None

    def finish(self) -> Iterator[pa.RecordBatch]:
        yield from self._leave()
        yield from self._whole(*self.held)
        self.held = [x[:0] for x in self.held]

    def _whole(self, head: np.ndarray, tail: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Runs that are complete: pairs of few members, members of more, and those too large."""
        prefix = tail & self.mask
        start = _runs(head, prefix)
        length = np.diff(np.append(start, len(head)))
        size = np.repeat(length, length)
        few = (size > 1) & (size <= FEW) if self.level == 0 else np.zeros(len(size), bool)
        run, member = np.repeat(start, length)[few], ids[few]
        for distance in range(1, FEW):
            at = np.flatnonzero(run[:-distance] == run[distance:]) if len(run) > distance else np.zeros(0, np.int64)
            at = at[member[at] != member[at + distance]]
            if len(at):
                a, b = member[at], member[at + distance]
                nothing = np.zeros(len(a), np.int64)
                yield _found(PAIR, self.level, nothing, nothing, np.minimum(a, b), np.maximum(a, b))
        more = (size > 1) & (size <= REGION) & ~few
        if more.any():
            yield _found(MEMBER, self.level, head[more], prefix[more], ids[more])
        for i, n in zip(start[length > REGION].tolist(), length[length > REGION].tolist()):
            part = [x[i : i + n] for x in (head, tail, ids)]
            yield _found(LARGE, self.level, part[0], part[1] & self.mask, part[2])
            if self.level + 1 < len(DEPTHS):
                inner = _Region(self.level + 1, self.first)
                yield from inner.feed(*part)
                yield from inner.finish()


def _neighbours(level: int):
    """From entries in the order of the forest: pairs, members of regions to compare, and members of regions that are too large at a level."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region = _Region(level, level)
        for batch in batches:
            yield from region.feed(*(batch.column(c).to_numpy() for c in ("head", "tail", "class_id")))
        yield from region.finish()

    return split


def _sketch_rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), _BYTES // 8)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _compare(ids: np.ndarray, sketches: np.ndarray, other_ids: np.ndarray, others: np.ndarray, least: int) -> Iterator[pa.Table]:
    """Pairs of different ids, a < b, whose sketches agree in at least ``least`` values, some rows at a time."""
    for i in range(0, len(ids), STRIP):
        x, y = _agreeing(sketches[i : i + STRIP], others, least)
        x, y = ids[i : i + STRIP][x], other_ids[y]
        keep = x != y
        if keep.any():
            yield pa.table({"a": np.minimum(x, y)[keep], "b": np.maximum(x, y)[keep]}, _PAIRS)


def _within(least: int):
    def compare(table: pa.Table) -> pa.Table:
        """Members of one region with each other."""
        ids, sketches = table.column("class_id").to_numpy(), _sketch_rows(table.column("sketch"))
        found = list(_compare(ids, sketches, ids, sketches, least))
        return pa.concat_tables(found).group_by(["a", "b"]).aggregate([]) if found else _PAIRS.empty_table()

    return compare


def _tile(least: int):
    def compare(table: pa.Table) -> pa.Table:
        """Members of two blocks of a region (or of one with itself) with each other."""
        ids, sketches = table.column("class_id").to_numpy(), _sketch_rows(table.column("sketch"))
        own = table.column("own").to_numpy()
        right = own if table.column("i")[0].as_py() == table.column("j")[0].as_py() else ~own
        found = list(_compare(ids[own], sketches[own], ids[right], sketches[right], least))
        return pa.concat_tables(found).group_by(["a", "b"]).aggregate([]) if found else _PAIRS.empty_table()

    return compare


def _tiles(rows: DataFrame, least: int) -> DataFrame:
    """All members of every region (head, tail) with each other: blocks of about TILE members, one unit of work for each two blocks."""
    blocks = rows.groupBy("head", "tail").agg(F.ceil(F.count("*") / TILE).cast("int").alias("blocks"))
    rows = rows.join(blocks, ["head", "tail"]).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("head", "tail", "class_id", "sketch", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") <= F.col("other")).alias("own"))
    return rows.groupBy("head", "tail", "i", "j").applyInArrow(_tile(least), "a long, b long")


def _alike(least: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = _sketch_rows(batch.column("left")), _sketch_rows(batch.column("right"))
            same = SKETCH - _differing(left, right).sum(axis=1, dtype=np.int32) >= least
            yield batch.select(["a", "b"]).filter(pa.array(same))

    return split


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs a < b of class ids that share a region of the forest and have similar enough sketches."""
    least = _least_agreement(threshold)
    sketches = classes.select("class_id", "sketch")
    entries, tables, grown = classes.select("class_id", "shingles"), [], 0
    for level, depth in enumerate(DEPTHS):
        n_trees = trees(depth, threshold)
        ordered = _in_order(entries.mapInArrow(_grow(grown, n_trees), "head long, tail long, class_id long"), grown, n_trees)
        tables.append(shared_table(ordered.mapInArrow(_neighbours(level), _FOUND), f"forest{depth}"))
        grown = n_trees
        found = reduce(DataFrame.unionByName, tables)
        large = found.where((F.col("kind") == LARGE) & (F.col("level") == level))
        if large.isEmpty():
            break
        if level + 1 < len(DEPTHS):
            entries = shared_table(entries.join(large.select(F.col("a").alias("class_id")).distinct(), "class_id"), "deeper")
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").distinct()
    pairs = pairs.join(sketches.select(F.col("class_id").alias("a"), F.col("sketch").alias("left")), "a").join(sketches.select(F.col("class_id").alias("b"), F.col("sketch").alias("right")), "b")
    out = pairs.mapInArrow(_alike(least), "a long, b long")
    members = found.where(F.col("kind") == MEMBER)
    if not members.isEmpty():
        members = members.select("level", "head", "tail", F.col("a").alias("class_id")).join(sketches, "class_id")
        out = out.unionByName(members.groupBy("level", "head", "tail").applyInArrow(_within(least), "a long, b long"))
    deepest = found.where((F.col("kind") == LARGE) & (F.col("level") == len(DEPTHS) - 1))
    if len(tables) == len(DEPTHS) and not deepest.isEmpty():
        out = out.unionByName(_tiles(deepest.select("head", "tail", F.col("a").alias("class_id")).join(sketches, "class_id"), least))
    return out.distinct()


def similar_classes(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b, similarity of the pairs of classes at or above the threshold, by the exact sets of shingles."""
    pairs = shared_table(candidates(classes, threshold), "candidates")
    wanted = pairs.select(F.col("a").alias("class_id")).unionByName(pairs.select(F.col("b").alias("class_id"))).distinct()
    sets = shared_table(classes.select("class_id", "shingles").join(wanted, "class_id", "left_semi"), "compared")
    left = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    joined = joined.withColumn("similarity", F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")))
    return shared_table(joined.where(F.col("similarity") >= threshold - 1e-12).select("a", "b", "similarity"), "similar")


def components(edges: DataFrame) -> DataFrame:
    """node and group_id (the least node reached) for every node of the edges (a, b), by large-star and small-star rounds.

    Every round is a minimum per node (combined before the shuffle) and a join on the node; the edges are written to the shared folder
    between rounds. Nothing but the test for a fixpoint comes to the driver.
    """
    edges = shared_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = shared_table(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = shared_table(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        changed = small.exceptAll(edges).isEmpty() and edges.exceptAll(small).isEmpty()
        edges = small
        if changed:
            break
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("group_id"))
    return nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("group_id"))).distinct()


def near_duplicates(df: DataFrame, key: Column, text: Column, size: int = 3, threshold: float = 0.6, fewest_tokens: int = 20) -> tuple[DataFrame, DataFrame]:
    """Similar pairs of class ids (a, b, similarity) and the members (id, class_id) of every class.

    Tokens are the longest runs of a-z, 0-9 and _ in the lower-cased text; similarity is that of the sets of ``size`` consecutive tokens.
    Null, empty and short texts (fewer than ``fewest_tokens`` tokens) are in no class; rows that repeat an id with the same text count
    once. Copies are in one class and appear in pairs only through it. Members of a class have similarity 1.
    """
    classes, members = shingle_sets(df, key, text, size, fewest_tokens)
    return similar_classes(classes, threshold), members


def all_pairs(similar: DataFrame, members: DataFrame) -> DataFrame:
    """a < b, the pairs of ids themselves: of every similar pair of classes and within every class. Its size is that of the result.

    The members of a large class are split by a hash into parts of about REGION, and each part meets each other one on a key of its own.
    """
    left, right = members.select(F.col("class_id").alias("a"), F.col("id").alias("x")), members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    across = similar.join(left, "a").join(right, "b").select("x", "y")
    many = members.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select("class_id", F.ceil(F.col("n") / REGION).cast("int").alias("parts"))
    inside = members.join(many, "class_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    first = inside.select("class_id", F.col("id").alias("x"), F.col("part").alias("i"), each.alias("j"))
    second = inside.select("class_id", F.col("id").alias("y"), each.alias("i"), F.col("part").alias("j"))
    within = first.join(second, ["class_id", "i", "j"]).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def duplicate_groups(similar: DataFrame, members: DataFrame) -> DataFrame:
    """id, class_id, group_id (least id of the connected classes) and n_links (other ids at or above the threshold) of every id that has a class."""
    sizes = members.groupBy("class_id").agg(F.count("*").alias("size"))
    links = similar.select("a", "b").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = links.join(sizes.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("beyond"))
    groups = components(similar).withColumnRenamed("node", "class_id")
    per_class = sizes.join(linked, "class_id", "left").join(groups, "class_id", "left")
    n_links = F.coalesce("beyond", F.lit(0)) + F.col("size") - 1
    per_class = per_class.select("class_id", F.coalesce("group_id", "class_id").alias("group_id"), n_links.alias("n_links"))
    return members.join(per_class, "class_id").select("id", "class_id", "group_id", "n_links")
