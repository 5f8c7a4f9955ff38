"""Per-key statistics that do not depend on how rows are spread over keys.

Every input split encodes its keys with a dictionary of its own and adds its rows into dense numpy
arrays (bincount for the counts, scatter-maximum for the latest time). What leaves a split is one array
block per (field, block), the block being a hash range of keys, so a key that holds a third of all rows
costs as much to shuffle as one with a single row. Blocks are summed by a distributed reduction over a tree in
which no task adds more than the blocks of ``FAN_IN`` splits or inner nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintlake.session import partitions, shared_table

#: Keys that a split holds before it sends its blocks on and starts again.
FLUSH_KEYS = 1 << 17
#: Splits, then inner nodes, whose blocks one task of a reduction level adds.
FAN_IN = 64

_BLOCK_SCHEMA = "field_name string, block int, lane int, keys array<string>, counts binary, latest binary"
_NO_TIME = np.iinfo(np.int64).min


class _Dense:
    """Dictionary of keys and the dense arrays that belong to it; code 0 stands for null."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.codes: dict[str | None, int] = {}
        self.counts = np.zeros((1024, width), np.int64)
        self.latest = np.full(1024, _NO_TIME, np.int64)

    def code(self, keys: list[str | None]) -> np.ndarray:
        out = np.fromiter((self.codes.setdefault(k, len(self.codes)) for k in keys), np.int64, len(keys))
        if len(self.codes) > len(self.latest):
            size = max(len(self.codes), 2 * len(self.latest))
            counts, latest = np.zeros((size, self.width), np.int64), np.full(size, _NO_TIME, np.int64)
            counts[: len(self.counts)], latest[: len(self.latest)] = self.counts, self.latest
            self.counts, self.latest = counts, latest
        return out

    def add(self, keys: list[str | None], counts: np.ndarray, latest: np.ndarray) -> None:
        """Add a block whose keys are distinct."""
        at = self.code(keys)
        self.counts[at] += counts
        self.latest[at] = np.maximum(self.latest[at], latest)

    def blocks(self, field: str, n_blocks: int, lane: int) -> Iterator[dict]:
        keys = list(self.codes)
        block = np.fromiter((0 if k is None else xxhash.xxh64_intdigest(k) % n_blocks for k in keys), np.int64, len(keys))
        for b in np.unique(block):
            at = np.flatnonzero(block == b)
            yield {
                "field_name": field, "block": int(b), "lane": lane, "keys": [keys[i] for i in at],
                "counts": self.counts[at].tobytes(), "latest": self.latest[at].tobytes(),
            }


def _batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([
        ("field_name", pa.string()), ("block", pa.int32()), ("lane", pa.int32()),
        ("keys", pa.list_(pa.string())), ("counts", pa.binary()), ("latest", pa.binary()),
    ])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _scatter(fields: list[str], width: int, n_blocks: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane = TaskContext.get().partitionId()
        held = {f: _Dense(width) for f in fields}
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column("kind__").to_numpy(zero_copy_only=False)
            time = batch.column("time__").to_numpy(zero_copy_only=False)
            for f in fields:
                coded = batch.column(f).dictionary_encode(null_encoding="encode")
                at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                size = len(coded.dictionary)
                counts = np.bincount(at * width + kind, minlength=size * width).reshape(size, width)
                latest = np.full(size, _NO_TIME, np.int64)
                np.maximum.at(latest, at, time)
                held[f].add(coded.dictionary.to_pylist(), counts, latest)
                if len(held[f].codes) >= FLUSH_KEYS:
                    yield _batch(list(held[f].blocks(f, n_blocks, lane)))
                    held[f] = _Dense(width)
        for f, dense in held.items():
            if dense.codes:
                yield _batch(list(dense.blocks(f, n_blocks, lane)))

    return split


def _sum_blocks(width: int):
    def add(table: pa.Table) -> pa.Table:
        dense = _Dense(width)
        for row in table.to_pylist():
            n = len(row["keys"])
            dense.add(row["keys"], np.frombuffer(row["counts"], np.int64).reshape(n, width), np.frombuffer(row["latest"], np.int64))
        n = len(dense.codes)
        first = table.slice(0, 1).to_pylist()[0]
        row = first | {"keys": list(dense.codes), "counts": dense.counts[:n].tobytes(), "latest": dense.latest[:n].tobytes()}
        return pa.Table.from_batches([_batch([row])])

    return add


def _unpack(width: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["keys"])
                counts = np.frombuffer(row["counts"], np.int64).reshape(n, width)
                latest = np.frombuffer(row["latest"], np.int64)
                columns = [pa.array([row["field_name"]] * n, pa.string()), pa.array(row["keys"], pa.string()), pa.array(counts.sum(axis=1))]
                columns += [pa.array(counts[:, i]) for i in range(width)]
                columns.append(pa.array(latest, mask=latest == _NO_TIME))
                yield pa.RecordBatch.from_arrays(columns, ["field_name", "key_value", "n_rows", *names, "latest_us"])

    return rows


def dense_key_stats(df: DataFrame, fields: dict[str, Column], kinds: dict[str, Column], latest: Column | None = None) -> DataFrame:
    """Counts by kind and the latest time of every key of every field, in one pass over ``df``.

    fields: name -> string column whose values are the keys. kinds: name -> condition; a row counts under the
    first that holds, else under ``n_other``. latest: a timestamp whose maximum each key keeps.

    Returns field_name, key_value, n_rows, one column per kind, n_other, latest (timestamp). Null is kept as a key of
    its own (key_value null); an empty table gives no rows; a null time never wins and stays null if a key has no other.
    Rows that repeat are all counted. Columns of ``df`` that are not named are not read.
    """
    names, width = [*kinds, "n_other"], len(kinds) + 1
    kind = F.lit(width - 1)
    for i, condition in reversed(list(enumerate(kinds.values()))):
        kind = F.when(condition, F.lit(i)).otherwise(kind)
    time = F.coalesce(F.unix_micros(latest.cast("timestamp")), F.lit(_NO_TIME)) if latest is not None else F.lit(_NO_TIME)
    rows = df.select(*(c.cast("string").alias(f) for f, c in fields.items()), kind.cast("long").alias("kind__"), time.cast("long").alias("time__"))
    blocks = rows.mapInArrow(_scatter(list(fields), width, 4 * partitions(df.sparkSession)), _BLOCK_SCHEMA)
    lanes = rows.rdd.getNumPartitions()
    while lanes > FAN_IN:
        lanes = -(-lanes // FAN_IN)
        blocks = blocks.withColumn("lane", F.floor(F.col("lane") / FAN_IN).cast("int"))
        blocks = blocks.groupBy("field_name", "block", "lane").applyInArrow(_sum_blocks(width), _BLOCK_SCHEMA)
    blocks = blocks.groupBy("field_name", "block").applyInArrow(_sum_blocks(width), _BLOCK_SCHEMA)
    schema = "field_name string, key_value string, n_rows long, " + "".join(f"{n} long, " for n in names) + "latest_us long"
    out = blocks.mapInArrow(_unpack(width, names), schema)
    return out.withColumn("latest", F.timestamp_micros("latest_us")).drop("latest_us")


def heavy_keys(stats: DataFrame, share: float) -> DataFrame:
    """field_name and key_value of the keys that hold at least ``share`` of all rows; null is no key.

    Takes the result of dense_key_stats. All rows of the table count in the denominator, those with a null key included. There are at
    most 1/share such keys in a field, so the comparison runs on the reduced keys, never on rows.
    """
    stats = shared_table(stats, "key-stats")
    total = stats.groupBy("field_name").agg(F.sum("n_rows").cast("decimal(20,0)").alias("all_rows__"))
    kept = stats.where(F.col("key_value").isNotNull()).join(F.broadcast(total), "field_name")
    return kept.where(F.col("n_rows") >= F.lit(Decimal(str(share))) * F.col("all_rows__")).select("field_name", "key_value")
