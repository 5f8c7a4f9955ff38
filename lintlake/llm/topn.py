"""The N first items of every group, by exact positions in a globally sorted table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lintlake.session import partitions, shared_table

#: Rows of a split that are sorted together when it drops what cannot be among the first N.
PRUNE_ROWS = 1 << 18


def _changes(table: pa.Table, columns: list[str]) -> np.ndarray:
    """True where a row of the sorted table differs from the row before it in any of the columns."""
    n = table.num_rows
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for c in columns:
        col = table.column(c).combine_chunks()
        out[1:] |= ~pc.fill_null(pc.equal(col.slice(1), col.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
    return out


def _positions(starts: np.ndarray) -> np.ndarray:
    """1, 2, 3 ... from every start on."""
    at = np.arange(len(starts))
    return at - np.maximum.accumulate(np.where(starts, at, 0)) + 1


def _prune(order: list[tuple[str, str]], n: int):
    def first(batches: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(batches)
        table = table.take(pc.sort_indices(table, sort_keys=order))
        table = table.filter(pa.array(_changes(table, [c for c, _ in order])))
        return table.filter(pa.array(_positions(_changes(table, ["group__"])) <= n))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PRUNE_ROWS:
                yield from first(held).to_batches()
                held = []
        if held:
            yield from first(held).to_batches()

    return split


def _place(columns: list[str], n: int, schema: pa.Schema):
    """Rows of a sorted partition with positions inside it up to ``n``, then one summary row for each end of the partition."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: pa.Table | None = None
        last_position, first_group, single = 0, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            carried = last is not None
            both = pa.concat_tables([last, table]) if carried else table
            new, start = _changes(both, columns), _changes(both, ["group__"])
            if carried:
                new, start = new[1:], start[1:]
            else:
                first_group = table.column("group__")[0].as_py()
            # a repeated row takes no position of its own
            at = np.cumsum(new)
            begin = np.where(start, at - 1, -1)
            begin = np.maximum.accumulate(begin)
            position = np.where(begin < 0, at + last_position, at - begin)
            single &= not (start if carried else start[1:]).any()
            last, last_position = table.slice(table.num_rows - 1), int(position[-1])
            keep = pa.array(new & (position <= n))
            out = table.append_column("position", pa.array(position)).append_column("part__", pa.array(np.full(len(position), part, np.int32)))
            out = out.append_column("last__", pa.nulls(len(position), pa.string())).filter(keep)
            yield from out.select(schema.names).cast(schema).to_batches()
        if last is not None:
            row = {f.name: None for f in schema} | {"group__": first_group, "part__": part, "last__": last.column("group__")[0].as_py(), "position": last_position}
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    return split


def top_n_per_group(df: DataFrame, group: Column, order: list[tuple[Column, bool]], item: Column, n: int) -> DataFrame:
    """The first ``n`` distinct items of every group: group_key, the order columns o0, o1 ..., item_id, position (from 1).

    ``order`` lists (column, ascending); the item identifier breaks remaining ties ascending, strings compare by their UTF-8
    bytes. Rows whose group, any order column or item is null or NaN are left out. Rows equal in all of group, order and
    item count once. An empty table gives no rows.

    The whole table is range-partitioned and sorted on (group, order, item), so a group of any size spreads over as many
    partitions as its share of the rows asks for. A partition knows positions only from its own start; the count of its
    last group is prefix-summed over the partitions that the group spans, which is one row a partition, and added to
    the positions of the partition's first group. Before the shuffle every split drops rows that already have ``n``
    better ones of their group beside them, which cannot change a position up to ``n``.
    """
    spark = df.sparkSession
    names = ["group__", *(f"o{i}" for i in range(len(order))), "item_id"]
    rows = df.select(group.cast("string").alias("group__"), *(c.alias(f"o{i}") for i, (c, _) in enumerate(order)), item.alias("item_id"))
    for f in rows.schema.fields:
        rows = rows.where(F.col(f.name).isNotNull())
        if f.dataType.typeName() in ("double", "float"):
            rows = rows.where(~F.isnan(f.name)).withColumn(f.name, F.col(f.name) + F.lit(0.0).cast(f.dataType))
    ways = [True, *(up for _, up in order), True]
    # written once: the range partitioning reads them twice, to sample and to sort
    pruned = shared_table(rows.mapInArrow(_prune([(c, "ascending" if up else "descending") for c, up in zip(names, ways)], n), rows.schema), "pruned")
    keys = [F.col(c).asc() if up else F.col(c).desc() for c, up in zip(names, ways)]
    ordered = pruned.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    placed_schema = StructType([
        *(StructField(f.name, f.dataType) for f in rows.schema.fields),
        StructField("position", LongType()), StructField("part__", IntegerType()), StructField("last__", StringType()),
    ])
    placed = shared_table(ordered.mapInArrow(_place(names, n, to_arrow_schema(placed_schema)), placed_schema), "topn")

    # One summary row a partition: what a group has in the partitions before it is the sum over the run of partitions that ends there.
    ends = sorted(placed.where(F.col("last__").isNotNull()).select("part__", "group__", "last__", "position").collect())
    before, carried, group_now = [], 0, None
    for part, first, last, count in ends:
        offset = carried if first == group_now else 0
        if offset:
            before.append((part, first, offset))
        carried = count + (offset if first == last else 0)
        group_now = last
    items = placed.where(F.col("last__").isNull()).drop("last__")
    if before:
        offsets = spark.createDataFrame(before, "part__ int, group__ string, offset__ long")
        items = items.join(F.broadcast(offsets), ["part__", "group__"], "left")
        items = items.withColumn("position", F.col("position") + F.coalesce("offset__", F.lit(0))).drop("offset__")
    return items.where(F.col("position") <= n).drop("part__").withColumnRenamed("group__", "group_key")


