"""Running sums over a globally sorted table, without any group passing through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from lintlake.session import partitions, shared_table


def _running(group: str | None, sums: dict[str, str], schema: pa.Schema):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, last = TaskContext.get().partitionId(), dict.fromkeys(sums, 0), None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            start = np.zeros(n, bool)
            if group:
                keys = batch.column(group)
                start[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
                start[0] = keys[0].as_py() != last
                last = keys[n - 1].as_py()
            before = np.maximum.accumulate(np.where(start, np.arange(n), -1))
            table = pa.Table.from_batches([batch]).append_column("part__", pa.array(np.full(n, part, np.int32)))
            for value, into in sums.items():
                total = np.cumsum(batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64))
                total = total - np.where(before > 0, total[np.maximum(before - 1, 0)], np.where(before == 0, 0, -held[value]))
                held[value] = int(total[-1])
                table = table.append_column(into, pa.array(total))
            yield from table.select(schema.names).cast(schema).to_batches()

    return split


def running_sum(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """``df`` with a column for each of ``sums`` (value: name): the sum of the value over the rows up to this one in the order (group, *order), within the group.

    Values are non-negative integer columns without nulls; ``group`` (no nulls) and ``order`` must make rows distinct, or equal rows get the sums of
    either order. The table is range-partitioned and sorted, every partition sums from its own start, and the totals of the
    partitions before it (one row per partition and group in it, so partitions + groups rows) are added.
    """
    spark = df.sparkSession
    keys = [group, *order] if group else order
    names = list(sums.values())
    schema = StructType([*df.schema.fields]).add("part__", IntegerType())
    for name in names:
        schema = schema.add(name, LongType())
    ordered = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    local = shared_table(ordered.mapInArrow(_running(group, sums, to_arrow_schema(schema)), schema), "running")
    group_column = F.col(group) if group else F.lit("")
    ends = local.groupBy("part__", group_column.cast("string").alias("group__")).agg(*(F.max(name) for name in names)).collect()
    so_far: dict[str, list[int]] = {}
    before = []
    for part, name, *totals in sorted(ends):
        held = so_far.setdefault(name, [0] * len(names))
        if any(held):
            before.append((part, name, *held))
        so_far[name] = [a + b for a, b in zip(held, totals)]
    if before:
        offset = [f"before{i}__" for i in range(len(names))]
        offsets = F.broadcast(spark.createDataFrame(before, "part__ int, group__ string, " + ", ".join(f"{c} long" for c in offset)))
        local = local.withColumn("group__", group_column.cast("string")).join(offsets, ["part__", "group__"], "left")
        local = local.withColumns({name: F.col(name) + F.coalesce(c, F.lit(0)) for name, c in zip(names, offset)}).drop(*offset, "group__")
    return local.drop("part__")
