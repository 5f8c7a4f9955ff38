"""Session helpers: tables, partition counts and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    """The shuffle partitions of the session; every explicit repartition follows them."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df``, a scan, over at least as many tasks as the session has cores: a small file is one split, however long each of its rows takes."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def input_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads, from their listing; None for a table whose size the planner doesn't know."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return None if any(n > 1 << 60 for n in sizes) else sum(sizes)


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: spark.checkpoint.dir, or the checkpoint folder set on the context.

    Where neither is set: a temporary folder if driver and executors are on one machine (tests), else one below the warehouse, which is shared too.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return "file://" + os.path.join(tempfile.gettempdir(), f"lintlake-{os.getpid()}")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lintlake"


_written: list[tuple[SparkSession, str]] = []


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    _written[:] = [x for x in _written if x not in tables]
    for spark, path in tables:
        try:
            jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001 - the session may be gone, the folder is temporary
            pass


def clear(spark: SparkSession | None = None) -> None:
    """Remove the intermediate tables written so far (by ``spark``, or by any session): for long sessions, once the results that read them have been taken."""
    _remove([(s, p) for s, p in _written if spark is None or s is spark])


atexit.register(clear)


def shared_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as parquet to the shared folder and read it back.

    Cuts the lineage like checkpoint(), but columnar and compressed; the files outlive any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Remove the files of a shared table that nothing yet to run reads."""
    spark = df.sparkSession
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    _remove([(s, p) for s, p in _written if s is spark and any(f.endswith(p.rsplit("/", 1)[1]) for f in paths)])
