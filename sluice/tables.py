"""Scratch tables in the folder that the driver and all executors share, and running sums made in pieces."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where none is set, local sessions (tests) get a temporary folder; on a cluster
    that is an error, as executors do not see the driver's folders."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_local = threading.local()


def _made() -> list[str]:
    """Scratch paths that this thread of the driver made."""
    if not hasattr(_local, "made"):
        _local.made = []
    return _local.made


def fresh_path(spark: SparkSession, name: str) -> str:
    _made().append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made()[-1]


def scratch_paths() -> int:
    """A mark for drop_scratch: how many scratch paths this thread made so far."""
    return len(_made())


def drop_scratch(spark: SparkSession, since: int = 0, but: Sequence[str] = ()) -> None:
    """Deletes the scratch paths that this thread made since a mark, but for some. Call it once nothing reads them any more: results are lazy."""
    left = _made()[:since]
    for path in _made()[since:]:
        if path in but:
            left.append(path)
            continue
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _made()[:] = left


#: With it on, a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def keep(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: the lineage ends here, and a lost executor costs
    no more than the tasks that read its part. free: the shuffle files of the write go at once."""
    spark = df.sparkSession
    path, before = fresh_path(spark, name), spark.conf.get(CLEANUP, None)
    try:
        if free:
            spark.conf.set(CLEANUP, "true")
        df.write.parquet(path)
    finally:
        if free:
            spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: How many times finer than other tables those are dealt whose groups nearly are their rows.
FINE = 8


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(rows: DataFrame, keys: Sequence[str], part: str, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows before, by keys and in (part, order): summed within each part, then over the
    parts' totals, so that no key's rows meet in one task."""
    sums = rows.groupBy(*keys, part).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    first = sums.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(part).alias("_part"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("_within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = F.col(part).eqNullSafe(F.col("_part"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return out.join(first, same).withColumn(name, F.col("_first") + F.col("_within")).drop("_within", "_part", "_first", *[f"_{k}" for k in keys])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """Adds each row's number from 1 within its keys, in order, by range parts of the whole table: no key's rows meet in one
    task, however many they are. The order should be total, or reruns number ties otherwise."""
    by = [F.col(c) if isinstance(c, str) else c for c in [*keys, *order]]
    spark = rows.sparkSession
    ordered = rows.repartitionByRange(partitions(spark), *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    ordered = keep(ordered.withColumn("_piece", F.shiftright("_at", 33)), "numbered")
    return running(ordered, keys, "_piece", ["_at"], F.lit(1), name).withColumn(name, F.col(name) + 1).drop("_at", "_piece")
