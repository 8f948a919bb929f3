"""The folder that driver and executors share, and global order without a global task."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where none is named a session on one machine, as in tests, gets one of its own; on a cluster that is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder, which outlives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_few(rows: DataFrame, table: DataFrame, on: str, few: int = 1 << 17) -> DataFrame:
    """rows joined with a table of one row for each value of `on`, as the branches of a tree. Rows dealt by few values are in few tasks, so few values are broadcast; of many Spark decides."""
    table = checkpointed(table)
    return rows.join(F.broadcast(table) if table.count() <= few else table, on)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is executed inside frees its shuffle files when it ends; its DataFrames aren't to be executed again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Paths of the open scratch() blocks, the innermost last.
_scratches: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Paths of the shared folder that are made inside are deleted when it ends; only what is written outside, or has been executed, may be read after."""
    _scratches.append([])
    try:
        yield
    finally:
        for path in _scratches.pop():
            removed(spark, path)


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, which goes when the application ends, or the scratch() block that it is made in."""
    sc = spark.sparkContext
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(place)
    if _scratches:
        _scratches[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder that nothing reads any more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def staged(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows as a table written to the shared folder, which cuts the lineage and frees the shuffles below."""
    spark = df.sparkSession
    path = path or shared_path(spark, "staged")
    with freed_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def running(rows: DataFrame, order: Sequence[Column | str], sums: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Adds __rank, from 1 in the order, and __sum_<c> for columns c of sums, running sums that include the row; by keys if given.

    No key and no order is sorted in one task: rows are dealt by ranges of (keys, order), ranked inside their range, and a range starts
    after the counts and sums of the ranges before it, which are one row for each range and key.
    """
    order, keys = [F.col(o) if isinstance(o, str) else o for o in order], list(keys)
    parts = checkpointed(rows.repartitionByRange(*[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()))
    inside = W.partitionBy("__part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = parts.withColumns({"__rank": F.row_number().over(inside).cast("long")} | {f"__sum_{c}": F.sum(c).over(inside) for c in sums})
    totals = parts.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in sums])
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = {"__n": "__rank"} | {f"__s_{c}": f"__sum_{c}" for c in sums}
    starts = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p"), *[F.coalesce(F.sum(a).over(earlier), F.lit(0)).alias(f"{b}0") for a, b in before.items()])
    same = ranked["__part"] == starts["__p"]
    for k in keys:
        same &= ranked[k].eqNullSafe(starts[f"__k_{k}"])
    joined = ranked.join(starts, same)
    return joined.withColumns({b: F.col(b) + F.col(f"{b}0") for b in before.values()}).select(*rows.columns, *before.values())
