"""Building blocks shared by the operators: written cut points, joins that
survive hot keys, dense numbering without a global sort in one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, as named by the session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    # Only in local mode do driver and executors share one machine's folders.
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    path = tempfile.mkdtemp(prefix="logtide-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_passing: ContextVar[list[str] | None] = ContextVar("passing", default=None)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Cut points written within the block are deleted at its end, apart from those asked to be kept.

    Only for steps whose results are written too: nothing read later may stem from such a table.
    After each write the driver's garbage is collected, as Spark keeps the shuffle files of a plan
    until the driver happens to drop the plan.
    """
    paths: list[str] = []
    outer = _passing.set(paths)
    try:
        yield paths
    finally:
        _passing.reset(outer)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        jvm.System.gc()


def materialize(df: DataFrame, name: str, passing: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, lets several consumers read
    only the columns they need, and gives the planner true sizes. Within a block of
    ``passing_tables`` it lasts as long as the innermost one, or the one given, unless it is kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    inner = _passing.get()
    if inner is None:
        df.write.parquet(path)
    else:
        if not keep:
            (inner if passing is None else passing).append(path)
        df.write.parquet(path, compression="zstd")
        spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def join_by_key(
    rows: DataFrame, table: DataFrame, keys: list[str], weight: str | None = None, how: str = "left"
) -> DataFrame:
    """Join row-sized data with a table that has one row per key.

    A plain equi join: the planner takes a broadcast for a table of a known small
    size and a sort-merge join otherwise. There, adaptive execution cuts every
    partition above the skew threshold into parts of the advisory size, however many
    keys are hot (``plans.session`` sets the factor over the median to nothing), and
    each part meets the rows of its keys. ``weight``, the table's count of rows
    per key, stays out of the result.
    """
    values = [c for c in table.columns if c not in keys and c != weight]
    return rows.join(table.select(*keys, *values), keys, how).select(
        *[F.col(c) for c in rows.columns], *[F.col(c) for c in values]
    )


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Add, for each of ``sums``, its total over the rows before in the given total order.

    Range partitioning spreads the rows, each partition sums its own, and a table
    with one row per partition carries what lies before. Where the ranges are cut
    changes nothing.
    """
    ranged = materialize(
        df.withColumns(sums).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_part", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in sums]
    )
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.join(F.broadcast(offsets), "_part")
        .withColumns({c: F.col(f"_{c}") + F.coalesce(F.sum(c).over(local), F.lit(0)) for c in sums})
        .drop("_part", *[f"_{c}" for c in sums])
    )


def dense_id(df: DataFrame, order: list[Column], name: str, start: int = 0) -> DataFrame:
    """Number rows from ``start`` on in the given total order."""
    numbered = running_sums(df, order, {name: F.lit(1).cast("long")})
    return numbered.withColumn(name, F.col(name) + start)
