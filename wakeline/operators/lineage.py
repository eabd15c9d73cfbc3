"""Cutting lineage in iterative plans, in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir (or given to the context) that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared one, if the session still lives."""
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def cut(frame: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    Nothing is computed twice, a lost executor loses no part of them, and the
    files' sizes tell the optimizer what it may broadcast. The folder goes when
    the driver ends.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/wakeline-cut-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def spread(frame: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by the keys to as many tasks as a shuffle has partitions, ahead of work that costs far more than the bytes it reads: small files would be read by few tasks."""
    return frame.repartition(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def bucketed(frame: DataFrame, *keys: str) -> DataFrame:
    """Like ``cut``, with the rows in as many buckets of the keys as a shuffle has partitions: joins and groupings by the keys don't move them again."""
    spark = frame.sparkSession
    name = f"wakeline_bucketed_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    atexit.register(_forget, spark, name, path)
    frame.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def _forget(spark: SparkSession, name: str, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"drop table if exists {name}")
        remove(spark, path)


def numbered(frame: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """The rows with their place (from 1) in the given order, which must tell all rows apart.

    Rows are sorted by range, so no task holds them all; the sizes of the
    ranges, one number each, come to the driver to place the ranges.
    """
    place = F.shiftrightunsigned("_place", 33)
    sorted_ = cut(frame.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()))
    before, first = 0, {}
    for row in sorted_.groupBy(place.cast("int").alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect():
        first[row.part] = before
        before += row.n
    starts = F.array(*[F.lit(first.get(k, 0)).cast("long") for k in range(max(first, default=0) + 1)])
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return sorted_.withColumn(name, F.get(starts, place.cast("int")) + inside + 1).drop("_place")
