"""What the training-data operators share: reading, row keys, and cutting lineage."""

from __future__ import annotations

import atexit
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here, as a character class of Java and RE2 patterns.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: Bytes of rows that go to a Python worker at once, or one row; a batch is held several times, by the executor and by its worker.
BATCH = 4 << 20
#: Spark's setting of that; its own bound of rows holds as well.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return frame.select(*columns) if columns else frame


def mapped(frame: DataFrame, run, shape) -> DataFrame:
    """``mapInArrow`` in batches of BATCH bytes at most. As Spark reads the bound when a query runs, the session keeps it; a smaller one stays."""
    conf = frame.sparkSession.conf
    told = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(BATCH_BYTES).lower())
    if not told or not 0 < int(told[1]) * 1024 ** " kmgtp".index(told[2] or " ") <= BATCH:
        conf.set(BATCH_BYTES, f"{BATCH}b")
    return frame.mapInArrow(run, shape)


def local(spark: SparkSession, rows: list[tuple], shape: str) -> DataFrame:
    """A few rows of the driver as a table that is read without Python workers, which executors would have to hold beside those of ``mapInArrow``."""
    fields = [c.split() for c in shape.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return spark.createDataFrame(pa.table({name: pa.array(c, _ARROW[kind]) for (name, kind), c in zip(fields, columns, strict=True)}), shape)


def named(frame: DataFrame, *but: str) -> list[Column]:
    """The columns of a table as they are, whatever their names, without those told."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in frame.columns if c not in but]


def id_text(column: Column) -> Column:
    """An id as text; a null id counts as the empty text."""
    return F.coalesce(column.cast("string"), F.lit(""))


def fold(column: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo the number of folds."""
    return F.crc32(id_text(column).cast("binary")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder, named by spark.checkpoint.dir or given to the context, that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return named.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/wakeline-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def cut(frame: DataFrame, name: str) -> DataFrame:
    """Write the rows once to the shared folder and read them back: a lost executor loses no part of them."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    frame.write.parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out._wakeline_path = path
    return out


def drop(frame: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing that is still to run reads it."""
    _remove(frame.sparkSession, frame._wakeline_path)


def gather(frame: DataFrame, tasks: int, merge, schema: str, fan: int = 16) -> DataFrame:
    """Rows of ``tasks`` partitions merged (by mapInArrow) in a tree: a merging task takes the rows of ``fan`` partitions or fewer."""
    columns = frame.columns
    while tasks > 1:
        tasks = -(-tasks // fan)
        to = F.least((F.spark_partition_id() / fan).cast("int"), F.lit(tasks - 1))
        frame = frame.withColumn("_to", to).repartitionById(tasks, "_to").select(*columns)
        frame = mapped(frame, merge, schema)
    return frame
