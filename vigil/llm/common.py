"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import ensure_checkpoint_dir, ship_code

ARROW_ROWS = 2000
WORD = r"[^\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> None:
    """Shared checkpoint folder, code on the workers, Arrow batches small
    enough that a batch of very long texts fits a Python worker, and shuffle
    files deleted when their job is done rather than at some later time."""
    ensure_checkpoint_dir(spark)
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder: columnar, so
    later reads prune columns, and it survives the loss of any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        drop_path(df.sparkSession, path)


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def positions(df: DataFrame, group: list[str], order: list[Column], name: str, count: str, at: str) -> DataFrame:
    """All columns of ``df``, ``name`` (the place from 0 of a row in its group, in the given order) and
    ``count`` (rows of the group).  The order is part of one range-partitioned sort, so a group of any
    size is spread over tasks; only each task's count of a group is summed up.  ``at`` is a free column name.
    Nulls of a group column are one group; rows equal in the whole order get their places in any order."""
    rows = stored(df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
                  .withColumn(at, F.monotonically_increasing_id()), "positions")
    part = F.shiftright(at, 33)
    counts = rows.groupBy(*group, part.alias("p")).agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*group, F.lit(0))  # as many rows as tasks hold the group
    bases = counts.select(
        *[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], "p", F.sum("n").over(whole).alias(count),
        (F.sum("n").over(whole.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))).alias("before"), "first")
    bases = bases.select("*", (F.coalesce("before", F.lit(0)) - F.col("first")).alias("base")).drop("before", "first")
    same = [F.col(g).eqNullSafe(F.col(f"g{i}")) for i, g in enumerate(group)]
    out = rows.join(bases, reduce(lambda a, b: a & b, same, part == F.col("p")))
    return out.select(*df.columns, (F.col(at) + F.col("base")).alias(name), F.col(count))


def fold(key: Column, n: int = 5) -> Column:
    """crc32 of the key as text modulo ``n``; a null key is in fold 0."""
    return F.coalesce(F.crc32(key.cast("string")) % n, F.lit(0))


def batches_of(batch: pa.RecordBatch, column: str) -> Iterator[list]:
    """The values of one column as Python objects."""
    yield batch.column(column).to_pylist()


def record_batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)],
        schema=schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
