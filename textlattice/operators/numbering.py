"""Numbers and running sums over a whole table in order, without a task that reads all of it.

Rows are dealt out by ranges of the order and written once.  A first pass sums each range, the
sums of the ranges before it are broadcast (a row for each partition), a second pass adds up
inside ranges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlattice.plans.session import shared_folder


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` (longs) over all rows before each, by ``order``, which tells rows apart."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ranges-{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    held = spark.read.schema(df.withColumn("_range", F.lit(0)).schema).parquet(path)
    sums = held.groupBy("_range").agg(F.sum(value).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = held.withColumn("_in", inside).join(F.broadcast(sums.select("_range", before.alias("_before"))), "_range")
    return out.select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with numbers from 0 by ``order``."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", name).drop("_one")
