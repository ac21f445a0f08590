"""The folder that the driver and all executors share, and tables whose lineage is cut there."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset one is made if all of Spark runs on this machine, and on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found and made.isDefined():
        found = made.get()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder, with its lineage cut there."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def mean_ranks(df: DataFrame, column: str) -> DataFrame:
    """(column, rank): each value with the mean place of its rows, from 1, among all rows that have the column.

    Distinct values are sorted over all partitions; a partition counts its own rows, and only the partitions' sums, a row
    each, meet in one task."""
    values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("__n"))
    rows = cut(values.repartitionByRange(column).sortWithinPartitions(column).withColumn("__i", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__i", 33))
    parts = rows.groupBy("__part").agg(F.sum("__n").alias("__rows"))
    before = parts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__rows").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy("__i"))
    placed = rows.withColumn("__upto", upto).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return placed.select(column, (F.col("__before") + F.col("__upto") - (F.col("__n") - 1) / 2).alias("rank"))
