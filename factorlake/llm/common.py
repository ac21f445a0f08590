"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` of the folder `sf_dir`, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Where it is unset, one is made if all
    of Spark runs on this machine; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            found = made.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder that all executors share, with its lineage cut there.

    The folder is that of shared_folder().
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` as a compressed table in the shared folder, read again: for wide rows a fraction of a checkpoint's size, and
    a reader takes the columns that it needs."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def whole(text: str | Column = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def utf8_bytes(text: str | Column = "text") -> Column:
    return F.octet_length(whole(text)).cast("long")


def utf8_crc32(text: str | Column = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; a null text has no bytes."""
    return F.crc32(whole(text).cast("binary"))


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """`df` sorted by the columns `by` over all its partitions, nulls first, as a checkpoint.

    Column __row ascends in that order; its upper bits are __part, the number of the partition. Rows that tie in `by`
    may be parted anywhere: a group of any size spreads over partitions. The driver gets a sample of the values of `by`,
    so those are to be short.
    """
    dealt = df.withColumn("__tie", F.rand(7)).repartitionByRange(*by, "__tie").sortWithinPartitions(*by).drop("__tie")
    numbered = dealt.withColumn("__row", F.monotonically_increasing_id())
    return cut(numbered.withColumn("__part", F.shiftright("__row", 33)))
