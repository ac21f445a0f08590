"""From raw documents to token ids: five stages, each of one operator over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorlake.llm import bpe, mixing, quality, secrets, simhash
from factorlake.llm.common import shared_folder, table

#: Words that a Python worker of the last stage keeps with their tokens: its executors still hold what earlier stages left.
KEPT_WORDS = 60_000
#: Rows of a batch between Spark and Python: whole documents with all their columns go through, so batches of the default
#: size, 10,000 rows, take hundreds of MB outside of the heap.
BATCH_ROWS = 1_000


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """A stage's rows are read by its caller, so a stage called alone leaves the setting; run() puts it back."""
    spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of rows that aren't held out.

    Null and empty texts are scored as no bytes at all; rows that repeat stay or go together; other columns, whatever
    their names, stay as they came; an empty table gives an empty result. As in all stages but the last."""
    small_batches(spark)
    net = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, net, name="__score").filter(F.col("__score") >= quality.THRESHOLD).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: texts whose sets of five-word shingles have a Jaccard similarity
    of 0.8. (The radius of 2 bits is the rule of op7's query alone; most near copies differ in more.)

    Texts without words, null ones included, are one group. Rows with a null doc_id can't be told apart and stay."""
    small_batches(spark)
    return simhash.keep_similar(docs).select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; null texts stay null."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken: at most three times. A null source is a source of its own."""
    return mixing.take_mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and hashes of the ids and of the text that they decode to. A null text has no ids."""
    small_batches(spark)
    made = bpe.encode(docs, decoded=True, most_words=KEPT_WORDS)
    return made.select(
        F.col("key").alias("doc_id"),
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_copies),
    ("secret scan", redact_secrets),
    ("source mix", mix),
    ("byte-pair encoding", tokenize),
]

#: The classifier, the shingle sets and the encoding are not SQL; the tests hold each stage's decisions on its own input
#: against plain versions: a loop over the network, all pairs, expressions of Python, counts of words, the public library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage is written to the shared folder as Parquet and read again. The session's
    settings are then as they were."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    rows = spark.conf.get(BATCH_SETTING)
    try:
        for k, (_, stage) in enumerate(STAGES):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    finally:
        spark.conf.set(BATCH_SETTING, rows)
    return docs
