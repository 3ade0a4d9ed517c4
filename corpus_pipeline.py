"""The corpus pipeline: five stages from raw documents to token counts, each one operator of ``trendspan.llm``.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before kept. All but the last return
the columns of ``documents``; their decisions take effect as rows that go or texts that change. Between stages
the documents are Parquet in the cluster's shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm import bpe, decontamination, line_dedup, near_copies, toxicity
from trendspan.llm.shared import Scratch, table, without_ids


#: Rows that pass to Python together: whole texts are long, and executors keep what the largest batch took.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """For this session's plans, those of other queries too: results don't depend on it."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go whose probability of being toxic is at least the threshold."""
    small_batches(spark)
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.classify(docs, chain)
    return scored.where(F.col("p_toxic") < toxicity.THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; documents of nothing else go with them."""
    return line_dedup.dedup_lines(spark, docs)


#: Numbers the rows of a stored table, so that decisions are taken by row: ids may be null or shared.
ROW = "pipeline_row"


def numbered(scratch: Scratch, docs: DataFrame) -> DataFrame:
    return scratch.write(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike by 0.8 or more in 5-word shingles the one with the smallest id stays.

    Candidates are pairs of near SimHash fingerprints (see ``near_copies``), and what those pass by the bands of MinHash.
    Rows are told apart by their number, whatever their ids: one without an id stays only where its group has none, and of
    rows with equal ids that of the smaller hash of its text, then the first one.
    """
    small_batches(spark)
    scratch = Scratch(spark, "near-duplicates")
    rows = numbered(scratch, docs)
    found = near_copies.near_copies(spark, rows, key=ROW).withColumnRenamed("doc_id", ROW)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))), ROW)
    placed = scratch.write(rows.select(ROW, order.alias("order")).join(found, ROW), "found")
    stays = placed.groupBy("component_id").agg(F.min("order").alias("first")).select(F.col(f"first.{ROW}").alias(ROW))
    gone = scratch.write(placed.select(ROW).join(stays, ROW, "left_anti"), "gone")
    return without_ids(rows, gone, ROW).select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a copy, edited or not, of a benchmark item; each row by itself, whatever its id."""
    small_batches(spark)
    scratch = Scratch(spark, "leaks")
    rows = numbered(scratch, docs)
    leaks = scratch.write(decontamination.contaminated(rows, table(spark, sf_dir, "benchmark"), key=ROW).select(F.col("doc_id").alias(ROW)).distinct(), "leaks")
    return without_ids(rows, leaks, ROW).select(*docs.columns)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    small_batches(spark)
    return bpe.bpe_round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("bpe", encode_and_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage-{k}")
        scratch.release()
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None
