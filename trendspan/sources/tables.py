"""The engine's relations as projections of the tables it is given.

A snapshot is an order, a ranked keyword a line of it, a keyword's name a part, a view an event, a feed item a
document. All are lazy projections, so filters and column pruning reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" for items, views and snapshots: fixed, so that every run gives the same rows.
AS_OF_ITEMS = "2024-01-31 00:00:00"
AS_OF_VIEWS = "2024-01-31 00:00:00"
AS_OF_SNAPSHOTS = "2001-08-02 00:00:00"

TIERS = ["P0_CURATED", "P1_CONTEXT", "P2_RAW", "COMMUNITY"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("mode"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("owner_id"), F.col("o_totalprice").alias("weight")
    )


def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("snapshot_id"),
        F.col("l_partkey").alias("keyword_id"),
        F.col("l_suppkey").alias("source_id"),
        F.col("l_linenumber").alias("rank"),
        F.col("l_extendedprice").alias("score"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("type"),
        F.col("l_linestatus").alias("status"),
        F.col("l_shipdate").alias("seen_at"),
    )


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("keyword_id"), F.col("p_name").alias("keyword"), F.col("p_type").alias("alias"), F.col("p_brand").alias("family"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price")
    )


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.get_json_object("props", "$.k").cast("long").alias("keyword_id"), F.col("user_id").alias("viewer"), F.col("event_type").alias("kind"), "ts", "value", "event_id"
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feed items: published one minute apart before ``AS_OF_ITEMS``, tiers in turn.

    The title is a document's first line. Matching reads the whole text (``body``); ``summary`` is what a feed shows of it,
    500 characters at most by the feeds' own rule.
    """
    tier = F.element_at(F.array(*map(F.lit, TIERS)), (F.col("doc_id") % 4).cast("int") + 1)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_idx"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.substring("text", 1, 500).alias("summary"),
        F.col("text").alias("body"),
        F.col("source").alias("domain"),
        "lang",
        (F.lit(AS_OF_ITEMS).cast("timestamp_ntz") - F.make_dt_interval(mins=F.col("doc_id").cast("int") % 10080)).alias("published_at"),
        tier.alias("tier"),
        F.col("n_chars").alias("points"),
        (F.col("n_chars") % 7).alias("comments"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages")


def spread(df: DataFrame) -> DataFrame:
    """The rows of a table of few bytes over all cores, before much is computed of each: its file alone would be a task or two."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


#: The same projections for the SQL side.
ITEMS_SQL = f"""items AS (
  SELECT doc_id AS item_idx, string_split(text, chr(10))[1] AS title, substr(text, 1, 500) AS summary, text AS body, source AS domain, lang,
    TIMESTAMP '{AS_OF_ITEMS}' - to_minutes(doc_id % 10080) AS published_at,
    CASE doc_id % 4 WHEN 0 THEN 'P0_CURATED' WHEN 1 THEN 'P1_CONTEXT' WHEN 2 THEN 'P2_RAW' ELSE 'COMMUNITY' END AS tier,
    n_chars AS points, n_chars % 7 AS comments
  FROM documents)"""
KEYWORDS_SQL = """keywords AS (
  SELECT l_orderkey AS snapshot_id, l_partkey AS keyword_id, l_suppkey AS source_id, l_linenumber AS rank, l_extendedprice AS score,
    l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS type, l_linestatus AS status, l_shipdate AS seen_at FROM lineitem)"""
SNAPSHOTS_SQL = """snapshots AS (
  SELECT o_orderkey AS snapshot_id, o_orderstatus AS mode, o_orderdate AS created_at, o_custkey AS owner_id, o_totalprice AS weight FROM orders)"""
NAMES_SQL = """names AS (
  SELECT p_partkey AS keyword_id, p_name AS keyword, p_type AS alias, p_brand AS family, p_size AS size, p_retailprice AS price FROM part)"""
VIEWS_SQL = """views AS (
  SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS keyword_id, user_id AS viewer, event_type AS kind, ts, value, event_id FROM events)"""
