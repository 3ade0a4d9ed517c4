"""Queries that write to stored tables: what editors do to manual keywords, videos and channels, and rows of a snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.operators import admin as ad
from trendspan.operators.stored import StoredTable, absent_only
from trendspan.plans.registry import Registry
from trendspan.sources.tables import names, table
from trendspan.streaming.views import shared_path

R = Registry()

#: Commands up to this time are a first batch, later ones a second.
HALF = "2024-01-16 00:00:00"
OPS = ["upsert", "upsert", "extend", "disable", "enable", "delete", "extend"]


def _in_two_batches(spark: SparkSession, stored: StoredTable, commands: DataFrame, change) -> DataFrame:
    """The table after both batches; the second one is sent twice, as after a restart."""
    early = F.col("at") <= F.lit(HALF).cast("timestamp_ntz")
    stored.merge(commands.where(early), change, "batch-0")
    stored.merge(commands.where(~early), change, "batch-1")
    stored.merge(commands.where(~early), change, "batch-1")
    return stored.read()


_COMMANDS = f"""c AS (SELECT event_id AS seq, {OPS!r}[user_id % 7 + 1] AS op, CASE WHEN event_id % 2 = 0 THEN 'realtime' ELSE 'daily' END AS mode, CASE WHEN event_id % 3 = 0 THEN upper(p_name) ELSE p_name END || ' ' || (event_id // 50) AS keyword,
 CASE WHEN event_id % 5 IN (0, 3) THEN 6 WHEN event_id % 5 = 1 THEN 12 ELSE 24 END AS ttl, ts AS at_ FROM events JOIN part ON p_partkey = CAST(json_extract_string(props, '$.k') AS BIGINT)),
n AS MATERIALIZED (SELECT *, mode || '|' || lower(keyword) AS key, row_number() OVER (PARTITION BY mode, lower(keyword) ORDER BY at_ > TIMESTAMP '{HALF}', seq) AS n FROM c)"""


@R.query(f"""WITH RECURSIVE {_COMMANDS},
f AS (SELECT DISTINCT key, 0::BIGINT AS n, NULL::VARCHAR AS keyword, NULL::INTEGER AS ttl, NULL::BOOLEAN AS enabled, NULL::TIMESTAMP AS starts, NULL::TIMESTAMP AS expires, NULL::TIMESTAMP AS created, NULL::TIMESTAMP AS updated, false AS there FROM n
UNION ALL SELECT n.key, n.n,
 CASE WHEN op = 'upsert' THEN n.keyword ELSE f.keyword END,
 CASE WHEN op = 'upsert' OR (op = 'extend' AND there) THEN n.ttl ELSE f.ttl END,
 CASE WHEN op IN ('upsert', 'extend', 'enable') THEN true WHEN op = 'disable' THEN false ELSE f.enabled END,
 CASE WHEN op = 'upsert' OR (op = 'extend' AND NOT (f.enabled AND expires > at_)) OR (op = 'enable' AND expires <= at_) THEN at_ ELSE starts END,
 CASE WHEN op = 'upsert' THEN at_ + to_hours(n.ttl) WHEN op = 'extend' THEN CASE WHEN f.enabled AND expires > at_ THEN expires ELSE at_ END + to_hours(n.ttl) WHEN op = 'enable' AND expires <= at_ THEN at_ + to_hours(f.ttl) ELSE expires END,
 CASE WHEN op = 'upsert' AND NOT there THEN at_ ELSE created END, at_, CASE op WHEN 'upsert' THEN true WHEN 'delete' THEN false ELSE there END
 FROM f JOIN n ON n.key = f.key AND n.n = f.n + 1)
SELECT split_part(key, '|', 1) AS mode, split_part(key, '|', 2) AS lookup, keyword, ttl AS ttl_hours, enabled, starts AS starts_at, expires AS expires_at, created AS created_at, updated AS updated_at FROM f
WHERE there AND (key, n) IN (SELECT key, max(n) FROM n GROUP BY 1)""")
def manual_keyword_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual keywords after every event's command: put in under a key without case, extended, switched, deleted."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").withColumn("keyword_id", F.get_json_object("props", "$.k").cast("long")).join(names(spark, sf_dir).select("keyword_id", "keyword"), "keyword_id")
    commands = e.select(
        k.alias("seq"),
        F.element_at(F.array(*map(F.lit, OPS)), (F.col("user_id") % len(OPS)).cast("int") + 1).alias("op"),
        F.when(k % 2 == 0, "realtime").otherwise("daily").alias("mode"),
        F.concat(F.when(k % 3 == 0, F.upper("keyword")).otherwise(F.replace("keyword", F.lit(" "), F.lit("  "))), F.lit(" "), F.floor(k / 50).cast("string")).alias("keyword"),
        F.element_at(F.array(*map(F.lit, [6, 12, 24, 7, 24])), (k % 5).cast("int") + 1).alias("ttl_hours"),
        F.col("ts").alias("at"),
    )
    stored = StoredTable(spark, shared_path(spark, "manual-keywords"), ad.MANUAL_KEYWORDS, ["mode", "lookup"])
    return _in_two_batches(spark, stored, ad.manual_keyword_commands(commands), ad.change_manual_keywords)


@R.query(f"""WITH c AS (SELECT event_id AS seq, CASE WHEN user_id % 9 = 0 THEN 'delete' ELSE 'upsert' END AS op, 'v' || (event_id // 4) AS video_id, 'Video ' || event_id AS title, 'ch' || user_id AS channel_name, ['unknown', 'shorts', 'longform', 'unknown'][event_id % 4 + 1] AS kind, ts, ts > TIMESTAMP '{HALF}' AS late FROM events),
n AS (SELECT *, max(CASE WHEN op = 'delete' THEN (late, seq) END) OVER (PARTITION BY video_id) AS gone FROM c), l AS (SELECT * FROM n WHERE gone IS NULL OR (late, seq) > gone)
SELECT video_id, arg_max(title, (late, seq)) AS title, arg_max(channel_name, (late, seq)) AS channel_name, coalesce(arg_max(kind, (late, seq)) FILTER (WHERE kind <> 'unknown'), 'unknown') AS video_type, max(ts) FILTER (WHERE last) AS updated_at, max(ts) FILTER (WHERE first) AS created_at
FROM (SELECT *, (late, seq) = max((late, seq)) OVER (PARTITION BY video_id) AS last, (late, seq) = min((late, seq)) OVER (PARTITION BY video_id) AS first FROM l) GROUP BY 1""")
def manual_video_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual videos after every event's upsert or deletion; a known type outlives unknown ones."""
    k = F.col("event_id")
    commands = table(spark, sf_dir, "events").select(
        k.alias("seq"),
        F.when(F.col("user_id") % 9 == 0, "delete").otherwise("upsert").alias("op"),
        F.concat(F.lit(" v"), F.floor(k / 4).cast("string")).alias("video_id"),
        F.concat(F.lit("Video  "), k.cast("string")).alias("title"),
        F.concat(F.lit("ch"), F.col("user_id").cast("string")).alias("channel_name"),
        F.lit("https://v").alias("video_url"),
        F.col("ts").alias("published_at"),
        F.element_at(F.array(F.lit("unknown"), F.lit("shorts"), F.lit("longform"), F.lit(None)), (k % 4).cast("int") + 1).alias("video_type"),
        F.col("ts").alias("at"),
    )
    stored = StoredTable(spark, shared_path(spark, "manual-videos"), ad.MANUAL_VIDEOS, ["video_id"])
    return _in_two_batches(spark, stored, ad.manual_video_commands(commands), ad.change_manual_videos).select("video_id", "title", "channel_name", "video_type", "updated_at", "created_at")


@R.query("SELECT 'UC' || c_custkey AS channel_id, c_name AS channel_name, CASE WHEN c_custkey % 4 = 0 THEN 'https://www.youtube.com/@h' || c_custkey WHEN c_custkey % 4 = 1 THEN 'https://c/' || c_custkey ELSE 'https://www.youtube.com/channel/UC' || c_custkey END AS channel_url FROM customer WHERE c_custkey % 10 <> 7")
def channel_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels put in, put in again under their names, and some of them deleted."""
    k = F.col("c_custkey")
    s = k.cast("string")
    put = table(spark, sf_dir, "customer").select(
        (2 * k).alias("seq"), F.lit("upsert").alias("op"), F.concat(F.lit("UC"), s).alias("channel_id"), F.col("c_name").alias("channel_name"), F.when(k % 4 == 0, F.concat(F.lit("@h"), s)).otherwise("").alias("channel_handle"), F.when(k % 4 == 1, F.concat(F.lit("https://c/"), s)).alias("channel_url"), F.lit(HALF).cast("timestamp_ntz").alias("at")
    )
    earlier = put.withColumns({"seq": F.col("seq") - 1, "channel_name": F.lit("old"), "channel_url": F.lit("https://old")})
    gone = put.where("seq % 20 = 14").withColumns({"seq": F.col("seq") + 1, "op": F.lit("delete")})
    stored = StoredTable(spark, shared_path(spark, "channels"), ad.CHANNELS, ["channel_id"])
    stored.merge(ad.channel_commands(earlier), ad.change_channels, "put")
    stored.merge(ad.channel_commands(put.unionByName(gone)), ad.change_channels, "changed")
    return stored.read().select("channel_id", "channel_name", "channel_url")


@R.query("SELECT o_orderkey AS snapshot_id, o_orderstatus AS mode FROM orders UNION ALL SELECT -1 - n_nationkey, 'new' FROM nation")
def snapshot_rows_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots put into a stored table if they are absent; those that are there stay as they are."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderstatus").alias("mode"))
    new = table(spark, sf_dir, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("snapshot_id"), F.lit("new").alias("mode"))
    again = rows.withColumn("mode", F.lit("changed"))
    stored = StoredTable(spark, shared_path(spark, "snapshots"), rows.schema, ["snapshot_id"])
    put = lambda old, batch: absent_only(old, batch, ["snapshot_id"])
    for batch_id, batch in (("first", rows), ("second", again.unionByName(new)), ("first", again)):
        stored.merge(batch, put, batch_id)
    return stored.read()
