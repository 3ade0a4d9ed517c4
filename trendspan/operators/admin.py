"""What editors do to manual keywords, manual videos and channels, as batches of commands over stored tables.

The commands of a key are taken in their order (``seq``), one after the other, by a native fold; keys don't depend on each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspan.functions import text as tx

MANUAL_KEYWORDS = "mode string, lookup string, keyword string, ttl_hours int, enabled boolean, starts_at timestamp_ntz, expires_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz"
MANUAL_VIDEOS = "video_id string, title string, channel_name string, video_url string, thumbnail_url string, published_at timestamp_ntz, video_type string, created_at timestamp_ntz, updated_at timestamp_ntz"
CHANNELS = "channel_id string, channel_name string, channel_handle string, channel_url string, created_at timestamp_ntz, updated_at timestamp_ntz"
# Hours that a manual keyword may run, the first one where another is asked for.
TTL_HOURS = [6, 12, 24]


def _named(text: Column) -> Column:
    return tx.collapse(tx.fold_compatibility(F.coalesce(text, F.lit(""))))


def _folded(old: DataFrame, commands: DataFrame, key: list[str], fields: list[str], step) -> DataFrame:
    """Each key's row after its commands; ``step(row, command)`` gives the next row, null where there is none."""
    listed = commands.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", *(c for c in commands.columns if c not in ("seq", *key))))).alias("__commands"))
    row = F.when(F.col("__there"), F.struct(*fields))
    joined = old.withColumn("__there", F.lit(True)).join(listed, key, "full_outer")
    start = row.cast("struct<" + ",".join(f"{f}:{old.schema[f].dataType.simpleString()}" for f in fields) + ">")
    after = F.when(F.col("__commands").isNull(), start).otherwise(F.aggregate("__commands", start, step))
    return joined.withColumn("__row", after).where("__row is not null").select(*key, *(F.col(f"__row.{f}").alias(f) for f in fields))


def manual_keyword_commands(commands: DataFrame) -> DataFrame:
    """``seq, op, mode, keyword, ttl_hours, at`` with the key that commands go by; commands without a keyword are dropped.

    ``op`` is ``upsert``, ``extend``, ``enable``, ``disable`` or ``delete``.
    """
    text = commands.withColumn("keyword", _named(F.col("keyword"))).where("keyword <> ''")
    ttl = F.when(F.col("ttl_hours").isin(*TTL_HOURS), F.col("ttl_hours")).otherwise(TTL_HOURS[0])
    return text.select("seq", "op", "mode", F.lower("keyword").alias("lookup"), "keyword", ttl.cast("int").alias("ttl_hours"), "at")


def change_manual_keywords(old: DataFrame, commands: DataFrame) -> DataFrame:
    """An upsert opens a window; so does an extension of one that has lapsed or is off, another one lengthens it. Enabling a lapsed row restarts its
    window, and what isn't there can be neither extended, switched nor deleted."""
    fields = ["keyword", "ttl_hours", "enabled", "starts_at", "expires_at", "created_at", "updated_at"]
    until = lambda start, ttl: start + F.make_dt_interval(hours=ttl)

    def step(row: Column, c: Column) -> Column:
        made = F.struct(c.keyword.alias("keyword"), c.ttl_hours.alias("ttl_hours"), F.lit(True).alias("enabled"), c["at"].alias("starts_at"), until(c["at"], c.ttl_hours).alias("expires_at"), F.coalesce(row.created_at, c["at"]).alias("created_at"), c["at"].alias("updated_at"))
        runs = row.enabled & (row.expires_at > c["at"])
        longer = F.struct(row.keyword.alias("keyword"), c.ttl_hours.alias("ttl_hours"), F.lit(True).alias("enabled"), F.when(runs, row.starts_at).otherwise(c["at"]).alias("starts_at"), until(F.when(runs, row.expires_at).otherwise(c["at"]), c.ttl_hours).alias("expires_at"), row.created_at.alias("created_at"), c["at"].alias("updated_at"))
        restart = (c.op == "enable") & (row.expires_at <= c["at"])
        switched = F.struct(row.keyword.alias("keyword"), row.ttl_hours.alias("ttl_hours"), (c.op == "enable").alias("enabled"), F.when(restart, c["at"]).otherwise(row.starts_at).alias("starts_at"), F.when(restart, until(c["at"], row.ttl_hours)).otherwise(row.expires_at).alias("expires_at"), row.created_at.alias("created_at"), c["at"].alias("updated_at"))
        return F.when(c.op == "upsert", made).when(row.isNull() | (c.op == "delete"), F.lit(None)).when(c.op == "extend", longer).when(c.op.isin("enable", "disable"), switched).otherwise(row)

    return _folded(old, commands, ["mode", "lookup"], fields, step)


def manual_video_commands(commands: DataFrame) -> DataFrame:
    """``seq, op, video_id, title, channel_name, video_url, published_at, video_type, at``; upserts without id, title, URL or date are dropped."""
    some = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    rows = commands.withColumns({"video_id": F.trim("video_id"), "title": _named(F.col("title")), "channel_name": _named(F.col("channel_name")), "video_url": F.trim("video_url"), "video_type": F.coalesce("video_type", F.lit("unknown"))})
    return rows.where(some(F.col("video_id")) & ((F.col("op") == "delete") | (some(F.col("title")) & some(F.col("video_url")) & F.col("published_at").isNotNull())))


def change_manual_videos(old: DataFrame, commands: DataFrame) -> DataFrame:
    """Upserts overwrite all but the time of making, and the type only where the new one is known."""
    fields = ["title", "channel_name", "video_url", "thumbnail_url", "published_at", "video_type", "created_at", "updated_at"]
    with_thumbnail = commands.withColumn("thumbnail_url", F.concat(F.lit("https://i.ytimg.com/vi/"), "video_id", F.lit("/hqdefault.jpg")))

    def step(row: Column, c: Column) -> Column:
        kind = F.when(c.video_type != "unknown", c.video_type).otherwise(F.coalesce(row.video_type, c.video_type))
        made = F.struct(*(c[f].alias(f) for f in fields[:5]), kind.alias("video_type"), F.coalesce(row.created_at, c["at"]).alias("created_at"), c["at"].alias("updated_at"))
        return F.when(c.op == "upsert", made).when(c.op == "delete", F.lit(None)).otherwise(row)

    return _folded(old, with_thumbnail, ["video_id"], fields, step)


def moved_videos(stored: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Commands that carry a video's row over to another id, and the moves that are refused.

    ``moves`` has ``seq, old_id`` and the columns of an upsert (``video_id`` is the new id). A move is refused if its new id is another row's, or
    if an earlier move of the batch asked for it; one whose old id isn't there is passed over. An unknown type stays as it was only where the id stays.
    """
    present = stored.select(F.col("video_id").alias("old_id"), F.col("video_type").alias("old_type"))
    real = moves.join(present, "old_id")
    taken = stored.select("video_id").join(real.select("video_id"), "video_id", "left_semi").withColumn("__taken", F.lit(True))
    first = real.groupBy("video_id").agg(F.min("seq").alias("__first"))
    judged = real.join(taken, "video_id", "left").join(first, "video_id").withColumn("refused", (F.col("old_id") != F.col("video_id")) & (F.coalesce("__taken", F.lit(False)) | (F.col("seq") != F.col("__first"))))
    allowed = judged.where("not refused").withColumn("video_type", F.when((F.col("video_type") == "unknown") & (F.col("old_id") == F.col("video_id")), F.col("old_type")).otherwise(F.col("video_type")))
    columns = [c for c in moves.columns if c != "old_id"]
    upserts = allowed.select(*columns).withColumn("op", F.lit("upsert"))
    deletes = allowed.where("old_id <> video_id").select(*(F.col("old_id").alias(c) if c == "video_id" else F.col(c) for c in columns)).withColumn("op", F.lit("delete"))
    return upserts.unionByName(deletes), judged.where("refused").select(*moves.columns)


def channel_commands(commands: DataFrame) -> DataFrame:
    """``seq, op, channel_id, channel_name, channel_handle, channel_url, at``; a missing URL is made of the handle or the id."""
    handle, name = _named(F.col("channel_handle")), _named(F.col("channel_name"))
    rows = commands.withColumns({"channel_id": F.trim("channel_id"), "channel_name": name, "channel_handle": handle})
    own = F.concat(F.lit("https://www.youtube.com/"), F.when(F.startswith("channel_handle", F.lit("@")), F.col("channel_handle")).otherwise(F.concat(F.lit("channel/"), "channel_id")))
    rows = rows.withColumn("channel_url", F.coalesce(F.nullif(F.trim("channel_url"), F.lit("")), own))
    return rows.where((F.col("channel_id") != "") & ((F.col("op") == "delete") | (F.col("channel_name") != "")))


def change_channels(old: DataFrame, commands: DataFrame) -> DataFrame:
    fields = ["channel_name", "channel_handle", "channel_url", "created_at", "updated_at"]

    def step(row: Column, c: Column) -> Column:
        made = F.struct(*(c[f].alias(f) for f in fields[:3]), F.coalesce(row.created_at, c["at"]).alias("created_at"), c["at"].alias("updated_at"))
        return F.when(c.op == "upsert", made).when(c.op == "delete", F.lit(None)).otherwise(row)

    return _folded(old, commands, ["channel_id"], fields, step)
