"""Structured Streaming over events and items: dedup, counters, rate limits, incremental ingestion.

State is keyed and bounded by watermarks or time-outs. Offsets, state and tables are in the folder that the cluster
shares, so a query goes on after the loss of an executor or of the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trendspan.functions import urls as ur

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
LIMIT, WINDOW_SECONDS = 5, 3600


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster names; a temporary one where a local session names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
    base = named or tempfile.mkdtemp(prefix="trendspan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.readStream.schema(EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    return raw.select(F.get_json_object("props", "$.k").cast("long").alias("keyword_id"), F.col("user_id").alias("viewer"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"))


def run_to_end(stream: DataFrame, spark: SparkSession, name: str, mode: str = "append") -> DataFrame:
    """Work off what is there (availableNow) into a Parquet table, and read it."""
    out = shared_path(spark, name)
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def dedup_views(views: DataFrame, late: str = "2 hours") -> DataFrame:
    """One view for each keyword, viewer and hour; events later than the watermark are dropped with their state."""
    v = views.where("kind = 'view'").withColumn("bucket", F.date_trunc("hour", "ts")).withWatermark("bucket", late)
    return v.select("keyword_id", "viewer", "bucket").dropDuplicatesWithinWatermark(["keyword_id", "viewer", "bucket"])


def limit_requests(views: DataFrame, limit: int = LIMIT, seconds: int = WINDOW_SECONDS, late: str = "1 hour") -> DataFrame:
    """Each viewer's allowed and refused requests in windows that start at a first request.

    The state is the open window's start and count; it goes once the watermark has passed the window. A batch's requests
    are counted by second before they are taken in time order, so memory stays small for a viewer with most of all requests.
    """

    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        requests: Counter = Counter()
        for p in pieces:
            requests.update(p["second"].value_counts().to_dict())
        allowed = refused = 0
        for t in sorted(requests):
            if start is None or t >= start + seconds:
                start, count = t, 0
            passed = min(requests[t], max(0, limit - count))
            count += requests[t]
            allowed += passed
            refused += requests[t] - passed
        state.update((int(start), count))
        state.setTimeoutTimestamp(max((int(start) + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"viewer": [key[0]], "allowed": [allowed], "refused": [refused]})

    rows = views.withWatermark("ts", late).select("viewer", "ts", F.unix_seconds("ts").alias("second"))
    return rows.groupBy("viewer").applyInPandasWithState(step, "viewer long, allowed long, refused long", "start long, count long", "append", GroupStateTimeout.EventTimeTimeout)


def counter_merge(path: str):
    """A foreachBatch sink: adds each batch's counts to a table, once for each batch id however often it is replayed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("keyword_id").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return merge


def count_views(spark: SparkSession, views: DataFrame) -> DataFrame:
    """Views of each keyword: increments by batch, summed when read."""
    out = shared_path(spark, "counters")
    stream = views.where("kind = 'view'").select("keyword_id")
    stream.writeStream.foreachBatch(counter_merge(out)).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("keyword_id").agg(F.sum("n").alias("view_count"))


def ingest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as they land, each link once: a batch adds what the table doesn't have, so no state grows with all links.

    A batch writes a folder of its own, so a replay replaces it.
    """
    out = shared_path(spark, "pages")

    def add(batch: DataFrame, batch_id: int) -> None:
        links = batch.select(ur.url_key(F.col("url")).alias("link")).distinct()
        if batch_id > 0:
            before = batch.sparkSession.read.schema("link string, batch long").parquet(out).where(F.col("batch") < batch_id)
            links = links.join(before.select("link"), "link", "left_anti")
        links.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    raw = spark.readStream.schema("page_id long, url string, html string").parquet(f"{sf_dir}/pages.parque[t]")  # a pattern, so that the table may be a file or a folder
    raw.writeStream.foreachBatch(add).option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("link string").parquet(out).select("link")
