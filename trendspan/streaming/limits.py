"""Rate limits of an API by client and route, with state that ends with its window.

A client's requests to one route, of which the path's first four segments count, share a window of a minute that starts with the first
request behind the last window. A request passes if fewer requests of the window have passed than its own path allows. The state is a window's start and
count; a timer in event time drops it as soon as the watermark has passed the window's end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WINDOW_MS = 60_000
# Requests a minute by path, the first prefix that fits; what other paths may do.
LIMITS = [("/api/mcp", 60), ("/api/v1/search", 10), ("/api/v1/keywords/views", 15), ("/api/v1/trends", 30), ("/api/v1/keywords", 60), ("/api/v1/", 100)]
OTHERS = 100

OUT = T.StructType([T.StructField("ip", T.StringType()), T.StructField("route", T.StringType()), T.StructField("allowed", T.LongType()), T.StructField("refused", T.LongType())])
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def route_key(path: Column) -> Column:
    return F.array_join(F.slice(F.split(path, "/"), 1, 4), "/")


def limit_of(path: Column) -> Column:
    """Requests a minute that a path allows."""
    out = F.when(F.startswith(path, F.lit(LIMITS[0][0])), LIMITS[0][1])
    for prefix, n in LIMITS[1:]:
        out = out.when(F.startswith(path, F.lit(prefix)), n)
    return out.otherwise(OTHERS)


def limited(path: Column) -> Column:
    """Whether a path is limited at all."""
    return F.startswith(path, F.lit("/api/v1/")) | F.startswith(path, F.lit("/api/mcp"))


def first_address(forwarded: Column) -> Column:
    """The client's address: the first of a forwarded list."""
    return F.coalesce(F.nullif(F.trim(F.substring_index(forwarded, ",", 1)), F.lit("")), F.lit("unknown"))


class Limiter(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, count long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Requests of one millisecond and limit are alike; the stricter limit goes first within a millisecond.
        requests: Counter = Counter()
        for some in rows:
            requests.update(zip(some["ms"].tolist(), some["rpm"].tolist(), strict=True))
        start, count = self.window.get() if self.window.exists() else (None, 0)
        allowed = refused = 0
        for (at, rpm), n in sorted(requests.items()):
            if start is None or at - start >= WINDOW_MS:
                start, count = at, 1
                allowed, n = allowed + 1, n - 1
            passed = min(n, max(0, rpm - count))
            count, allowed, refused = count + passed, allowed + passed, refused + n - passed
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.window.update((start, count))
        self.handle.registerTimer(max(start + WINDOW_MS, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame({"ip": [key[0]], "route": [key[1]], "allowed": [allowed], "refused": [refused]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.window.clear()
        return iter([])

    def close(self) -> None:
        pass


def limit_routes(requests: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``ip, route, allowed, refused`` of each batch. ``requests`` is a stream of ``forwarded, path, ts``; requests later than ``late`` are dropped."""
    rows = requests.where(limited(F.col("path"))).withWatermark("ts", late)
    rows = rows.select(first_address(F.col("forwarded")).alias("ip"), route_key(F.col("path")).alias("route"), limit_of(F.col("path")).alias("rpm"), F.unix_millis("ts").alias("ms"), "ts")
    return rows.groupBy("ip", "route").transformWithStateInPandas(Limiter(), OUT, "append", "eventTime")


def with_rocksdb(spark: SparkSession) -> None:
    """State with timers needs this store; queries that start from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
