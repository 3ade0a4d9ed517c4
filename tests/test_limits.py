"""Rate limits by client and route: the fold over requests, and state that goes with its window."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from trendspan.streaming import limits as lm

T0 = datetime.datetime(2024, 1, 1)
SCHEMA = "forwarded string, path string, ts timestamp"
PATHS = {"/api/v1/search": 10, "/api/v1/keywords/views": 15, "/api/v1/keywords/k/x": 60, "/api/v1/trends": 30, "/api/v1/other": 100, "/api/mcp/a/b": 60}


@pytest.mark.parametrize(("path", "rpm"), PATHS.items())
def test_limits_and_routes(spark, path, rpm):
    row = spark.createDataFrame([(path, " 1.2.3.4 , 5.6.7.8")], "p string, f string").select(lm.limit_of(F.col("p")), lm.route_key(F.col("p")), lm.first_address(F.col("f"))).first()
    assert tuple(row) == (rpm, "/".join(path.split("/")[:4]), "1.2.3.4")


def fold(requests):
    state, out = {}, {}
    for ip, path, ms in sorted(requests, key=lambda r: (r[2], PATHS[r[1]])):
        key = (ip, "/".join(path.split("/")[:4]))
        start, count = state.get(key, (None, 0))
        passes = True
        if start is None or ms - start >= 60_000:
            start, count = ms, 1
        elif count >= PATHS[path]:
            passes = False
        else:
            count += 1
        state[key] = start, count
        allowed, refused = out.get(key, (0, 0))
        out[key] = (allowed + passes, refused + (not passes))
    return out


def test_batches_equal_the_fold_and_state_goes(spark, tmp_path):
    lm.with_rocksdb(spark)
    rng = random.Random(2)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    everything = []
    for batch in range(3):
        rows = [(rng.choice("ab"), rng.choice(list(PATHS)), batch * 600_000 + rng.randrange(100_000)) for _ in range(600)]
        everything += rows
        times = [(f"{ip}, x", path, T0 + datetime.timedelta(milliseconds=ms)) for ip, path, ms in rows]
        spark.createDataFrame([*times, ("a", "/page", times[0][2])], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = lm.limit_routes(spark.readStream.schema(SCHEMA).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).groupBy("ip", "route").agg(F.sum("allowed").alias("a"), F.sum("refused").alias("r")).collect()
    base = int(T0.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    assert {(r.ip, r.route): (r.a, r.r) for r in got} == fold([(ip, p, base + ms) for ip, p, ms in everything])
    held = lambda: spark.read.format("statestore").option("stateVarName", "window").load(check).count()
    before = held()
    assert 0 < before <= 12
    # A last request, long after; the batch behind it finds all windows lapsed.
    for hours in (1, 2):
        spark.createDataFrame([("z", "/api/v1/search", T0 + datetime.timedelta(hours=hours))], SCHEMA).write.mode("append").parquet(source)
        stream = lm.limit_routes(spark.readStream.schema(SCHEMA).parquet(source))
        stream.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out).awaitTermination()
    assert held() <= 1
