"""The daily batch as one job, and what is replayed from what it stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.operators import job
from trendspan.operators.relational import keep_after
from trendspan.plans import curation, ranking
from trendspan.plans.registry import Registry
from trendspan.sources.tables import AS_OF_VIEWS, table
from trendspan.streaming.views import shared_path

R = Registry()

VIDEO_DAYS, VIEW_DAYS = 30, 3


def steps(sf_dir: str, retention: bool) -> list[job.Step]:
    """Videos on their own, the snapshot, and retention behind it where it is asked for."""
    out = [
        job.Step("videos", lambda spark, _: curation.video_union(spark, sf_dir), required=False),
        job.Step("snapshot", lambda spark, _: ranking.keyword_scores(spark, sf_dir)),
    ]
    if retention:
        out.append(job.Step("retention", lambda spark, _: keep_after(table(spark, sf_dir, "events"), "ts", AS_OF_VIEWS, VIEW_DAYS), needs=("snapshot",), required=False))
    return out


@R.query(f"""{ranking.SCORE_SQL} SELECT * FROM (SELECT 'videos' AS step, 'reused' AS status, count(*) AS rows FROM ({curation.R.oracles['video_union']})
UNION ALL SELECT 'snapshot', 'reused', count(*) FROM scored UNION ALL SELECT 'retention', 'done', count(*) FROM events WHERE ts >= TIMESTAMP '{AS_OF_VIEWS}' - INTERVAL {VIEW_DAYS} DAY)""")
def batch_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run without retention, then the same run with it: what is stored is not made again."""
    root = shared_path(spark, "batch")
    job.run(spark, root, "day", steps(sf_dir, retention=False))
    return job.run(spark, root, "day", steps(sf_dir, retention=True)).select("step", "status", "rows")


@R.query(f"""{ranking.SCORE_SQL}, stored AS (SELECT *, row_number() OVER (ORDER BY total DESC, keyword_id) AS rank FROM scored),
again AS (SELECT keyword_id, CAST(round(recency * 0.24 + frequency * 0.10 + authority * 0.14 + velocity * 0.30 + engagement * 0.22, 4) AS DOUBLE) AS replayed FROM stored),
r AS (SELECT s.keyword_id, s.total, s.rank, a.replayed, row_number() OVER (ORDER BY a.replayed DESC, s.keyword_id) AS replayed_rank FROM stored s JOIN again a USING (keyword_id))
SELECT count(*) AS compared, count(*) FILTER (WHERE total = replayed) AS score_matches, count(*) FILTER (WHERE rank = replayed_rank) AS rank_matches, coalesce(string_agg(keyword_id, ',' ORDER BY rank) FILTER (WHERE rank <> replayed_rank), '') AS mismatches FROM r""")
def stored_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot against totals and ranks that its stored axes give."""
    root = shared_path(spark, "replay")
    job.run(spark, root, "day", [s for s in steps(sf_dir, False) if s.name == "snapshot"])
    entry = job.Ledger(spark, root, "day").entry("snapshot")
    return ranking.rk.replay(spark.read.parquet(entry["path"]))


@R.query("""SELECT request, string_agg(id, ',' ORDER BY event_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY event_id) AS n FROM (SELECT event_type AS request, 'kw_' || (user_id % 40) AS id, min(event_id) AS event_id FROM events GROUP BY 1, 2)) WHERE n <= 20 GROUP BY 1""")
def request_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of each request: trimmed, of the allowed form, each once, the first twenty."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("request"), "event_id", F.concat(F.lit("  kw_"), (F.col("user_id") % 40).cast("string"), F.lit(" ")).alias("id"))
    bad = e.withColumn("id", F.lit("not valid!"))
    return ranking.rk.valid_ids(e.unionByName(bad), ["request"], "event_id").groupBy("request").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]), ",").alias("ids"))
