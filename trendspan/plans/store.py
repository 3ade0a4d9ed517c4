"""Queries over stored snapshots, keywords, names and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.operators.relational import best_of, first_per, insert_if_absent, keep_after, numbered, upsert
from trendspan.plans.registry import Registry
from trendspan.sources.tables import AS_OF_SNAPSHOTS, AS_OF_VIEWS, KEYWORDS_SQL, NAMES_SQL, SNAPSHOTS_SQL, VIEWS_SQL, keywords, names, snapshots, table, views

R = Registry()
WITH = f"WITH {KEYWORDS_SQL}, {SNAPSHOTS_SQL}, {NAMES_SQL}, {VIEWS_SQL}"


@R.query(f"""{WITH}
SELECT CAST(s.created_at AS DATE) AS day, k.keyword_id, arg_max(n.keyword, struct_pack(a := s.created_at, b := s.snapshot_id, c := k.rank, d := k.score)) AS keyword,
  arg_max(k.type, struct_pack(a := s.created_at, b := s.snapshot_id, c := k.rank, d := k.score, e := k.type)) AS type,
  CAST(count(DISTINCT k.snapshot_id) AS BIGINT) AS snapshots, CAST(count(*) AS BIGINT) AS appearances, CAST(min(k.rank) AS INTEGER) AS best_rank,
  round(avg(k.rank), 6) AS avg_rank, round(avg(k.score), 4) AS avg_score, max(k.seen_at) AS last_seen
FROM keywords k JOIN snapshots s USING (snapshot_id) JOIN names n USING (keyword_id)
WHERE s.created_at >= TIMESTAMP '{AS_OF_SNAPSHOTS}' - INTERVAL 365 DAY GROUP BY 1, 2""")
def daily_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily roll-up of each keyword: newest name and type, counts, best and mean rank, mean score."""
    s = keep_after(snapshots(spark, sf_dir), "created_at", AS_OF_SNAPSHOTS, 365)
    rows = keywords(spark, sf_dir).join(s, "snapshot_id").join(names(spark, sf_dir).select("keyword_id", "keyword"), "keyword_id")
    newest = F.struct("created_at", "snapshot_id", "rank", "score")
    return rows.groupBy(F.to_date("created_at").alias("day"), "keyword_id").agg(
        F.max_by("keyword", newest).alias("keyword"),
        F.max_by("type", F.struct("created_at", "snapshot_id", "rank", "score", "type")).alias("type"),
        F.count_distinct("snapshot_id").alias("snapshots"),
        F.count("*").alias("appearances"),
        F.min("rank").alias("best_rank"),
        F.round(F.avg("rank"), 6).alias("avg_rank"),
        F.round(F.avg("score"), 4).alias("avg_score"),
        F.max("seen_at").alias("last_seen"),
    )


@R.query(f"""{WITH}, recent AS (SELECT * FROM snapshots WHERE created_at >= TIMESTAMP '{AS_OF_SNAPSHOTS}' - INTERVAL 90 DAY),
best AS (SELECT k.keyword_id, k.rank, k.score, s.created_at, row_number() OVER (PARTITION BY k.keyword_id ORDER BY (CASE WHEN k.quantity >= 25 THEN 0 ELSE 1 END), s.created_at DESC, s.snapshot_id DESC, k.rank, k.score DESC) AS n
  FROM keywords k JOIN recent s USING (snapshot_id) WHERE k.rank <= 10),
counts AS (SELECT keyword_id, count(*) AS view_count, max(ts) AS last_viewed FROM views WHERE kind = 'view' GROUP BY 1)
SELECT b.keyword_id, CAST(coalesce(c.view_count, 0) AS BIGINT) AS view_count, c.last_viewed, CAST(b.rank AS INTEGER) AS rank, b.score FROM best b LEFT JOIN counts c USING (keyword_id) WHERE b.n = 1
ORDER BY view_count DESC, c.last_viewed DESC NULLS LAST, b.rank, b.keyword_id LIMIT 20""")
def hot_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of recent snapshots by views: rows with a summary first, then the newest; view counts joined left."""
    recent = keep_after(snapshots(spark, sf_dir), "created_at", AS_OF_SNAPSHOTS, 90)
    rows = keywords(spark, sf_dir).where("rank <= 10").join(recent, "snapshot_id")
    summary = F.when(F.col("quantity") >= 25, 0).otherwise(1)
    best = first_per(rows, ["keyword_id"], [summary.asc(), F.desc("created_at"), F.desc("snapshot_id"), F.asc("rank"), F.desc("score")])
    counts = views(spark, sf_dir).where("kind = 'view'").groupBy("keyword_id").agg(F.count("*").alias("view_count"), F.max("ts").alias("last_viewed"))
    out = best.join(counts, "keyword_id", "left").select("keyword_id", F.coalesce("view_count", F.lit(0)).cast("long").alias("view_count"), "last_viewed", "rank", "score")
    return out.orderBy(F.desc("view_count"), F.desc_nulls_last("last_viewed"), "rank", "keyword_id").limit(20)


@R.query(f"{WITH} SELECT s.snapshot_id, s.mode, s.created_at FROM snapshots s WHERE EXISTS (SELECT 1 FROM keywords k WHERE k.snapshot_id = s.snapshot_id) ORDER BY s.created_at DESC, s.snapshot_id DESC LIMIT 1")
def latest_with_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest snapshot that has a keyword."""
    kept = snapshots(spark, sf_dir).join(keywords(spark, sf_dir), "snapshot_id", "left_semi")
    return kept.select("snapshot_id", "mode", "created_at").orderBy(F.desc("created_at"), F.desc("snapshot_id")).limit(1)


@R.query(f"{WITH} SELECT mode, snapshot_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY created_at DESC, snapshot_id DESC) AS n FROM snapshots) WHERE n <= 16")
def latest_16_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 16 snapshots of each mode, the history that ranking looks at."""
    return first_per(snapshots(spark, sf_dir), ["mode"], [F.desc("created_at"), F.desc("snapshot_id")], 16).select("mode", "snapshot_id", "created_at")


@R.query(f"{WITH} SELECT keyword_id, rank, score, snapshot_id FROM keywords WHERE snapshot_id = (SELECT max(snapshot_id) FROM keywords) ORDER BY rank, score DESC, keyword_id LIMIT 10")
def top_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten keywords of the last snapshot by rank."""
    k = keywords(spark, sf_dir)
    last = k.agg(F.max("snapshot_id").alias("snapshot_id"))
    return k.join(F.broadcast(last), "snapshot_id").select("keyword_id", "rank", "score", "snapshot_id").orderBy("rank", F.desc("score"), "keyword_id").limit(10)


@R.query(f"""{WITH} SELECT DISTINCT n.keyword_id, n.keyword, n.alias FROM names n LEFT JOIN keywords k USING (keyword_id)
WHERE n.keyword ILIKE '%ring%' OR n.alias ILIKE '%ECON%' OR CAST(k.status AS VARCHAR) ILIKE 'zz'""")
def search_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive pattern search over names and aliases; the user's % and _ stay patterns."""
    n, k = names(spark, sf_dir), keywords(spark, sf_dir).select("keyword_id", "status").distinct()
    hit = F.col("keyword").ilike("%ring%") | F.col("alias").ilike("%ECON%") | F.col("status").ilike("zz")
    return n.join(k, "keyword_id", "left").where(hit).select("keyword_id", "keyword", "alias").distinct()


@R.query("""SELECT source, lang, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang = 'fr' THEN 0 ELSE 1 END, doc_id) AS INTEGER) AS position,
  coalesce(nullif(CASE WHEN lang = 'en' THEN text ELSE '' END, ''), lower(text)) AS label FROM documents""")
def sources_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by type, one language first, then id, with a localised label (empty counts as missing)."""
    d = table(spark, sf_dir, "documents")
    rows = d.select("source", "lang", "doc_id", F.when(F.col("lang") == "fr", 0).otherwise(1).alias("later"), F.floor(F.col("doc_id") / 100_000).alias("range"))
    placed = numbered(rows, ["source"], ["later", "range"], [F.asc("doc_id")], "position").select("doc_id", F.col("position").cast("int").alias("position"))
    english = F.when(F.col("lang") == "en", F.col("text")).otherwise("")
    return d.join(placed, "doc_id").select("source", "lang", "doc_id", "position", F.coalesce(F.nullif(english, F.lit("")), F.lower("text")).alias("label"))


@R.query(f"""{WITH}, days AS (SELECT keyword_id, CAST(ts AS DATE) AS day, count(*) AS n FROM views GROUP BY 1, 2),
numbered AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY day DESC) AS k FROM days)
SELECT keyword_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY day) AS counts FROM numbered WHERE k <= 7 GROUP BY 1""")
def sparkline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's newest seven daily rows, oldest first."""
    days = views(spark, sf_dir).groupBy("keyword_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    newest = first_per(days, ["keyword_id"], [F.desc("day")], 7)
    ordered = F.array_sort(F.collect_list(F.struct("day", F.col("n").cast("string").alias("n"))))
    return newest.groupBy("keyword_id").agg(F.array_join(F.transform(ordered, lambda x: x["n"]), ",").alias("counts"))


RANKED_SQL = f"""{WITH}, ranked AS (SELECT snapshot_id, keyword_id, sum(score) AS total FROM keywords GROUP BY 1, 2),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY snapshot_id ORDER BY total DESC, keyword_id) AS INTEGER) AS rank FROM ranked),
ordered AS (SELECT snapshot_id, mode, CAST(row_number() OVER (PARTITION BY mode ORDER BY created_at, snapshot_id) AS INTEGER) AS seq FROM snapshots)"""


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each snapshot's keywords, one row a keyword, ranked by total."""
    totals = keywords(spark, sf_dir).groupBy("snapshot_id", "keyword_id").agg(F.sum("score").alias("total"))
    return totals.withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("total"), "keyword_id")))


def newest(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """The newest snapshots of each mode with their ``age`` from 0; only these few are moved."""
    order = Window.partitionBy("mode").orderBy(F.desc("created_at"), F.desc("snapshot_id"))
    placed = snapshots(spark, sf_dir).select("snapshot_id", "mode", F.row_number().over(order).alias("n")).where(F.col("n") <= most)
    return placed.select("snapshot_id", "mode", (F.col("n") - 1).alias("age"))


def sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode's snapshots numbered in time: days are numbered apart, and start at the sizes of the days before."""
    s = snapshots(spark, sf_dir).select("snapshot_id", "mode", "created_at", F.to_date("created_at").alias("day"))
    return numbered(s, ["mode"], ["day"], [F.asc("created_at"), F.asc("snapshot_id")], "seq").select("snapshot_id", "mode", F.col("seq").cast("int").alias("seq"))


@R.query(f"""{RANKED_SQL}, p AS (SELECT mode, seq, keyword_id, rank FROM placed JOIN ordered USING (snapshot_id))
SELECT a.mode, a.seq, a.keyword_id, a.rank, b.rank - a.rank AS delta_rank, b.rank IS NULL AS is_new
FROM p a LEFT JOIN p b ON a.mode = b.mode AND a.seq = b.seq + 1 AND a.keyword_id = b.keyword_id""")
def prev_rank_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank change against the snapshot before; new where that one hadn't the keyword."""
    p = ranked(spark, sf_dir).join(sequence(spark, sf_dir), "snapshot_id").select("mode", "seq", "keyword_id", "rank")
    # The keyword's row before is the snapshot before's only if that one is next to it.
    w = Window.partitionBy("mode", "keyword_id").orderBy("seq")
    p = p.withColumn("prev", F.when(F.lag("seq").over(w) == F.col("seq") - 1, F.lag("rank").over(w)))
    return p.select("mode", "seq", "keyword_id", "rank", (F.col("prev") - F.col("rank")).alias("delta_rank"), F.col("prev").isNull().alias("is_new"))


@R.query(f"""{RANKED_SQL}, newest AS (SELECT *, max(seq) OVER (PARTITION BY mode) - seq AS age FROM ordered),
h AS (SELECT mode, age, keyword_id, rank FROM placed JOIN newest USING (snapshot_id) WHERE age < 16 AND rank <= 10)
SELECT mode, keyword_id, CAST(count(*) AS BIGINT) AS appearances, CAST(max(rank) FILTER (WHERE age = 0) AS INTEGER) AS previous_rank FROM h GROUP BY 1, 2""")
def appearances_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a keyword was in the top ten of the last 16 snapshots, and its rank in the newest."""
    last = newest(spark, sf_dir, 16)
    # Only the keywords of these few snapshots are ranked.
    totals = keywords(spark, sf_dir).join(F.broadcast(last), "snapshot_id").groupBy("snapshot_id", "mode", "age", "keyword_id").agg(F.sum("score").alias("total"))
    h = totals.withColumn("rank", F.row_number().over(Window.partitionBy("snapshot_id").orderBy(F.desc("total"), "keyword_id"))).where("rank <= 10")
    return h.groupBy("mode", "keyword_id").agg(F.count("*").alias("appearances"), F.max(F.when(F.col("age") == 0, F.col("rank"))).alias("previous_rank"))


@R.query(f"""{RANKED_SQL} SELECT keyword_id, string_agg(CAST(rank AS VARCHAR), ',' ORDER BY seq, mode) AS ranks, CAST(count(*) AS BIGINT) AS n
FROM placed JOIN ordered USING (snapshot_id) GROUP BY 1""")
def rank_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every keyword's ranks over the snapshots, oldest first."""
    rows = ranked(spark, sf_dir).join(sequence(spark, sf_dir), "snapshot_id")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "mode", F.col("rank").cast("string").alias("rank"))))
    return rows.groupBy("keyword_id").agg(F.array_join(F.transform(ordered, lambda x: x["rank"]), ",").alias("ranks"), F.count("*").alias("n"))


@R.query(f"""{WITH} SELECT snapshot_id, keyword_id, type, min(seen_at) AS seen_at FROM keywords GROUP BY 1, 2, 3""")
def source_rows_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (snapshot, keyword, type): the first by time."""
    return first_per(keywords(spark, sf_dir), ["snapshot_id", "keyword_id", "type"], [F.asc("seen_at")]).select("snapshot_id", "keyword_id", "type", "seen_at")


@R.query(f"""{WITH} SELECT mode, keyword, expires FROM (SELECT s.mode, lower(n.keyword) AS keyword, max(k.seen_at) AS expires,
   row_number() OVER (PARTITION BY s.mode, lower(n.keyword) ORDER BY CASE WHEN max(k.seen_at) > TIMESTAMP '2000-01-01' THEN 0 ELSE 1 END, max(k.seen_at) DESC, k.keyword_id DESC) AS n
   FROM keywords k JOIN snapshots s USING (snapshot_id) JOIN names n USING (keyword_id) GROUP BY s.mode, n.keyword, k.keyword_id) WHERE n = 1""")
def manual_rows_deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each (mode, lower-cased keyword): active before expired, then the latest to expire, then the largest id."""
    rows = keywords(spark, sf_dir).join(snapshots(spark, sf_dir), "snapshot_id").join(names(spark, sf_dir).select("keyword_id", "keyword"), "keyword_id")
    by_id = rows.groupBy("mode", "keyword", "keyword_id").agg(F.max("seen_at").alias("expires")).withColumn("keyword", F.lower("keyword"))
    active = F.when(F.col("expires") > F.lit("2000-01-01").cast("timestamp_ntz"), 0).otherwise(1)
    return first_per(by_id, ["mode", "keyword"], [active.asc(), F.desc("expires"), F.desc("keyword_id")]).select("mode", "keyword", "expires")


@R.query(f"""{WITH} SELECT keyword AS alias, keyword_id AS canonical_id FROM (SELECT n.keyword, k.keyword_id, row_number() OVER (PARTITION BY n.keyword ORDER BY max(k.seen_at) DESC, k.keyword_id) AS r
 FROM names n JOIN keywords k USING (keyword_id) GROUP BY n.keyword, k.keyword_id) WHERE r = 1""")
def alias_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest mapping of each alias to an id."""
    seen = keywords(spark, sf_dir).groupBy("keyword_id").agg(F.max("seen_at").alias("seen"))
    rows = names(spark, sf_dir).select("keyword_id", "keyword").join(seen, "keyword_id")
    return first_per(rows, ["keyword"], [F.desc("seen"), F.asc("keyword_id")]).select(F.col("keyword").alias("alias"), F.col("keyword_id").alias("canonical_id"))


@R.query("""SELECT s.s_suppkey AS channel_id, s.s_name AS channel, m.latest FROM supplier s LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS latest FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) m ON s.s_suppkey = m.l_suppkey""")
def channel_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every channel with its latest upload, if any."""
    latest = keywords(spark, sf_dir).where("type = 'R'").groupBy("source_id").agg(F.max("seen_at").alias("latest"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("channel"))
    return s.join(latest, "source_id", "left").select(F.col("source_id").alias("channel_id"), "channel", "latest")


@R.query(f"""{WITH} SELECT k.keyword_id, k.snapshot_id, k.rank, k.score FROM keywords k WHERE k.seen_at = (SELECT max(x.seen_at) FROM keywords x WHERE x.keyword_id = k.keyword_id)""")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of each keyword's latest time: a correlated MAX as a join with its aggregate."""
    k = keywords(spark, sf_dir)
    latest = k.groupBy("keyword_id").agg(F.max("seen_at").alias("seen_at"))
    return k.join(latest, ["keyword_id", "seen_at"]).select("keyword_id", "snapshot_id", "rank", "score")


@R.query("SELECT p.p_partkey AS keyword_id, p.p_name AS keyword FROM part p WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_partkey = p.p_partkey AND l.l_quantity > 45)")
def orphan_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a row that refers to them."""
    used = keywords(spark, sf_dir).where("quantity > 45").select("keyword_id")
    return names(spark, sf_dir).join(used, "keyword_id", "left_anti").select("keyword_id", "keyword")


@R.query("SELECT l.l_orderkey AS snapshot_id, CAST(count(*) AS BIGINT) AS n FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = l.l_orderkey AND o.o_orderdate < TIMESTAMP '1999-01-01') GROUP BY 1")
def delete_using_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DELETE ... USING: what is left of the keywords once those of old snapshots are gone."""
    old = snapshots(spark, sf_dir).where(F.col("created_at") < F.lit("1999-01-01").cast("timestamp_ntz")).select("snapshot_id")
    return keywords(spark, sf_dir).join(old, "snapshot_id", "left_anti").groupBy("snapshot_id").agg(F.count("*").alias("n"))


RETENTION = {"snapshots": ("orders", "o_orderdate", AS_OF_SNAPSHOTS, 90), "keywords": ("lineitem", "l_shipdate", AS_OF_SNAPSHOTS, 90), "daily_stats": ("orders", "o_orderdate", AS_OF_SNAPSHOTS, 365), "view_events": ("events", "ts", AS_OF_VIEWS, 3), "naver_sources": ("events", "ts", AS_OF_VIEWS, 7), "videos": ("events", "ts", AS_OF_VIEWS, 30)}


@R.query(" UNION ALL ".join(f"SELECT '{k}' AS relation, CAST(count(*) FILTER (WHERE {c} < TIMESTAMP '{a}' - INTERVAL {d} DAY) AS BIGINT) AS deleted, CAST(count(*) FILTER (WHERE {c} >= TIMESTAMP '{a}' - INTERVAL {d} DAY) AS BIGINT) AS kept FROM {t}" for k, (t, c, a, d) in RETENTION.items()))
def retention_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of each relation retention deletes and keeps."""
    out = None
    for relation, (name, column, as_of, days) in RETENTION.items():
        old = F.col(column) < F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
        one = table(spark, sf_dir, name).agg(F.count_if(old).alias("deleted"), F.count_if(~old).alias("kept")).select(F.lit(relation).alias("relation"), "deleted", "kept")
        out = one if out is None else out.unionAll(one)
    return out


@R.query("SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 100 ELSE c_acctbal END AS balance, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def merge_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge by key: even customers are stored, those divisible by three arrive; a null segment keeps the old one."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    target = c.where("id % 2 = 0")
    source = c.where("id % 3 = 0").select("id", "name", (F.col("balance") + 100).alias("balance"), F.when(F.col("id") % 2 == 0, "UPDATED").otherwise(F.col("segment")).alias("segment"))
    return upsert(target, source, ["id"], {"segment": F.coalesce(F.col("new.segment"), F.col("old.segment"))})


@R.query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'NEW' END AS segment FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert the rows whose key is not there yet."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return insert_if_absent(c.where("id % 2 = 0"), c.where("id % 3 = 0").select("id", F.lit("NEW").alias("segment")), ["id"])


@R.query("SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 5 = 0 THEN 'promo' END, c_mktsegment) AS segment, coalesce(CASE WHEN c_custkey % 7 = 0 THEN 0.0 END, c_acctbal) AS balance FROM customer")
def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partial update: COALESCE(new, old) column by column."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"))
    patch = c.where("id % 5 = 0 or id % 7 = 0").select("id", F.when(F.col("id") % 5 == 0, "promo").alias("new_segment"), F.when(F.col("id") % 7 == 0, F.lit(0.0)).alias("new_balance"))
    return c.join(patch, "id", "left").select("id", F.coalesce("new_segment", "segment").alias("segment"), F.coalesce("new_balance", "balance").alias("balance"))


@R.query(f"""{WITH} SELECT DISTINCT keyword_id, viewer, date_trunc('hour', ts) AS bucket FROM views WHERE kind = 'view'""")
def view_dedup_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view for each keyword, viewer and hour."""
    v = views(spark, sf_dir).where("kind = 'view'")
    return v.select("keyword_id", "viewer", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bucket")).distinct()


@R.query(f"""{WITH} SELECT keyword_id, CAST(count(*) AS BIGINT) AS view_count, max(bucket) AS last_hour FROM (SELECT DISTINCT keyword_id, viewer, date_trunc('hour', ts) AS bucket FROM views WHERE kind = 'view') GROUP BY 1""")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of each keyword after hourly dedup."""
    return view_dedup_hourly(spark, sf_dir).groupBy("keyword_id").agg(F.count("*").alias("view_count"), F.max("bucket").alias("last_hour"))


@R.query("""SELECT event_type AS source, max(ts) AS last_published, CAST(count(*) AS BIGINT) AS n,
 CAST(greatest(24, least(96, ceil((epoch(TIMESTAMP '2024-02-02 00:00:00' - max(ts)) + 45 * 60) / 3600.0))) AS INTEGER) AS window_hours FROM events GROUP BY 1""")
def incremental_window_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far back each source is read next: since its newest item plus an overlap, between 24 and 96 hours."""
    from trendspan.functions.times import window_hours

    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").alias("last_published"), F.count("*").alias("n"))
    return runs.withColumn("window_hours", window_hours(F.lit("2024-02-02 00:00:00").cast("timestamp_ntz"), F.col("last_published")))


@R.query("""SELECT o_orderkey AS id, o_orderdate + INTERVAL 24 HOUR AS expires, CAST(greatest(0, epoch((o_orderdate + INTERVAL 24 HOUR) - TIMESTAMP '1998-10-03 12:00:00')) AS BIGINT) AS remaining_seconds
FROM orders WHERE o_orderstatus <> 'F' AND o_orderdate <= TIMESTAMP '1998-10-03 12:00:00' AND TIMESTAMP '1998-10-03 12:00:00' < o_orderdate + INTERVAL 24 HOUR""")
def active_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled rows that have started and not expired, with the seconds left."""
    now = F.lit("1998-10-03 12:00:00").cast("timestamp_ntz")
    rows = snapshots(spark, sf_dir).where("mode <> 'F'").withColumn("expires", F.col("created_at") + F.expr("INTERVAL 24 HOURS"))
    left = F.unix_timestamp(F.col("expires").cast("timestamp")) - F.unix_timestamp(now.cast("timestamp"))
    return rows.where((F.col("created_at") <= now) & (now < F.col("expires"))).select(F.col("snapshot_id").alias("id"), "expires", F.greatest(F.lit(0), left).cast("long").alias("remaining_seconds"))


@R.query(f"""{WITH} SELECT k.snapshot_id, k.keyword_id, k.rank FROM keywords k LEFT JOIN (SELECT DISTINCT keyword_id FROM names WHERE size > 25) a USING (keyword_id)
WHERE NOT (regexp_matches('manual_realtime_' || CAST(k.keyword_id AS VARCHAR), '^manual_realtime_[a-z0-9]+$') AND k.type = 'R' AND a.keyword_id IS NULL)""")
def hide_expired_manual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored snapshot without its manual rows that are no longer active."""
    k = keywords(spark, sf_dir)
    active = names(spark, sf_dir).where("size > 25").select("keyword_id", F.lit(True).alias("active"))
    manual = F.concat(F.lit("manual_realtime_"), F.col("keyword_id").cast("string")).rlike("^manual_realtime_[a-z0-9]+$") & (F.col("type") == "R")
    return k.join(active, "keyword_id", "left").where(~(manual & F.col("active").isNull())).select("snapshot_id", "keyword_id", "rank")


@R.query(f"""{WITH}, last4 AS (SELECT snapshot_id, mode, created_at FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY created_at DESC, snapshot_id DESC) AS n FROM snapshots) WHERE n <= 4),
newest AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY created_at DESC, snapshot_id DESC, rank, score) AS r FROM keywords JOIN last4 USING (snapshot_id))
SELECT keyword_id, CASE WHEN quantity >= 10 THEN snapshot_id END AS reused_from FROM newest WHERE r = 1""")
def snapshot_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each keyword in the last four snapshots; none is reused if that row has no sources."""
    last = first_per(snapshots(spark, sf_dir), ["mode"], [F.desc("created_at"), F.desc("snapshot_id")], 4)
    rows = keywords(spark, sf_dir).join(F.broadcast(last), "snapshot_id")
    newest = first_per(rows, ["keyword_id"], [F.desc("created_at"), F.desc("snapshot_id"), F.asc("rank"), F.asc("score")])
    return newest.select("keyword_id", F.when(F.col("quantity") >= 10, F.col("snapshot_id")).alias("reused_from"))


@R.query(f"""{WITH}, s AS (SELECT count(DISTINCT snapshot_id) AS n FROM snapshots),
 k AS (SELECT keyword_id, count(DISTINCT snapshot_id) AS snapshots, round(avg(score + discount + tax), 4) AS mean FROM keywords GROUP BY 1)
SELECT keyword_id, CAST(snapshots AS BIGINT) AS snapshots, mean, snapshots >= greatest(3, floor(0.4 * s.n)) AS is_evergreen FROM k, s""")
def evergreen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords that are in many snapshots: their number against a threshold that grows with all snapshots."""
    total = snapshots(spark, sf_dir).agg(F.count_distinct("snapshot_id").alias("total"))
    k = keywords(spark, sf_dir).groupBy("keyword_id").agg(F.count_distinct("snapshot_id").alias("snapshots"), F.round(F.avg(F.col("score") + F.col("discount") + F.col("tax")), 4).alias("mean"))
    threshold = F.greatest(F.lit(3), F.floor(F.lit(0.4) * total.scalar()))
    return k.select("keyword_id", "snapshots", "mean", (F.col("snapshots") >= threshold).alias("is_evergreen"))


@R.query(f"""{WITH}, g AS (SELECT source_id AS feed, keyword_id, sum(quantity) AS q, max(rank) AS r FROM keywords GROUP BY 1, 2)
SELECT feed, CAST(count(*) AS BIGINT) AS found, CAST(count(*) FILTER (WHERE q >= 25) AS BIGINT) AS candidates, CAST(count(*) FILTER (WHERE q >= 50) AS BIGINT) AS released, round(avg(q) FILTER (WHERE q >= 50), 2) AS avg_release FROM g GROUP BY 1""")
def feed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each feed what was found, what became a candidate and what was released."""
    g = keywords(spark, sf_dir).groupBy(F.col("source_id").alias("feed"), "keyword_id").agg(F.sum("quantity").alias("q"))
    return g.groupBy("feed").agg(F.count("*").alias("found"), F.count_if(F.col("q") >= 25).alias("candidates"), F.count_if(F.col("q") >= 50).alias("released"), F.round(F.avg(F.when(F.col("q") >= 50, F.col("q"))), 2).alias("avg_release"))


@R.query(f"""{WITH}, latest AS (SELECT keyword_id, max(snapshot_id) AS snapshot_id FROM keywords GROUP BY 1) SELECT k.keyword_id, min(k.rank) AS rank, max(k.score) AS score FROM keywords k JOIN latest USING (keyword_id, snapshot_id) GROUP BY 1""")
def keyword_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's entry in the last snapshot that has it."""
    return best_of(keywords(spark, sf_dir).groupBy("keyword_id", "snapshot_id").agg(F.min("rank").alias("rank"), F.max("score").alias("score")), ["keyword_id"], F.col("snapshot_id"), ["rank", "score"])


@R.query("SELECT o_orderkey AS snapshot_id FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def delete_empty_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshots that stay when those without keywords are deleted."""
    return snapshots(spark, sf_dir).join(keywords(spark, sf_dir), "snapshot_id", "left_semi").select("snapshot_id")


@R.query("SELECT n_nationkey AS id, coalesce(nullif(CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE n_name END, ''), 'name ' || CAST(n_nationkey AS VARCHAR)) AS name, CASE WHEN n_regionkey IN (0, 1, 2) THEN 'news' WHEN n_regionkey = 3 THEN 'social' ELSE 'data' END AS kind FROM nation")
def backfill_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Empty names filled from the other language, and enum values repaired."""
    n = table(spark, sf_dir, "nation")
    name = F.when(F.col("n_nationkey") % 2 == 0, "").otherwise(F.col("n_name"))
    kind = F.when(F.col("n_regionkey").isin(0, 1, 2), "news").when(F.col("n_regionkey") == 3, "social").otherwise("data")
    return n.select(F.col("n_nationkey").alias("id"), F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("name "), F.col("n_nationkey").cast("string"))).alias("name"), kind.alias("kind"))
