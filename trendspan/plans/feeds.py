"""Queries over feeds, served answers, sinks and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.functions import text as tx
from trendspan.operators import sinks
from trendspan.operators.relational import first_per
from trendspan.plans import store
from trendspan.plans.registry import Registry
from trendspan.sources import mappers as mp
from trendspan.sources.tables import AS_OF_ITEMS, ITEMS_SQL, items, pages, table
from trendspan.streaming import limits as lm
from trendspan.streaming import views as sv

R = Registry()


@R.query(f"""WITH {ITEMS_SQL} SELECT item_idx, trim(regexp_replace(title, '[<>&\\n]', ' ', 'g')) AS title, 'https://www.' || domain || '.example.com/a?b=1&c=' || item_idx AS link, published_at, domain || '.example.com' AS source_domain
FROM items WHERE published_at > TIMESTAMP '{AS_OF_ITEMS}' - INTERVAL 72 HOUR AND length(trim(regexp_replace(title, '[<>&\\n]', ' ', 'g'))) > 0""")
def rss_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items written as RSS with a bare ampersand in the link, repaired and parsed again, within a window."""
    i = items(spark, sf_dir)
    title = F.regexp_replace("title", r"[<>&\n]", " ")
    link = F.concat(F.lit("https://www."), "domain", F.lit(".example.com/a?b=1&c="), F.col("item_idx").cast("string"))
    xml = F.concat(F.lit("<rss><channel><item><title><![CDATA["), title, F.lit("]]></title><link>"), link, F.lit("</link><pubDate>"), F.date_format("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"))
    parsed = mp.rss_entries(i.select("item_idx", xml.alias("xml")))
    return mp.in_window(parsed, AS_OF_ITEMS, 72).select("item_idx", F.trim("title").alias("title"), tx.strip_html(F.col("link")).alias("link"), "published_at", "source_domain")


@R.query("""SELECT item_id, 'Link ' || item_id || ' of a digest' AS title, 'https://news' || (item_id % 9) || '.example.org/' || item_id AS link FROM benchmark UNION ALL SELECT item_id, regexp_replace(text, '[\\[\\]\\n]', ' ', 'g'), 'https://b.example.org/x' FROM benchmark WHERE length(text) >= 5""")
def digest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of a markdown digest; short titles and social sites are left out."""
    n = F.col("item_id").cast("string")
    title = F.regexp_replace("text", r"[\[\]\n]", " ")
    md = F.concat(F.lit("| [Link "), n, F.lit(" of a digest](https://news"), (F.col("item_id") % 9).cast("string"), F.lit(".example.org/"), n, F.lit(") | [x](https://a.example.org) | [Some social post](https://x.com/1) | ["), title, F.lit("](https://b.example.org/x) |"))
    return mp.markdown_links(table(spark, sf_dir, "benchmark").select("item_id", md.alias("text")))


@R.query("""SELECT item_id, CAST(2 AS BIGINT) AS entry, '2024-01-0' || (item_id % 9 + 1) AS day, substr(array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), ' '), 1, 1200) AS body FROM benchmark UNION ALL SELECT item_id, 1, 'March 5, 2024', 'first body' FROM benchmark""")
def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated entries of a changelog."""
    text = F.concat(F.lit("Changelog\n## March 5, 2024\nfirst body\n\n2024-01-0"), (F.col("item_id") % 9 + 1).cast("string"), F.lit("\n"), "text")
    return mp.changelog_entries(table(spark, sf_dir, "benchmark").select("item_id", text.alias("text")))


@R.query("""SELECT item_id, 'Section ' || item_id AS title, text || CASE WHEN item_id % 3 = 0 THEN chr(10) || chr(10) || '쉬운설명: plain ' || item_id ELSE '' END AS summary, CAST(CASE WHEN item_id % 2 = 0 THEN 8 ELSE 5 END AS INTEGER) AS importance,
 'https://n.example.org/' || item_id AS link, CASE WHEN item_id % 4 = 0 THEN 'https://i.example.org/x.png' END AS image FROM (SELECT item_id, trim(regexp_replace(text, '[*#-]', '', 'g')) AS text FROM benchmark) WHERE text <> ''""")
def newsletter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of a newsletter with their fields; one without a link is none."""
    k, n = F.col("item_id"), F.col("item_id").cast("string")
    body = F.trim(F.regexp_replace("text", "[*#-]", ""))
    field = lambda name, value, when: F.when(when, F.concat(F.lit(f"\n**{name}**: "), value)).otherwise("")
    image = F.when(k % 4 == 0, "\n![Image](https://i.example.org/x.png)").otherwise("")
    always = F.lit(True)
    text = F.concat(F.lit("## Hello\nno link\n---\n## 제목: Section "), n, image, field("요약", body, always), field("쉬운설명", F.concat(F.lit("plain "), n), k % 3 == 0), field("중요도", F.lit("8"), k % 2 == 0), field("전체링크", F.concat(F.lit("https://n.example.org/"), n), always))
    return mp.newsletter_sections(table(spark, sf_dir, "benchmark").where(body != "").select("item_id", text.alias("text")))


@R.query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 14 AS daily_rank FROM customer) SELECT 'AI tool ' || id AS name, CAST(daily_rank AS INTEGER) AS daily_rank, CASE WHEN daily_rank <= 3 THEN 0.9 WHEN daily_rank <= 10 THEN 0.84 ELSE 0.72 END::DOUBLE AS authority_override,
 CASE WHEN daily_rank <= 3 THEN 2.0 WHEN daily_rank <= 10 THEN 1.0 ELSE 0.5 END::DOUBLE AS domain_bonus FROM p WHERE daily_rank > 0 AND id % 3 = 0 AND id % 2 = 0""")
def product_launches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Today's products with a rank, an AI word and their signal."""
    k = F.col("c_custkey")
    featured = F.when(k % 2 == 0, "2024-01-31 09:30:00").otherwise("2024-02-03 09:00:00").cast("timestamp_ntz")
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.when(k % 3 == 0, "AI tool ").otherwise("Sofa "), k.cast("string")).alias("name"),
        F.lit("for homes").alias("tagline"),
        F.lit("https://p.example.org").alias("website"),
        F.array(F.lit("home")).alias("topics"),
        F.lit("https://ph.example.org").alias("url"),
        (k % 14).cast("int").alias("daily_rank"),
        featured.alias("featured_at"),
    )
    return mp.launches(c, "2024-01-31 20:00:00").select("name", "daily_rank", "authority_override", "domain_bonus")


@R.query("""SELECT 'org/m' || (p_partkey % 500) AS link_id, arg_min('Model ' || p_partkey, p_partkey) AS title FROM part GROUP BY 1""")
def model_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models whose variants fall into one."""
    k = F.col("p_partkey")
    m = table(spark, sf_dir, "part").select(F.concat(F.lit("org/m"), (k % 500).cast("string"), F.when(k >= 500, F.concat(F.lit(":v"), k.cast("string"))).otherwise("")).alias("id"), F.concat(F.lit("Model "), k.cast("string"), F.when(k % 2 == 0, " (free)").otherwise("")).alias("name"), k.alias("created"), F.col("p_size").alias("context_length"))
    out = mp.model_list(m)
    return out.select(F.regexp_replace("link", "^https://models.example/", "").alias("link_id"), "title")


@R.query("""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN length(b) < 300 THEN 'too_short' END AS failure, CAST(length(b) AS INTEGER) AS n FROM (SELECT doc_id, substr(trim(regexp_replace(text, '\\n{3,}', chr(10) || chr(10), 'g')), 1, 6000) AS b FROM documents)""")
def reader_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full texts for summaries, and why others fail."""
    d = table(spark, sf_dir, "documents").withColumn("url", F.when(F.col("doc_id") % 5 == 0, "https://a.example.org/x.pdf?y").otherwise("https://a.example.org/x"))
    return mp.reader_text(d).select("doc_id", "failure", F.length("body").alias("n"))


@R.query(f"""WITH {ITEMS_SQL}, d AS (SELECT CAST(published_at AS DATE) AS day, item_idx, domain, row_number() OVER (PARTITION BY CAST(published_at AS DATE) ORDER BY points DESC, item_idx) AS n FROM items), t AS (SELECT * FROM d WHERE n <= 5),
g AS (SELECT day, list_sort(list_distinct(list(replace('t/' || domain, '/', '_')))) AS tags, string_agg('- [Item ' || item_idx || '](https://x/' || item_idx || ')', chr(10) ORDER BY n) AS body FROM t GROUP BY 1)
SELECT day, '---' || chr(10) || 'tags:' || chr(10) || '  - ' || array_to_string(tags, chr(10) || '  - ') || chr(10) || '---' || chr(10) || body AS document FROM g""")
def daily_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's best five items as a document with front matter."""
    i = items(spark, sf_dir).withColumn("day", F.to_date("published_at"))
    top = i.withColumn("position", F.row_number().over(Window.partitionBy("day").orderBy(F.desc("points"), "item_idx"))).where("position <= 5")
    n = F.col("item_idx").cast("string")
    rows = top.select("day", "position", F.concat(F.lit("Item "), n).alias("title"), F.concat(F.lit("https://x/"), n).alias("link"), F.array(F.concat(F.lit("t/"), "domain")).alias("tags"))
    return sinks.daily_markdown(rows)


@R.query(f"""WITH {ITEMS_SQL}, d AS (SELECT domain, tier, item_idx, row_number() OVER (PARTITION BY domain ORDER BY item_idx) AS n FROM items),
l AS (SELECT *, lag(tier) OVER (PARTITION BY domain ORDER BY n) AS before FROM d WHERE n <= 5) SELECT domain, string_agg(CASE WHEN before <> tier THEN chr(10) ELSE '' END || n || '. Item ' || item_idx || ' - short', chr(10) ORDER BY n) AS message FROM l GROUP BY 1""")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each domain's first five items as a message, parted by tier."""
    i = items(spark, sf_dir).select("domain", F.col("tier").alias("category"), F.col("item_idx").alias("position"), F.concat(F.lit("Item "), F.col("item_idx").cast("string")).alias("title"), F.lit("short").alias("summary"))
    return sinks.messages(i, "domain")


@R.query(f"""{store.RANKED_SQL}, p AS (SELECT mode, seq, keyword_id, rank FROM placed JOIN ordered USING (snapshot_id)), last AS (SELECT mode, max(seq) AS seq FROM ordered WHERE snapshot_id IN (SELECT snapshot_id FROM keywords) GROUP BY 1)
SELECT a.mode, a.rank, '**' || a.rank || '.** ' || n.keyword || ' (' || CASE WHEN b.rank IS NULL THEN 'NEW' WHEN b.rank > a.rank THEN '▲' || (b.rank - a.rank) WHEN b.rank < a.rank THEN '▼' || (a.rank - b.rank) ELSE '-' END || ')' AS line
FROM p a JOIN last USING (mode, seq) JOIN names n USING (keyword_id) LEFT JOIN p b ON a.mode = b.mode AND a.seq = b.seq + 1 AND a.keyword_id = b.keyword_id WHERE a.rank <= 10""")
def trends_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served list: each mode's newest snapshot with keywords, its first ten with their change of rank."""
    from trendspan.sources.tables import keywords, names

    seq = store.sequence(spark, sf_dir)
    last = seq.join(keywords(spark, sf_dir), "snapshot_id", "left_semi").groupBy("mode").agg(F.max("seq").alias("seq"))
    # Only the two newest snapshots of a mode are ranked.
    near = seq.join(F.broadcast(last.withColumnRenamed("seq", "top")), "mode").where("seq between top - 1 and top")
    k = keywords(spark, sf_dir).join(F.broadcast(near), "snapshot_id").groupBy("mode", "seq", "top", "keyword_id").agg(F.sum("score").alias("total"))
    placed = k.withColumn("rank", F.row_number().over(Window.partitionBy("mode", "seq").orderBy(F.desc("total"), "keyword_id")))
    now, before = placed.where("seq = top and rank <= 10"), placed.where("seq = top - 1").select("mode", "keyword_id", F.col("rank").alias("prev"))
    rows = now.join(before, ["mode", "keyword_id"], "left").join(names(spark, sf_dir).select("keyword_id", "keyword"), "keyword_id")
    lines = sinks.answer_lines(rows.select("mode", "rank", "keyword", (F.col("prev") - F.col("rank")).alias("delta_rank"), F.col("prev").isNull().alias("is_new")))
    return lines.select("mode", "rank", "line")


@R.query("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY regexp_extract(url, '^https?://([^/?#]+)', 1) ORDER BY page_id) AS n FROM pages) WHERE n <= 3")
def feed_release_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three entries of each feed."""
    return first_per(pages(spark, sf_dir), [F.regexp_extract("url", "^https?://([^/?#]+)", 1)], [F.asc("page_id")], 3).select("page_id", "url")


@R.query("SELECT l.doc_id, CAST(l.quality AS INTEGER) AS quality, coalesce(d.n_chars, -1) AS n_chars FROM (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l LEFT JOIN documents d USING (doc_id) WHERE l.quality IS NULL OR isnan(l.quality::DOUBLE) OR l.quality >= 1")
def event_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold that lets rows without a score through."""
    l = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    kept = l.where(F.col("quality").isNull() | F.isnan(F.col("quality").cast("double")) | (F.col("quality") >= 1))
    return kept.join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "left").select("doc_id", "quality", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))


@R.query("SELECT DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT) AS keyword_id, user_id AS viewer, date_trunc('hour', ts) AS bucket FROM events WHERE event_type = 'view'")
def stream_view_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views after hourly dedup, by a stream over the events that are there."""
    found = sv.run_to_end(sv.dedup_views(sv.event_stream(spark, sf_dir)), spark, "views")
    return found.select("keyword_id", "viewer", F.col("bucket").cast("timestamp_ntz").alias("bucket"))


@R.query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS keyword_id, CAST(count(*) AS BIGINT) AS view_count FROM events WHERE event_type = 'view' GROUP BY 1")
def stream_view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View counters kept by a stream's batches."""
    return sv.count_views(spark, sv.event_stream(spark, sf_dir))


@R.query(f"""WITH RECURSIVE e AS (SELECT user_id AS viewer, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events),
st AS (SELECT viewer, min(t) AS s FROM e GROUP BY 1 UNION ALL SELECT st.viewer, min(e.t) AS s FROM st JOIN e ON e.viewer = st.viewer AND e.t >= st.s + {sv.WINDOW_SECONDS} GROUP BY st.viewer, st.s),
w AS (SELECT st.viewer, st.s, count(*) AS c FROM st JOIN e ON e.viewer = st.viewer AND e.t >= st.s AND e.t < st.s + {sv.WINDOW_SECONDS} GROUP BY 1, 2)
SELECT viewer, CAST(sum(least(c, {sv.LIMIT})) AS BIGINT) AS allowed, CAST(sum(greatest(0, c - {sv.LIMIT})) AS BIGINT) AS refused FROM w GROUP BY 1""")
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed and refused requests of each viewer in fixed windows from their first request."""
    return sv.run_to_end(sv.limit_requests(sv.event_stream(spark, sf_dir)), spark, "limits").groupBy("viewer").agg(F.sum("allowed").alias("allowed"), F.sum("refused").alias("refused"))


#: Paths by kind of event; the events of a month are taken as those of four minutes, so that limits are met.
PATHS = {"view": "/api/v1/keywords/k/detail", "click": "/api/v1/trends/top", "purchase": "/api/v1/search", "signup": "/api/v1/keywords/views", "error": "/api/mcp/call"}
_PATH_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{p}'" for k, p in PATHS.items()) + " ELSE '/other' END"
_RPM_SQL = "CASE " + " ".join(f"WHEN starts_with(path, '{p}') THEN {n}" for p, n in lm.LIMITS) + f" ELSE {lm.OTHERS} END"


@R.query(f"""WITH RECURSIVE p AS (SELECT 'u' || (user_id % 10) AS ip, {_PATH_SQL} AS path, epoch_us(ts) // 10000000 AS ms FROM events),
g AS (SELECT ip, array_to_string(string_split(path, '/')[1:4], '/') AS route, ms, {_RPM_SQL} AS rpm, count(*) AS c FROM p WHERE starts_with(path, '/api/') GROUP BY 1, 2, 3, 4),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY ip, route ORDER BY ms, rpm) AS n FROM g),
f AS (SELECT ip, route, n, ms AS start, 1 + least(c - 1, rpm - 1) AS count, 1 + least(c - 1, rpm - 1) AS allowed, c - 1 - least(c - 1, rpm - 1) AS refused FROM n WHERE n = 1
UNION ALL SELECT n.ip, n.route, n.n, CASE WHEN ms - start >= 60000 THEN ms ELSE start END, CASE WHEN ms - start >= 60000 THEN 1 + least(c - 1, greatest(0, rpm - 1)) ELSE f.count + least(c, greatest(0, rpm - f.count)) END,
 CASE WHEN ms - start >= 60000 THEN 1 + least(c - 1, greatest(0, rpm - 1)) ELSE least(c, greatest(0, rpm - f.count)) END, CASE WHEN ms - start >= 60000 THEN c - 1 - least(c - 1, greatest(0, rpm - 1)) ELSE c - least(c, greatest(0, rpm - f.count)) END
 FROM f JOIN n ON n.ip = f.ip AND n.route = f.route AND n.n = f.n + 1)
SELECT ip, route, CAST(sum(allowed) AS BIGINT) AS allowed, CAST(sum(refused) AS BIGINT) AS refused FROM f GROUP BY 1, 2""")
def stream_route_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed and refused requests by client and route, each path under its own limit."""
    lm.with_rocksdb(spark)
    path = F.lit("/other")
    for kind, p in PATHS.items():
        path = F.when(F.col("event_type") == kind, p).otherwise(path)
    raw = spark.readStream.schema(sv.EVENTS).parquet(f"{sf_dir}/events.parque[t]")
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 10_000_000)
    requests = raw.select(F.concat(F.lit(" u"), (F.col("user_id") % 10).cast("string"), F.lit(", proxy")).alias("forwarded"), path.alias("path"), F.timestamp_millis(ms).alias("ts"))
    found = sv.run_to_end(lm.limit_routes(requests), spark, "routes")
    return found.groupBy("ip", "route").agg(F.sum("allowed").alias("allowed"), F.sum("refused").alias("refused"))


@R.query("SELECT DISTINCT regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS link FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid'], string_split(p, '=')[1])) AS kept FROM pages)")
def stream_page_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages as they land, each once."""
    return sv.ingest_pages(spark, sf_dir)
