"""Queries of the source mappers over landing tables, and the daily selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.functions import elements as el
from trendspan.operators import ranking as rk
from trendspan.operators.relational import first_per
from trendspan.plans import ranking as rp
from trendspan.plans.registry import Registry
from trendspan.sources import mappers as mp
from trendspan.sources.tables import pages, table

R = Registry()


def _s(c: Column) -> Column:
    return c.cast("string")


@R.query("""WITH f AS (SELECT 0 AS p, page_id AS id, 'https://s.example.org/' || (page_id % 50) AS link, page_id * 60 AS t, page_id % 9 AS points FROM pages UNION ALL SELECT 1, page_id, 'https://s.example.org/' || (page_id % 80) || '/#c', page_id * 60, page_id % 9 FROM pages)
SELECT link, tier, score FROM (SELECT link, CASE WHEN p = 0 THEN 'P1_CONTEXT' ELSE 'COMMUNITY' END AS tier, points AS score, row_number() OVER (PARTITION BY regexp_replace(regexp_replace(link, '#.*$', ''), '/+$', '') ORDER BY p, t DESC, 'Story ' || id) AS n FROM f) WHERE n = 1""")
def story_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of a search and of the front page; the front page's row of a link wins."""
    k = F.col("page_id")
    rows = lambda link: pages(spark, sf_dir).select(F.concat(F.lit("Story "), _s(k)).alias("title"), link.alias("url"), (k * 60).alias("created_at_i"), (k % 9).alias("points"), (k % 4).alias("num_comments"))
    base = F.lit("https://s.example.org/")
    found = mp.story_items(rows(F.concat(base, _s(k % 80), F.lit("/#c"))), rows(F.concat(base, _s(k % 50))))
    return found.select("link", "tier", F.col("engagement.score").alias("score"))


@R.query("""SELECT doc_id, CASE WHEN lang = 'en' THEN 'en' WHEN lang = 'fr' THEN 'ko' ELSE 'ge' END AS lang, TIMESTAMP '2024-01-02 03:04:05' + to_days(CAST(doc_id % 20 AS INTEGER)) AS published_at FROM documents""")
def news_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News by a search: languages as codes, compact times."""
    name = F.when(F.col("lang") == "en", "English").when(F.col("lang") == "fr", "Korean").otherwise("German")
    day = F.date_format(F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("doc_id") % 20).cast("int")), "yyyyMMdd")
    rows = table(spark, sf_dir, "documents").select(_s(F.col("doc_id")).alias("url"), F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("domain"), name.alias("language"), F.concat(day, F.lit("T030405Z")).alias("seendate"))
    return mp.news_items(rows).select(F.col("link").cast("long").alias("doc_id"), "lang", "published_at")


@R.query("""SELECT 'https://github.com/own/r' || (p_partkey % 700) AS link, min('own/r' || (p_partkey % 700) || ': ' || 'about') AS title, CAST(arg_min(p_size, p_partkey) AS BIGINT) AS stars FROM part GROUP BY 1""")
def repository_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories of several searches, each URL once, with their stars."""
    k, name = F.col("p_partkey"), F.concat(F.lit("own/r"), _s(F.col("p_partkey") % 700))
    rows = table(spark, sf_dir, "part").select(name.alias("full_name"), F.lit("about").alias("description"), F.concat(F.lit("https://github.com/"), name).alias("html_url"), F.timestamp_seconds(k).cast("timestamp_ntz").alias("pushed_at"), F.col("p_size").alias("stargazers_count"), F.lit(1).alias("forks_count"))
    return mp.repository_items(rows).select("link", "title", F.col("engagement.score").alias("stars"))


@R.query("SELECT p_partkey AS id, 'own/r ' || CASE WHEN p_partkey % 3 = 0 THEN 'v' || p_partkey ELSE p_name END AS title, 'P1_CONTEXT' AS tier FROM part")
def release_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of tracked repositories; without a name the tag stands for it."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lit("own/r").alias("repo"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.concat(F.lit("v"), _s(k)).alias("tag_name"), _s(k).alias("html_url"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("p_name").alias("body"))
    return mp.release_items(rows).select(F.col("link").cast("long").alias("id"), "title", "tier")


@R.query(f"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '{'|'.join(t.replace('.', '[.]') for t in mp.BIG_TECH)}')")
def tech_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links about large companies, by their names anywhere in title or text."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("summary"))
    return mp.big_tech(rows).select("doc_id")


@R.query("SELECT conv_id, turn, 'conv' || (conv_id % 5) || '.reddit.com' AS source_domain, 'r/Conv' || (conv_id % 5) AS feed_title, substr(coalesce(text, ''), 1, 500) AS summary, CAST(turn AS BIGINT) AS score FROM conversations")
def forum_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of communities under a domain of their own; a feed's summary has 500 characters at most."""
    k = F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws("/", _s(k), _s(F.col("turn"))).alias("permalink"), F.lit("t").alias("title"), k.alias("created_utc"), F.col("text").alias("selftext"), F.concat(F.lit("Conv"), _s(k % 5)).alias("subreddit"), F.col("turn").alias("ups"), F.lit(0).alias("num_comments"))
    at = lambda i: F.split_part("link", F.lit("/"), F.lit(i)).cast("long")
    return mp.forum_items(rows).select(at(1).alias("conv_id"), at(2).cast("int").alias("turn"), "source_domain", "feed_title", "summary", F.col("engagement.score").alias("score"))


@R.query("""WITH m AS (SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN 'official/' WHEN 1 THEN 'someone/' ELSE 'other/' END || replace(p_name, ' ', '-') || CASE p_partkey % 5 WHEN 0 THEN '-GGUF' WHEN 1 THEN '-4bit' ELSE '' END AS model, p_partkey % 120 AS likes FROM part)
SELECT model AS title, CASE WHEN starts_with(model, 'official/') THEN 'P1_CONTEXT' ELSE 'COMMUNITY' END AS tier, CAST(likes AS BIGINT) AS score FROM m WHERE NOT contains(model, '-GGUF') AND NOT contains(model, '-4bit') AND (starts_with(model, 'official/') OR likes >= 50)""")
def hub_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of a hub without altered copies; of others than official ones only those that are liked."""
    k, z = F.col("p_partkey"), F.col("p_size")
    name = F.concat(F.when(z % 4 == 0, "official/").when(z % 4 == 1, "someone/").otherwise("other/"), F.replace("p_name", F.lit(" "), F.lit("-")), F.when(k % 5 == 0, "-GGUF").when(k % 5 == 1, "-4bit").otherwise(""))
    rows = table(spark, sf_dir, "part").select(name.alias("id"), (k % 120).alias("likes"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    return mp.hub_models(rows, ["official"]).select("title", "tier", F.col("engagement.score").alias("score"))


@R.query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'About VENDOR ' || c_name ELSE 'Vendor: ' || c_name END AS title, CAST(greatest(0, c_custkey % 6 - 1) AS BIGINT) AS comments FROM customer")
def vendor_forum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics of a vendor's forum, with the vendor's name and the number of replies."""
    k = F.col("c_custkey")
    title = F.when(k % 2 == 0, F.concat(F.lit("About VENDOR "), "c_name")).otherwise(F.col("c_name"))
    rows = table(spark, sf_dir, "customer").select(F.lit("Vendor").alias("vendor"), title.alias("title"), _s(k).alias("url"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(1).alias("like_count"), (k % 6).alias("posts_count"))
    return mp.vendor_topics(rows).select(F.col("link").cast("long").alias("id"), "title", F.col("engagement.comments").alias("comments"))


_HINT = mp.POST_HINT.replace("(?<![A-Za-z0-9_])", "\\b").replace("(?![A-Za-z0-9_])", "\\b")


@R.query(f"""WITH p AS (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' an LLM agent' ELSE '' END AS text, conv_id % 5 AS likes FROM conversations)
SELECT conv_id, turn, 'searched' AS feed FROM p WHERE likes + 1 >= 3 AND regexp_matches(text, '{_HINT}') UNION ALL SELECT conv_id, turn, 'curated' FROM p WHERE conv_id % 7 = 0 AND regexp_matches(text, '{_HINT}')""")
def short_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short posts with a developer's word; searched ones need some interest, curated accounts' don't."""
    k = F.col("conv_id")
    text = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 2 == 0, " an LLM agent").otherwise(""))
    rows = lambda feed: table(spark, sf_dir, "conversations").select(text.alias("text"), (k % 5).alias("likes"), F.lit(1).alias("reposts"), F.concat_ws("/", _s(k), _s(F.col("turn"))).alias("url"), F.lit(None).cast("timestamp_ntz").alias("created_at"), F.lit(feed).alias("author"))
    found = mp.short_posts(rows("searched"), rows("curated").where(F.split_part("url", F.lit("/"), F.lit(1)).cast("long") % 7 == 0))
    at = lambda i: F.split_part("link", F.lit("/"), F.lit(i)).cast("long")
    return found.select(at(1).alias("conv_id"), at(2).cast("int").alias("turn"), F.col("feed_title").alias("feed"))


@R.query("""WITH v AS (SELECT user_id AS video, max(event_id) AS id FROM events GROUP BY 1), d AS (SELECT video, CASE WHEN video % 3 = 0 THEN NULL ELSE (video % 9) * 60 + id % 60 END AS s FROM v)
SELECT CAST(video AS VARCHAR) AS video_id, CASE WHEN video % 4 = 0 THEN 'max.jpg' ELSE 'https://i.ytimg.com/vi/' || video || '/hqdefault.jpg' END AS thumbnail, CAST(s AS INTEGER) AS seconds, CASE WHEN s IS NULL THEN 'unknown' WHEN s <= 180 THEN 'shorts' ELSE 'longform' END AS kind FROM d""")
def playlist_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's playlist with durations where there are any, the best picture and the type of video."""
    v = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.max("event_id").alias("id"))
    k = F.col("video")
    none = F.lit(None).cast("string")
    playlist = v.select(_s(k).alias("video_id"), F.lit("t").alias("title"), F.when(k % 4 == 0, "max.jpg").alias("thumb_maxres"), none.alias("thumb_high"), none.alias("thumb_default"))
    durations = v.where("video % 3 <> 0").select(_s(k).alias("video_id"), F.concat(F.lit("PT"), _s(k % 9), F.lit("M"), _s(F.col("id") % 60), F.lit("S")).alias("duration"))
    return mp.videos(playlist, durations).select("video_id", "thumbnail", "seconds", "kind")


@R.query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 0 THEN 'https://t.co/a' || turn ELSE 'https://m.example.org/' || turn END AS link FROM conversations")
def forwarded_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forwarded posts under the short link in them; links in quoted lines don't count."""
    k, t = F.col("conv_id"), _s(F.col("turn"))
    text = F.concat(F.lit("> https://t.co/quoted\nsee "), F.when(k % 3 == 0, F.concat(F.lit("https://t.co/a"), t)).otherwise("this"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"), F.concat(F.lit("https://m.example.org/"), t).alias("link"))
    return mp.messages_with_links(rows).select("conv_id", "turn", "link")


@R.query("""SELECT doc_id, 'Title ' || doc_id AS title, 'sum' || chr(10) || chr(10) || 'Category: ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Source: s' ELSE '' END || chr(10) || 'Confidence: 0.' || (doc_id % 100 // 10) || '0' AS summary FROM documents WHERE doc_id % 100 // 10 >= 5""")
def json_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of JSON files that are sure enough, with their metadata behind the summary."""
    k, tenth = F.col("doc_id"), F.floor(F.col("doc_id") % 100 / 10)
    one = F.struct(F.concat(F.lit("Title "), _s(k)).alias("title"), F.lit("https://a").alias("url"), F.lit("sum").alias("summary"), F.col("source").alias("category"), F.when(k % 2 == 0, "s").otherwise("").alias("source"), (tenth / 10).alias("confidence"))
    bad = F.struct(F.lit("").alias("title"), F.lit("https://a").alias("url"), F.lit("").alias("summary"), F.lit("").alias("category"), F.lit("").alias("source"), F.lit(0.9).alias("confidence"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.array(one, bad).alias("articles"))).alias("json"))
    return mp.aggregate_articles(files).select("doc_id", "title", "summary")


@R.query(r"""SELECT page_id, regexp_replace(array_to_string(list_transform(regexp_extract_all(html, '(?s)<(?:h1|h2|p|code)(?:\s[^>]*)?>([^<].*?)</(?:h1|h2|p|code)>', 1), lambda x: replace(replace(replace(replace(replace(replace(regexp_replace(x, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&amp;', '&')), chr(10)), '^\s+|\s+$', '', 'g') AS text FROM pages""")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain text of pages for readers: headings, paragraphs and code that begin with text, over their tree of elements."""
    return pages(spark, sf_dir).select("page_id", el.page_text(F.col("html")).alias("text"))


@R.query("SELECT min(c_custkey) AS position, 'https://alerts.example.org/' || (c_custkey % 200) AS url, CASE WHEN min(c_custkey) % 2 = 0 THEN 'Alert ' || min(c_custkey) ELSE arg_min(c_name, c_custkey) END AS title, 'P1_CONTEXT' AS tier FROM customer WHERE c_custkey % 200 <> 7 GROUP BY 2")
def alert_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configured alert feeds: each URL once, blanks filled in, entries without a URL left out."""
    k = F.col("c_custkey")
    url = F.when(k % 200 == 7, "").otherwise(F.concat(F.lit(" https://alerts.example.org/"), _s(k % 200)))
    rows = table(spark, sf_dir, "customer").select(k.alias("position"), url.alias("url"), F.when(k % 2 == 0, " ").otherwise(F.col("c_name")).alias("title"), F.lit("bad").alias("tier"), F.lit("en").alias("lang"))
    return mp.configured_feeds(rows).select("position", "url", "title", "tier")


@R.query("""WITH e AS (SELECT page_id, 'https://v.example.org/' || (page_id % 90) AS link, page_id % 6 AS channel FROM pages WHERE page_id % 6 <> 5)
SELECT link, 'V ' || min(page_id) AS title, CASE WHEN arg_min(channel, page_id) % 2 = 0 THEN 'ko' ELSE 'en' END AS lang FROM e GROUP BY 1""")
def channel_feeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos of followed channels, each link once; channels with a Korean name are Korean."""
    k = F.col("page_id")
    entries = pages(spark, sf_dir).select((k % 6).alias("channel_id"), F.concat(F.lit("https://v.example.org/"), _s(k % 90)).alias("link"), F.concat(F.lit("V "), _s(k)).alias("title"), F.timestamp_seconds(k).cast("timestamp_ntz").alias("published_at"), F.lit("s").alias("summary"))
    channels = spark.range(5).select(F.col("id").alias("channel_id"), F.when(F.col("id") % 2 == 0, "채널").otherwise("Channel").alias("name"))
    return mp.channel_items(entries, channels).select("link", "title", "lang")


@R.query("SELECT 'https://w/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN '' ELSE 'T' END AS title, html AS content FROM pages WHERE page_id % 4 <> 3")
def web_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a web search; those without a URL are left out, blanks stand for what is missing."""
    k = F.col("page_id")
    rows = pages(spark, sf_dir).select(F.when(k % 2 == 1, "T").alias("title"), F.when(k % 4 == 3, "").otherwise(F.concat(F.lit("https://w/"), _s(k))).alias("url"), F.col("html").alias("text"), F.lit(None).cast("string").alias("published"))
    return mp.web_results(rows).select("url", "title", "content")


_ARTICLES = rp.R.oracles["article_scores"]
_SAMPLED = rp.R.oracles["stratified_sample"]


@R.query(f"""WITH smp AS ({_SAMPLED}), art AS ({_ARTICLES}), e AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1),
a AS (SELECT smp.item_idx AS doc_id, smp.tier, art.score, list_extract({rp.TOPICS!r}, CAST(smp.item_idx % 8 AS INTEGER) + 1) AS topic, 'https://' || (smp.item_idx % 90) AS url FROM smp JOIN art ON art.doc_id = smp.item_idx WHERE art.drop_reason IS NULL),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE tier WHEN 'P0_CURATED' THEN 0 WHEN 'P1_CONTEXT' THEN 1 WHEN 'P2_RAW' THEN 2 ELSE 3 END, score DESC, doc_id) AS d FROM a) WHERE d = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY score DESC, doc_id) AS n, {rp._case("topic", rp.LEAST, "0")} AS low, {rp._case("topic", rp.MOST, "NULL")} AS high FROM u), k AS (SELECT * FROM p WHERE high IS NULL OR n <= greatest(high, low)),
q AS (SELECT *, n <= low AS first FROM k), z AS (SELECT *, row_number() OVER (PARTITION BY first ORDER BY score DESC, doc_id) AS r, (SELECT count(*) FROM q WHERE first) AS taken FROM q)
SELECT z.doc_id, z.topic, z.score, e.quality FROM z LEFT JOIN e USING (doc_id) WHERE first OR r <= 12 - taken""")
def daily_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's twelve articles: a sample by tier, scores, what is dropped, one of each URL, then topics by their quotas."""
    sample = rp.stratified_sample(spark, sf_dir).withColumnRenamed("item_idx", "doc_id")
    scored = rp.article_scores(spark, sf_dir).where("drop_reason is null").join(F.broadcast(sample), "doc_id")
    k = F.col("doc_id")
    rows = scored.select("doc_id", "tier", "score", F.element_at(F.array(*map(F.lit, rp.TOPICS)), (k % 8).cast("int") + 1).alias("topic"), F.concat(F.lit("https://"), _s(k % 90)).alias("url"))
    order = F.when(F.col("tier") == "P0_CURATED", 0).when(F.col("tier") == "P1_CONTEXT", 1).when(F.col("tier") == "P2_RAW", 2).otherwise(3)
    once = first_per(rows, ["url"], [order.asc(), F.desc("score"), F.asc("doc_id")])
    chosen = rk.diversity_quotas(once, "topic", [F.desc("score"), F.asc("doc_id")], rp.LEAST, rp.MOST, 12)
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return chosen.join(quality, "doc_id", "left").select("doc_id", "topic", "score", "quality")
