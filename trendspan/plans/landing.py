"""Queries over landed feed files of all types, in a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.plans.registry import Registry
from trendspan.sources import landing as ld
from trendspan.sources.tables import AS_OF_ITEMS, ITEMS_SQL, items
from trendspan.streaming import views as sv

R = Registry()

#: Types in turn, by files of forty documents each; two files make a feed.
TYPES = ["rss", "atom", "rsshub", "curated_rss", "github_md_folder", "github_json", "link", "unknown"]
FOCUS, NO_FOCUS, THRESHOLD = ["license", "que", "tion"], ["idiot", "der"], 2


def land(spark: SparkSession, sf_dir: str) -> str:
    """Write the documents as feed files, one for forty ids, and say where."""
    k = F.col("item_idx")
    rows = items(spark, sf_dir).select(
        k,
        F.floor(k / 40).alias("file"),
        F.concat(F.lit("Item "), k.cast("string"), F.lit(" "), F.substring(F.regexp_replace("title", "[^A-Za-z0-9 .]", " "), 1, 80)).alias("t"),
        F.concat(F.lit("https://www."), F.col("domain"), F.lit(".example.org/a?b=1&c="), k.cast("string")).alias("l"),
        F.when(k % 11 != 0, F.col("published_at")).alias("d"),
    ).withColumn("type", F.element_at(F.array(*map(F.lit, TYPES)), (F.col("file") % len(TYPES)).cast("int") + 1))
    t, l, d = F.col("t"), F.col("l"), F.col("d")  # noqa: E741
    date = lambda tag, form, zone: F.coalesce(F.concat(F.lit(f"<{tag}>"), F.date_format(d, form), F.lit(f"{zone}</{tag}>")), F.lit(""))
    rss = F.concat(F.lit("<item><title><![CDATA["), t, F.lit(" & <b>more</b>]]></title><link>"), l, F.lit("</link>"), date("pubDate", "EEE, dd MMM yyyy HH:mm:ss", " GMT"), F.lit("<description>about "), t, F.lit("</description></item>"))
    atom = F.concat(F.lit('<entry><title type="html">'), t, F.lit('</title><link rel="self" href="https://x"/><link href="'), l, F.lit('"/>'), date("updated", "yyyy-MM-dd'T'HH:mm:ss", "Z"), F.lit("<summary>about "), t, F.lit("</summary></entry>"))
    section = F.concat(F.lit("## 제목: "), t, F.lit("\n**요약**: about "), t, F.lit("\n**전체링크**: "), l)
    article = F.to_json(F.struct(t.alias("title"), l.alias("url"), F.concat(F.lit("about "), t).alias("summary"), (k % 10 / 10).alias("confidence")))
    link = F.concat(F.lit("- ["), t, F.lit("]("), l, F.lit(")"))
    one = F.when(F.col("type") == "atom", atom).when(F.col("type") == "github_md_folder", section).when(F.col("type") == "github_json", article).when(F.col("type") == "link", link).otherwise(rss)
    joined = F.transform(F.array_sort(F.collect_list(F.struct("item_idx", one.alias("x")))), lambda r: r.x)
    every = rows.groupBy("type", "file").agg(joined.alias("xs"))
    wrapped = lambda before, after: F.concat(F.lit(before), F.array_join("xs", ""), F.lit(after))
    kind = F.col("type")
    body = F.when(kind == "atom", wrapped("<feed><title>f</title>", "</feed>")).when(kind == "github_md_folder", F.array_join("xs", "\n---\n")).when(kind == "github_json", F.concat(F.lit('{"articles":['), F.array_join("xs", ","), F.lit("]}"))).when(kind == "link", F.array_join("xs", "\n")).otherwise(wrapped("<rss><channel><title>f</title>", "</channel></rss>"))
    path = sv.shared_path(spark, "landed")
    feed, stamp = F.concat(F.lit("feed "), F.floor(F.col("file") / (2 * len(TYPES))).cast("string")), F.format_string("%012d", F.col("file"))
    # A row is a file: those of one type, feed and stamp.
    every.select(body.alias("value"), "type", feed.alias("feed"), stamp.alias("stamp")).write.partitionBy("type", "feed", "stamp").option("lineSep", "\n").text(path)
    return path


_LANDED = f"""WITH {ITEMS_SQL}, r AS (SELECT item_idx, item_idx // 40 AS file, item_idx % 40 AS at_, ['rss', 'atom', 'rsshub', 'curated_rss', 'github_md_folder', 'github_json', 'link', 'unknown'][(item_idx // 40) % 8 + 1] AS type,
 'Item ' || item_idx || ' ' || substr(regexp_replace(title, '[^A-Za-z0-9 .]', ' ', 'g'), 1, 80) AS t, 'https://www.' || domain || '.example.org/a?b=1&c=' || item_idx AS link, CASE WHEN item_idx % 11 <> 0 THEN published_at END AS d, domain FROM items),
x AS (SELECT type, 'feed ' || (file // 16) AS feed, file, item_idx, trim(t || CASE WHEN type IN ('rss', 'rsshub', 'curated_rss') THEN ' & more' ELSE '' END) AS title, link, CASE WHEN type IN ('rss', 'atom', 'rsshub', 'curated_rss') THEN d END AS published_at,
 domain || '.example.org' AS source_domain, CASE WHEN type IN ('curated_rss', 'github_md_folder') THEN 'curated' ELSE 'raw' END AS origin FROM r WHERE type <> 'unknown' AND (type <> 'github_json' OR item_idx % 10 >= 5))"""


@R.query(f"{_LANDED} SELECT type, feed, regexp_replace(title, '\\s+', ' ', 'g') AS title, link, published_at, source_domain, origin FROM x")
def feed_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of one landing folder with files of all types."""
    found = ld.dispatched(ld.landed(spark, land(spark, sf_dir)))
    return found.select("type", "feed", F.regexp_replace("title", r"\s+", " ").alias("title"), "link", "published_at", "source_domain", "origin")


@R.query(f"{_LANDED} SELECT type, feed, regexp_replace(title, '\\s+', ' ', 'g') AS title, link, published_at, source_domain, origin FROM x")
def stream_feed_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream that takes what has landed and ends."""
    found = sv.run_to_end(ld.dispatched(ld.landed(spark, land(spark, sf_dir), stream=True)), spark, "landed")
    return found.select("type", "feed", F.regexp_replace("title", r"\s+", " ").alias("title"), "link", "published_at", "source_domain", "origin")


def _focus_sql(words: list[str]) -> str:
    return " + ".join(f"CASE WHEN contains(lower(title), '{w}') THEN 1 ELSE 0 END" for w in words)


@R.query(f"""{_LANDED}, recent AS (SELECT *, row_number() OVER (PARTITION BY type, feed ORDER BY file, item_idx) AS n FROM x WHERE type NOT IN ('rss', 'atom', 'rsshub', 'curated_rss') OR published_at IS NULL OR published_at >= TIMESTAMP '{AS_OF_ITEMS}' - INTERVAL 36 HOUR),
s AS (SELECT *, 2 * ({_focus_sql(FOCUS)}) - 2 * ({_focus_sql(NO_FOCUS)}) AS score FROM recent WHERE n <= 6 OR type NOT IN ('rss', 'atom', 'rsshub', 'curated_rss')),
p AS (SELECT *, row_number() OVER (PARTITION BY type, feed ORDER BY score DESC, coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '') DESC, title DESC, file, item_idx) AS place FROM s)
SELECT type, feed, link, CAST(score AS INTEGER) AS score, CAST(place AS INTEGER) AS place FROM p WHERE place = 1 OR (place <= 3 AND score >= {THRESHOLD})""")
def feed_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feed's best recent item, and others that are in focus."""
    found = ld.dispatched(ld.landed(spark, land(spark, sf_dir)))
    score = kw.focus_score(F.lower("title"), FOCUS, NO_FOCUS).cast("int")
    return ld.selected(found, AS_OF_ITEMS, score, THRESHOLD).select("type", "feed", "link", "score", "place")
