"""The agent's six answers and the list of recent videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.operators import answers as an
from trendspan.operators.relational import first_per
from trendspan.plans.registry import Registry
from trendspan.sources.tables import ITEMS_SQL, items, pages, table

R = Registry()


def _s(c: F.Column) -> F.Column:
    return c.cast("string")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    at = F.timestamp_seconds(1_706_600_000 + k * 7200).cast("timestamp_ntz")
    return table(spark, sf_dir, "nation").select(k.alias("request"), F.when(k % 2 == 0, "en").otherwise("ko").alias("lang"), at.alias("updated_at"), (at + F.make_dt_interval(hours=F.lit(3))).alias("next_at"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("request"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("keyword"))
    return first_per(s, ["request"], [F.asc("id")], 5)


_NATIONS = "n AS (SELECT n_nationkey AS request, n_nationkey % 2 = 0 AS en, TIMESTAMP '2024-01-30 07:33:20' + to_seconds(n_nationkey * 7200) AS at_, n_name AS name, n_regionkey AS region FROM nation)"
_SUPPLIERS = "s AS (SELECT * FROM (SELECT s_nationkey AS request, s_suppkey AS id, s_name AS keyword, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS place FROM supplier) WHERE place <= 5)"


@R.query(f"""WITH {_NATIONS}, {_SUPPLIERS}, l AS (SELECT request, count(*) AS c, string_agg(place || '. **' || keyword || '**' || CASE WHEN id % 3 = 0 THEN ' 🆕' WHEN id % 5 > 2 THEN ' (▲' || (id % 5 - 2) || ')' WHEN id % 5 < 2 THEN ' (▼' || (2 - id % 5) || ')' ELSE '' END
 || CASE WHEN id % 2 = 0 THEN ' — about ' || id ELSE '' END || CASE WHEN id % 4 = 0 THEN CASE WHEN request % 2 = 0 THEN ' [Source]' ELSE ' [출처]' END || '(https://s/' || id || ')' ELSE '' END, chr(10) ORDER BY place) AS lines FROM s GROUP BY 1)
SELECT request, concat_ws(chr(10), CASE WHEN en THEN '## Realtime AI Trends Top ' ELSE '## 실시간 AI 트렌드 Top ' END || coalesce(c, 0), CASE WHEN en THEN '_As of: ' ELSE '_기준: ' END || strftime(at_ + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') || CASE WHEN en THEN ' KST · Next update: ' ELSE ' KST · 다음 업데이트: ' END || strftime(at_ + INTERVAL 12 HOUR, '%H:%M') || ' KST_', '', lines) AS answer FROM n LEFT JOIN l USING (request)""")
def realtime_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked lists with badges, in either language."""
    k = F.col("id")
    s = _suppliers(spark, sf_dir)
    place = F.row_number().over(_by_request())
    rows = s.select("request", place.alias("rank"), "keyword", (k % 3 == 0).alias("is_new"), (k % 5 - 2).alias("rank_delta"), F.when(k % 2 == 0, F.concat(F.lit("about "), _s(k))).alias("summary"), F.when(k % 4 == 0, F.concat(F.lit("https://s/"), _s(k))).alias("url"))
    return an.realtime(_nations(spark, sf_dir), rows)


def _by_request():
    from pyspark.sql import Window

    return Window.partitionBy("request").orderBy("id")


@R.query(f"""WITH {_NATIONS}, {_SUPPLIERS}, t AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY id) AS p FROM s WHERE id % 3 <> 1), l AS (SELECT request, string_agg(p || '. **' || keyword || '**' || CASE WHEN id % 2 = 0 THEN ' — about ' || id ELSE '' END, chr(10) ORDER BY p) AS lines FROM t GROUP BY 1)
SELECT request, CASE WHEN en THEN '## Burning AI Keywords' ELSE '## 타는중 AI 키워드' END || chr(10) || chr(10) || coalesce(lines, CASE WHEN en THEN 'No burning keywords right now.' ELSE '지금은 타는중 키워드가 없어요.' END) AS answer FROM n LEFT JOIN l USING (request)""")
def burning_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burning keywords, or that there are none."""
    k = F.col("id")
    rows = _suppliers(spark, sf_dir).where(k % 3 != 1).select("request", F.row_number().over(_by_request()).alias("place"), "keyword", F.when(k % 2 == 0, F.concat(F.lit("about "), _s(k))).alias("summary"))
    return an.burning(_nations(spark, sf_dir), rows)


@R.query(f"""WITH {_NATIONS}, {_SUPPLIERS}, l AS (SELECT request, string_agg('- **' || keyword || '**' || CASE WHEN id % 3 <> 0 THEN ' (' || strftime(TIMESTAMP '2024-01-30 07:33:20' + to_seconds(id * 7200) + INTERVAL 9 HOUR, '%Y-%m-%d') || ')' ELSE '' END || CASE WHEN id % 2 = 0 THEN ' — about ' || id ELSE '' END, chr(10) ORDER BY id) AS lines FROM s WHERE request % 6 <> 5 GROUP BY 1)
SELECT request, CASE WHEN en THEN '## Search Results' ELSE '## 검색 결과' END || chr(10) || chr(10) || coalesce(lines, CASE WHEN en THEN 'No matching trends found. Try a different keyword.' ELSE '검색 결과가 없어요. 다른 키워드로 다시 시도해보세요.' END) AS answer FROM n LEFT JOIN l USING (request)""")
def search_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results with the day of their snapshot, or that there are none."""
    k = F.col("id")
    at = F.when(k % 3 != 0, F.timestamp_seconds(1_706_600_000 + k * 7200).cast("timestamp_ntz"))
    rows = _suppliers(spark, sf_dir).where(F.col("request") % 6 != 5).select("request", k.alias("place"), "keyword", at.alias("snapshot_at"), F.when(k % 2 == 0, F.concat(F.lit("about "), _s(k))).alias("summary"))
    return an.search(_nations(spark, sf_dir), rows)


@R.query(f"""WITH {_NATIONS}, {_SUPPLIERS}, l AS (SELECT request, string_agg('- [' || keyword || '](https://s/' || id || ') — s' || (id % 3) || '.example.org (news)', chr(10) ORDER BY id) AS lines FROM s GROUP BY 1)
SELECT request, CASE WHEN request % 5 = 4 THEN CASE WHEN en THEN 'Couldn''t find that keyword. Try the search_trends tool to search for it.' ELSE '키워드를 찾지 못했어요. search_trends 도구로 검색해보세요.' END
 ELSE concat_ws(chr(10), '## ' || name, 'about ' || name, CASE WHEN region > 0 THEN chr(10) || CASE WHEN en THEN '**Hashtags**: ' ELSE '**해시태그**: ' END || array_to_string(list_transform(range(region), lambda i: '#r' || i), ' ') END, chr(10) || CASE WHEN en THEN '**Sources**' ELSE '**출처**' END || chr(10) || lines) END AS answer FROM n LEFT JOIN l USING (request)""")
def detail_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details of a keyword with tags and sources, or that it wasn't found."""
    n = _nations(spark, sf_dir)
    bullets = F.when(F.col("region") > 0, F.transform(F.sequence(F.lit(0), (F.col("region") - 1).cast("int")), lambda i: F.concat(F.lit("r"), _s(i)))).otherwise(F.array().cast("array<string>"))
    found = n.where("request % 5 <> 4").select("request", F.col("name").alias("keyword"), F.concat(F.lit("about "), "name").alias("summary"), bullets.alias("bullets"))
    k = F.col("id")
    sources = _suppliers(spark, sf_dir).select("request", k.alias("place"), F.col("keyword").alias("name"), F.concat(F.lit("https://s/"), _s(k)).alias("url"), F.concat(F.lit("s"), _s(k % 3), F.lit(".example.org")).alias("domain"), F.lit("news").alias("type"))
    return an.detail(n, found, sources)


@R.query(f"""WITH {_NATIONS}, {_SUPPLIERS}, l AS (SELECT request, string_agg('### ' || place || '. ' || keyword || chr(10) || 'brief ' || id || CASE WHEN id % 2 = 0 THEN chr(10) || '출처: [a](https://a/' || id || '), [b](https://b)' ELSE '' END, chr(10) || chr(10) ORDER BY place) AS lines FROM s WHERE request % 4 <> 3 GROUP BY 1)
SELECT request, '## 오늘의 AI 핫토픽 (' || strftime(at_ + INTERVAL 9 HOUR, '%Y-%m-%d') || ')' || chr(10) || chr(10) || CASE WHEN lines IS NULL THEN '오늘의 핫토픽이 아직 준비되지 않았어요.' ELSE chr(10) || chr(10) || lines END AS answer FROM n LEFT JOIN l USING (request)""")
def hot_topic_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's topics with their sources, or that they aren't ready."""
    k = F.col("id")
    one = F.array(F.struct(F.lit("a").alias("name"), F.concat(F.lit("https://a/"), _s(k)).alias("url")), F.struct(F.lit("b").alias("name"), F.lit("https://b").alias("url")))
    topics = _suppliers(spark, sf_dir).where("request % 4 <> 3").select("request", F.row_number().over(_by_request()).alias("rank"), F.col("keyword").alias("title"), F.concat(F.lit("brief "), _s(k)).alias("brief"), F.when(k % 2 == 0, one).otherwise(F.slice(one, 1, 0)).alias("sources"))
    return an.hot_topics(_nations(spark, sf_dir).withColumnRenamed("updated_at", "at"), topics)


@R.query(f"""WITH {ITEMS_SQL} SELECT item_idx AS request, '## 🎙 오늘의 AI 뉴스 팟캐스트 (' || strftime(published_at + INTERVAL 9 HOUR, '%Y-%m-%d') || ')' || chr(10) || '**' || title || '**' || chr(10) || chr(10) || summary || chr(10) || chr(10) || '▶ [팟캐스트 듣기 (' || (points // 60) || '분 ' || (points % 60) || '초)](https://a/' || item_idx || ')' || chr(10) || chr(10) || '_note_' AS answer FROM items""")
def podcast_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as episodes, with their length in minutes and seconds."""
    k = F.col("item_idx")
    episodes = items(spark, sf_dir).select(k.alias("request"), F.col("published_at").alias("at"), "title", F.col("summary").alias("description"), F.col("points").alias("duration_seconds"), F.concat(F.lit("https://a/"), _s(k)).alias("audio_url"), F.lit("note").alias("note"))
    return an.podcast(episodes)


@R.query("""WITH m AS (SELECT 0 AS o, page_id AS ord, page_id AS position, 'v' || (page_id % 40) AS video_id, page_id % 3 <> 1 AS shown FROM pages),
c AS (SELECT 1 AS o, -epoch_us(ts) AS ord, event_id AS position, 'v' || (event_id % 90) AS video_id, event_type <> 'click' AS shown FROM events),
l AS (SELECT * FROM m WHERE shown UNION ALL SELECT * FROM (SELECT * FROM c WHERE shown ORDER BY ord, video_id LIMIT 60)),
b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY o, ord, position) AS n FROM l)
SELECT o = 0 AS is_manual, position, video_id FROM b WHERE n = 1 ORDER BY o, ord, position LIMIT 60""")
def recent_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The videos shown: manual ones first, then the newest ones, each once, sixty at most."""
    p, e = F.col("page_id"), F.col("event_id")
    columns = lambda position, n, at, kind: (position.alias("position"), F.concat(F.lit("v"), _s(position % n)).alias("video_id"), F.lit("https://v").alias("video_url"), at.alias("published_at"), kind.alias("video_type"))
    manual = pages(spark, sf_dir).select(*columns(p, 40, F.timestamp_seconds(p).cast("timestamp_ntz"), F.when(p % 3 == 1, "shorts").when(p % 3 == 0, "unknown").otherwise("longform")))
    collected = table(spark, sf_dir, "events").select(*columns(e, 90, F.col("ts"), F.when(F.col("event_type") == "click", "shorts").otherwise("longform")))
    return an.recent_videos(manual, collected, ["longform", "unknown"], 60).select("is_manual", "position", "video_id")
