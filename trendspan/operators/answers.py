"""The six answers of the agent's tools as markdown: lists, details, searches, topics and the podcast, in two languages.

Each function gives one document a request. The rows that a document lists are few by the serving queries' own limits; times are shown in Korea's zone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ZONE = "Asia/Seoul"


def kst(at: Column, form: str = "yyyy-MM-dd HH:mm") -> Column:
    """A UTC time as Korea's clocks show it."""
    return F.date_format(F.from_utc_timestamp(at.cast("timestamp_ntz").cast("string"), ZONE), form)


def badge(is_new: Column, delta: Column) -> Column:
    """What stands behind a keyword: new, up, down or nothing."""
    return F.when(is_new, " 🆕").when(delta > 0, F.concat(F.lit(" (▲"), delta.cast("string"), F.lit(")"))).when(delta < 0, F.concat(F.lit(" (▼"), F.abs(delta).cast("string"), F.lit(")"))).otherwise("")


def _joined(df: DataFrame, by: list[str], line: Column, order: str = "place", between: str = "\n") -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: x["line"]), between).alias("lines"))


def _behind(text: Column) -> Column:
    """A summary behind a dash, where there is one."""
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(" — "), text)).otherwise("")


def _by_language(lang: Column, english: Column | str, other: Column | str) -> Column:
    return F.when(lang == "en", english).otherwise(other)


def realtime(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """``request, answer``. ``requests`` has ``request, lang, updated_at, next_at``; ``rows`` has ``request, rank, keyword, is_new, rank_delta, summary, url``."""
    lang = F.col("lang")
    source = F.when(F.col("url").isNotNull(), F.concat(F.lit(" ["), _by_language(lang, "Source", "출처"), F.lit("]("), "url", F.lit(")"))).otherwise("")
    line = F.concat(F.col("rank").cast("string"), F.lit(". **"), "keyword", F.lit("**"), badge(F.col("is_new"), F.col("rank_delta")), _behind(F.col("summary")), source)
    listed = _joined(rows.join(requests.select("request", "lang"), "request"), ["request"], line, "rank")
    n = F.coalesce("n", F.lit(0)).cast("string")
    head = F.concat(_by_language(lang, "## Realtime AI Trends Top ", "## 실시간 AI 트렌드 Top "), n)
    times = F.concat(_by_language(lang, "_As of: ", "_기준: "), kst(F.col("updated_at")), _by_language(lang, " KST · Next update: ", " KST · 다음 업데이트: "), kst(F.col("next_at"), "HH:mm"), F.lit(" KST_"))
    return requests.join(listed, "request", "left").select("request", F.concat_ws("\n", head, times, F.lit(""), "lines").alias("answer"))


def _listing(requests: DataFrame, listed: DataFrame, head: Column, empty: Column) -> DataFrame:
    joined = requests.join(listed, "request", "left")
    return joined.select("request", F.when(F.col("n").isNull(), F.concat(head, F.lit("\n\n"), empty)).otherwise(F.concat(head, F.lit("\n\n"), "lines")).alias("answer"))


def burning(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` has ``request, place, keyword, summary``; places count from 1."""
    lang = F.col("lang")
    line = F.concat(F.col("place").cast("string"), F.lit(". **"), "keyword", F.lit("**"), _behind(F.col("summary")))
    return _listing(requests, _joined(rows, ["request"], line), _by_language(lang, "## Burning AI Keywords", "## 타는중 AI 키워드"), _by_language(lang, "No burning keywords right now.", "지금은 타는중 키워드가 없어요."))


def search(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` has ``request, place, keyword, snapshot_at, summary``."""
    lang = F.col("lang")
    date = F.when(F.col("snapshot_at").isNotNull(), F.concat(F.lit(" ("), kst(F.col("snapshot_at"), "yyyy-MM-dd"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("- **"), "keyword", F.lit("**"), date, _behind(F.col("summary")))
    return _listing(requests, _joined(rows, ["request"], line), _by_language(lang, "## Search Results", "## 검색 결과"), _by_language(lang, "No matching trends found. Try a different keyword.", "검색 결과가 없어요. 다른 키워드로 다시 시도해보세요."))


def detail(requests: DataFrame, found: DataFrame, sources: DataFrame) -> DataFrame:
    """``found`` has ``request, keyword, summary, bullets``, ``sources`` has ``request, place, name, url, domain, type``."""
    lang = F.col("lang")
    listed = _joined(sources, ["request"], F.concat(F.lit("- ["), "name", F.lit("]("), "url", F.lit(") — "), "domain", F.lit(" ("), "type", F.lit(")")))
    tags = F.when(F.size("bullets") > 0, F.concat(F.lit("\n**"), _by_language(lang, "Hashtags", "해시태그"), F.lit("**: "), F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("#"), b)), " ")))
    links = F.when(F.col("n").isNotNull(), F.concat(F.lit("\n**"), _by_language(lang, "Sources", "출처"), F.lit("**\n"), "lines"))
    missing = _by_language(lang, "Couldn't find that keyword. Try the search_trends tool to search for it.", "키워드를 찾지 못했어요. search_trends 도구로 검색해보세요.")
    joined = requests.join(found, "request", "left").join(listed, "request", "left")
    return joined.select("request", F.when(F.col("keyword").isNull(), missing).otherwise(F.concat_ws("\n", F.concat(F.lit("## "), "keyword"), F.coalesce("summary", F.lit("")), tags, links)).alias("answer"))


def hot_topics(days: DataFrame, topics: DataFrame) -> DataFrame:
    """``days`` has ``request, at``; ``topics`` has ``request, rank, title, brief, sources`` (structs of ``name, url``). In Korean only."""
    links = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("["), s["name"], F.lit("]("), s["url"], F.lit(")"))), ", ")
    section = F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), "title", F.lit("\n"), "brief", F.when(links != "", F.concat(F.lit("\n출처: "), links)).otherwise(""))
    head = F.concat(F.lit("## 오늘의 AI 핫토픽 ("), kst(F.col("at"), "yyyy-MM-dd"), F.lit(")"))
    joined = days.join(_joined(topics, ["request"], section, "rank", "\n\n"), "request", "left")
    return joined.select("request", F.when(F.col("n").isNull(), F.concat(head, F.lit("\n\n오늘의 핫토픽이 아직 준비되지 않았어요."))).otherwise(F.concat(head, F.lit("\n\n\n\n"), "lines")).alias("answer"))


def podcast(episodes: DataFrame) -> DataFrame:
    """``episodes`` has ``request, at, title, description, duration_seconds, audio_url, note``. In Korean only."""
    seconds = F.col("duration_seconds")
    length = F.concat(F.floor(seconds / 60).cast("string"), F.lit("분 "), (seconds % 60).cast("string"), F.lit("초"))
    return episodes.select(
        "request",
        F.concat(F.lit("## 🎙 오늘의 AI 뉴스 팟캐스트 ("), kst(F.col("at"), "yyyy-MM-dd"), F.lit(")\n**"), "title", F.lit("**\n\n"), "description", F.lit("\n\n▶ [팟캐스트 듣기 ("), length, F.lit(")]("), "audio_url", F.lit(")\n\n_"), "note", F.lit("_")).alias("answer"),
    )


def recent_videos(manual: DataFrame, collected: DataFrame, kinds: list[str], limit: int) -> DataFrame:
    """``place`` and the columns of the videos shown: manual ones as listed, then collected ones, newest first; each video once, up to ``limit``.

    Both have ``position, video_id, video_url, published_at, video_type``; ``kinds`` are the types that the filter shows.
    """
    shown = lambda df, origin, order: df.where(F.col("video_type").isin(*kinds)).select(F.lit(origin).alias("origin"), order.cast("long").alias("order"), *df.columns)
    # No more than the limit of either can be shown before duplicates go, and a manual one hides no more than one of the others.
    first = shown(manual, 0, F.col("position"))
    later = shown(collected, 1, -F.unix_micros(F.col("published_at").cast("timestamp"))).orderBy("order", "video_id").limit(limit)
    keyed = first.unionByName(later).withColumn("key", F.coalesce(F.nullif("video_id", F.lit("")), "video_url")).where(F.coalesce("key", F.lit("")) != "")
    best = keyed.groupBy("key").agg(F.min_by(F.struct("origin", "order", "position", "video_id", "video_type"), F.struct("origin", "order", "position")).alias("v")).select("v.*")
    return best.orderBy("origin", "order", "position", "video_id").limit(limit).withColumn("is_manual", F.col("origin") == 0)
