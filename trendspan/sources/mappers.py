"""Pure mappers from raw landing tables of each source to the common item schema.

Fetching is outside: a landing table holds what a source returned. Every mapper filters by the window, requires title and
link, and its output goes through first-wins dedup by link.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspan.functions import text as tx
from trendspan.functions import times as tm
from trendspan.functions import urls as ur

ITEM = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("link", T.StringType()),
        T.StructField("published_at", T.TimestampNTZType()),
        T.StructField("summary", T.StringType()),
        T.StructField("source_domain", T.StringType()),
        T.StructField("feed_title", T.StringType()),
        T.StructField("tier", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("engagement", T.StructType([T.StructField("score", T.LongType()), T.StructField("comments", T.LongType())])),
    ]
)

# Companies that the link-blog filter looks for, sites whose links a digest skips.
BIG_TECH = ["google", "deepmind", "alphabet", "microsoft", "openai", "anthropic", "apple", "meta", "facebook", "instagram", "whatsapp", "amazon", "aws", "nvidia", "tesla", "xai", "x.ai", "bytedance", "tiktok"]
SKIPPED_LINKS = ["x.com", "twitter.com", "linkedin.com", "facebook.com"]
# Words of developers and AI in short posts, in product launches, and what marks a copy of a model.
POST_HINT = r"(?i)(?<![A-Za-z0-9_])(?:ai|llm|gpt|claude|gemini|qwen|deepseek|mistral|llama|openai|anthropic|cursor|copilot|codex|agent|agents|mcp|model|models|inference|coding|devtool|sdk|api|open[- ]?source|rag|prompt)(?![A-Za-z0-9_])"
LAUNCH_HINT = r"(?i)(?<![A-Za-z0-9_])(?:ai|artificial intelligence|llm|gpt|claude|gemini|openai|anthropic|cursor|copilot|agent|agents|assistant|assistants|prompt|prompts|rag|model|models|mcp|api|apis|sdk|developer|developers|devtool|devtools|coding|code|workflow|automation|automated)(?![A-Za-z0-9_])"
MODEL_NOISE = r"(?i)(?:uncensor|abliterat|obliterat|nsfw|erotic|roleplay|gguf|awq|gptq|exl2|mlx|bnb|[48]bit|q[2-8]_)"


def as_items(df: DataFrame, **columns: Column) -> DataFrame:
    """Rows of the item schema; columns that are not given are null."""
    return df.select(*((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in ITEM.fields))


def in_window(df: DataFrame, as_of: str, hours: int) -> DataFrame:
    """Items after the window's start, with title and link."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return df.where((F.col("published_at") > start) & (F.length(F.trim("title")) > 0) & (F.length("link") > 0))


def first_by_link(df: DataFrame, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(ur.url_key(F.col("link"))).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def repair_xml(xml: Column) -> Column:
    """Bare ampersands escaped outside CDATA sections."""
    bare = r"&(?!#?\w+;)"
    parts = F.split(xml, r"(?=<!\[CDATA\[)|(?<=\]\]>)")
    return F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit("<![CDATA[")), p).otherwise(F.regexp_replace(p, bare, "&amp;"))), "")


def rss_entries(feeds: DataFrame, xml: str = "xml") -> DataFrame:
    """A row for each entry of RSS or Atom feeds held as text: title, link, date text, summary of 500 characters, domain."""
    entries = feeds.withColumn("entry", F.explode(F.regexp_extract_all(repair_xml(F.col(xml)), F.lit(r"(?s)(<(?:item|entry)[ >].*?</(?:item|entry)>)"), 1)))
    field = lambda tag: F.trim(F.regexp_replace(F.regexp_extract("entry", rf"(?s)<(?:{tag})(?:\s[^>]*)?>(.*?)</(?:{tag})>", 1), r"(?s)^<!\[CDATA\[(.*?)\]\]>$", "$1"))
    link = F.coalesce(F.nullif(field("link"), F.lit("")), F.nullif(F.regexp_extract("entry", r'<link[^>]*href="([^"]*)"', 1), F.lit("")))
    date = F.coalesce(F.nullif(field("pubDate"), F.lit("")), F.nullif(field("updated|published|dc:date"), F.lit("")))
    rows = entries.select(*(c for c in feeds.columns if c != xml), tx.strip_html(field("title")).alias("title"), link.alias("link"), date.alias("date"), F.substring(tx.strip_html(field("description|summary|content")), 1, 500).alias("summary"))
    return rows.withColumn("published_at", feed_time(F.col("date"))).withColumn("source_domain", ur.host(F.col("link")))


def feed_time(text: Column) -> Column:
    """A feed's date in any of the usual forms, as UTC."""
    rfc822 = F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},\s*", ""), r"\s+(?:GMT|UT|Z)$", " +0000")
    forms = [F.try_to_timestamp(rfc822, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(text)]
    return F.coalesce(*forms).cast("timestamp_ntz")


def story_items(hits: DataFrame, front_page: DataFrame) -> DataFrame:
    """Story search and front page: epoch seconds, points and comments; front-page rows win over the same link's."""

    def mapped(df: DataFrame, tier: str) -> DataFrame:
        return as_items(df, title=F.col("title"), link=F.col("url"), published_at=F.timestamp_seconds("created_at_i"), source_domain=ur.host(F.col("url")), feed_title=F.lit("stories"), tier=F.lit(tier), lang=F.lit("en"), engagement=F.struct(F.col("points").cast("long").alias("score"), F.col("num_comments").cast("long").alias("comments")))

    both = mapped(front_page, "P1_CONTEXT").withColumn("p", F.lit(0)).unionByName(mapped(hits, "COMMUNITY").withColumn("p", F.lit(1)))
    return first_by_link(both, [F.asc("p"), F.desc("published_at"), F.asc("title")]).drop("p")


def news_items(articles: DataFrame) -> DataFrame:
    """News search: compact UTC times, names of languages to codes."""
    lang = F.when(F.lower("language") == "korean", "ko").when(F.lower("language") == "english", "en").otherwise(F.lower(F.substring("language", 1, 2)))
    return as_items(articles, title=F.col("title"), link=F.col("url"), published_at=feed_time(F.col("seendate")), source_domain=F.col("domain"), feed_title=F.lit("news search"), tier=F.lit("P2_RAW"), lang=lang)


def repository_items(repositories: DataFrame) -> DataFrame:
    """Repository search with stars and forks as engagement; of one URL that several searches found the first stays."""
    once = repositories.groupBy("html_url").agg(F.min_by(F.struct("full_name", "description", "pushed_at", "stargazers_count", "forks_count"), F.struct("full_name", "pushed_at")).alias("r")).select("html_url", "r.*")
    return as_items(once, title=F.concat_ws(": ", "full_name", "description"), link=F.col("html_url"), published_at=F.col("pushed_at"), summary=F.substring(F.coalesce("description", F.lit("")), 1, 500), source_domain=F.lit("github.com"), feed_title=F.concat(F.lit("GitHub: "), "full_name"), tier=F.lit("P2_RAW"), lang=F.lit("en"), engagement=F.struct(F.col("stargazers_count").cast("long").alias("score"), F.col("forks_count").cast("long").alias("comments")))


def release_items(releases: DataFrame) -> DataFrame:
    """Releases of tracked repositories."""
    return as_items(releases, title=F.concat("repo", F.lit(" "), F.coalesce(F.nullif("name", F.lit("")), "tag_name")), link=F.col("html_url"), published_at=F.col("published_at"), summary=F.substring(F.coalesce("body", F.lit("")), 1, 500), source_domain=F.lit("github.com"), feed_title=F.concat(F.lit("GitHub Release: "), "repo"), tier=F.lit("P1_CONTEXT"), lang=F.lit("en"))


def markdown_links(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each link of a markdown text whose title has five letters or more and whose site isn't skipped."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), 1).alias("title"), F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), 2).alias("link"))
    rows = df.withColumn("pair", F.explode(pairs)).select(*(c for c in df.columns if c != text), F.col("pair.title").alias("title"), F.col("pair.link").alias("link"))
    return rows.where((F.length("title") >= 5) & ~ur.in_domains(ur.host(F.col("link")), SKIPPED_LINKS))


def dated_files(files: DataFrame, as_of: str, hours: int, newest: int = 3) -> DataFrame:
    """Files with a date in their name, the newest few of the window."""
    day = F.to_date(F.replace(F.regexp_extract("name", r"(\d{4}[-_]\d{2}[-_]\d{2})", 1), F.lit("_"), F.lit("-")))
    dated = files.where(F.col("name").rlike(r"\d{4}[-_]\d{2}[-_]\d{2}")).withColumn("day", day)
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(hours))
    return dated.where(F.col("day").cast("timestamp_ntz") > start).orderBy(F.desc("day"), "name").limit(newest)


def big_tech(df: DataFrame) -> DataFrame:
    return df.where(tx.contains_any(F.lower(F.concat_ws(" ", "title", "summary")), BIG_TECH))


def forum_items(posts: DataFrame) -> DataFrame:
    """Posts of communities, each under a domain of its own."""
    return as_items(posts, title=F.col("title"), link=F.col("permalink"), published_at=F.timestamp_seconds("created_utc"), summary=F.substring(F.coalesce("selftext", F.lit("")), 1, 500), source_domain=F.concat(F.lower("subreddit"), F.lit(".reddit.com")), feed_title=F.concat(F.lit("r/"), "subreddit"), tier=F.lit("COMMUNITY"), lang=F.lit("en"), engagement=F.struct(F.col("ups").cast("long").alias("score"), F.col("num_comments").cast("long").alias("comments")))


def model_list(models: DataFrame) -> DataFrame:
    """A list of models: variants behind a colon fall into one, the first stays; the free marker goes off the name."""
    base = models.where(F.col("id").rlike("^[A-Za-z0-9]")).withColumn("base", F.substring_index("id", ":", 1))
    w = Window.partitionBy("base").orderBy("created", "id")
    first = base.withColumn("n", F.row_number().over(w)).where("n = 1")
    return as_items(first, title=F.regexp_replace("name", r" \(free\)$", ""), link=F.concat(F.lit("https://models.example/"), "base"), published_at=F.timestamp_seconds("created"), summary=F.concat(F.lit("context "), F.col("context_length").cast("string")), source_domain=F.lit("models.example"), feed_title=F.lit("models"), tier=F.lit("P1_CONTEXT"), lang=F.lit("en"))


def hub_models(models: DataFrame, official: list[str], least_likes: int = 50) -> DataFrame:
    """Models of a hub: official organisations, and others with enough likes; conversions and altered copies are noise."""
    org = F.substring_index("id", "/", 1)
    is_official = org.isin(*official)
    kept = models.where(~F.col("id").rlike(MODEL_NOISE) & (is_official | (F.col("likes") >= least_likes)))
    return as_items(kept, title=F.col("id"), link=F.concat(F.lit("https://hub.example/"), "id"), published_at=F.col("created_at"), source_domain=F.lit("hub.example"), feed_title=F.lit("hub"), tier=F.when(is_official, "P1_CONTEXT").otherwise("COMMUNITY"), lang=F.lit("en"), engagement=F.struct(F.col("likes").cast("long").alias("score"), F.lit(0).cast("long").alias("comments")))


def vendor_topics(topics: DataFrame) -> DataFrame:
    """Topics of vendor forums: the vendor in front unless the title has it; replies are posts but the first."""
    title = F.when(F.contains(F.lower("title"), F.lower("vendor")), F.col("title")).otherwise(F.concat("vendor", F.lit(": "), "title"))
    return as_items(topics, title=title, link=F.col("url"), published_at=F.col("created_at"), source_domain=ur.host(F.col("url")), feed_title=F.col("vendor"), tier=F.lit("P0_CURATED"), lang=F.lit("en"), engagement=F.struct(F.col("like_count").cast("long").alias("score"), F.greatest(F.lit(0), F.col("posts_count") - 1).cast("long").alias("comments")))


def short_posts(searched: DataFrame, curated: DataFrame, least: int = 3) -> DataFrame:
    """Short posts: searched ones need interest and a developer's word, curated accounts' only the word."""
    hit = F.col("text").rlike(POST_HINT)
    both = searched.where(hit & (F.col("likes") + F.col("reposts") >= least)).unionByName(curated.where(hit))
    return as_items(both, title=F.substring(tx.collapse(F.col("text")), 1, 140), link=F.col("url"), published_at=F.col("created_at"), summary=F.substring("text", 1, 500), source_domain=ur.host(F.col("url")), feed_title=F.col("author"), tier=F.lit("COMMUNITY"), lang=F.lit("en"), engagement=F.struct(F.col("likes").cast("long").alias("score"), F.col("reposts").cast("long").alias("comments")))


def launches(posts: DataFrame, as_of: str) -> DataFrame:
    """Products featured today in Los Angeles that have a rank and an AI word, with their ranking signal."""
    today = tm.pacific_date(F.lit(as_of).cast("timestamp_ntz"))
    hit = F.concat_ws(" ", "name", "tagline", "website", F.array_join("topics", " ")).rlike(LAUNCH_HINT)
    kept = posts.where((tm.pacific_date(F.col("featured_at")) == today) & (F.col("daily_rank") > 0) & hit)
    authority = F.when(F.col("daily_rank") <= 3, 0.9).when(F.col("daily_rank") <= 10, 0.84).otherwise(0.72)
    bonus = F.when(F.col("daily_rank") <= 3, 2.0).when(F.col("daily_rank") <= 10, 1.0).otherwise(0.5)
    return kept.select("name", "tagline", "url", "daily_rank", authority.alias("authority_override"), bonus.alias("domain_bonus"))


def changelog_entries(df: DataFrame, text: str = "text", most: int = 1200) -> DataFrame:
    """Dated entries of a changelog's text: a line with a date opens one, what follows is its body."""
    keys = [c for c in df.columns if c != text]
    lines = df.select(*keys, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line"))
    day = F.regexp_extract("line", r"^\W*(\d{4}-\d{2}-\d{2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4})\W*$", 1)
    by = Window.partitionBy(*keys).orderBy("n")
    numbered = lines.withColumn("day", day).withColumn("entry", F.sum(F.when(F.col("day") != "", 1).otherwise(0)).over(by)).where("entry > 0")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("day") == "") & (F.trim("line") != ""), F.struct("n", "line")))), lambda x: x["line"]), " ")
    return numbered.groupBy(*keys, "entry").agg(F.max("day").alias("day"), F.substring(body, 1, most).alias("body"))


def newsletter_sections(df: DataFrame, text: str = "text") -> DataFrame:
    """Sections of a markdown newsletter between rules, with their fields; one without title or link is none.

    The summary has the plain explanation and the field of work behind it, where a section has them; importance is five where
    none is given.
    """
    sections = df.withColumn("section", F.explode(F.split(F.col(text), r"\n---\n")))
    group = lambda pattern: F.regexp_replace(F.regexp_extract("section", pattern, 1), r"^\s+|\s+$", "")
    block = lambda name: group(rf"(?s)\*\*{name}\*\*:\s*(.+?)(?=\*\*|$)")
    some = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(some(group(r"##\s*제목:\s*([^\n]+)")), some(group(r"##\s*([^\n]+)")))
    plain, work = some(block("쉬운설명")), some(block("관련분야"))
    summary = F.concat(F.coalesce(some(block("요약")), F.lit("")), F.coalesce(F.concat(F.lit("\n\n쉬운설명: "), plain), F.lit("")), F.coalesce(F.concat(F.lit("\n\n관련분야: "), work), F.lit("")))
    importance = F.coalesce(some(group(r"\*\*중요도\*\*:\s*(\d+)")).cast("int"), F.lit(5))
    link = some(group(r"\*\*전체링크\*\*\s*:?\s*(https?://\S+)"))
    image = some(group(r"!\[Image\]\((https?://[^\s)]+)\)"))
    out = sections.select(*(c for c in df.columns if c != text), title.alias("title"), summary.alias("summary"), importance.alias("importance"), link.alias("link"), image.alias("image"))
    return out.where("link is not null and title is not null")


def aggregate_articles(files: DataFrame, least: float = 0.5) -> DataFrame:
    """Articles of dated JSON files (``json``) that are sure enough, with their metadata behind the summary."""
    article = T.StructType([T.StructField(n, T.StringType()) for n in ("title", "url", "summary", "category", "source")] + [T.StructField("confidence", T.DoubleType())])
    parsed = F.from_json("json", T.StructType([T.StructField("articles", T.ArrayType(article))]))
    rows = files.select(*(c for c in files.columns if c != "json"), F.inline(parsed["articles"]))
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    kept = rows.where((F.coalesce("confidence", F.lit(0.0)) >= least) & some(F.col("title")) & some(F.col("url")))
    more = [F.coalesce("summary", F.lit("")), F.when(some(F.col("category")), F.concat(F.lit("\n\nCategory: "), "category")), F.when(some(F.col("source")), F.concat(F.lit("\nSource: "), "source")), F.when(F.col("confidence") != 0, F.concat(F.lit("\nConfidence: "), F.format_string("%.2f", "confidence")))]
    return kept.withColumn("summary", F.concat(*(F.coalesce(m, F.lit("")) for m in more)))


def messages_with_links(posts: DataFrame) -> DataFrame:
    """Forwarded posts: the first short link outside quoted lines replaces the link."""
    plain = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.startswith(F.ltrim(x), F.lit(">"))), "\n")
    found = F.nullif(F.regexp_extract(plain, r"(https://t\.co/[A-Za-z0-9]+)", 1), F.lit(""))
    return posts.withColumn("link", F.coalesce(found, "link"))


def videos(playlist: DataFrame, durations: DataFrame) -> DataFrame:
    """A channel's playlist with durations, the best thumbnail and the type of video."""
    joined = playlist.join(durations, "video_id", "left")
    thumb = F.coalesce("thumb_maxres", "thumb_high", "thumb_default", F.concat(F.lit("https://i.ytimg.com/vi/"), "video_id", F.lit("/hqdefault.jpg")))
    d = tm.iso_duration_seconds(F.col("duration"))
    return joined.select("video_id", "title", thumb.alias("thumbnail"), d.alias("seconds"), tm.video_type(d).alias("kind"))


def page_image(html: Column, url: Column, default: str) -> Column:
    """A page's picture: og:image, then the card's, then its icon as a whole URL, then the default."""
    found = lambda pattern: F.nullif(F.regexp_extract(html, pattern, 1), F.lit(""))
    icon = found(r'<link[^>]+rel="(?:shortcut )?icon"[^>]+href="([^"]*)"')
    return F.coalesce(found(r'<meta[^>]+property="og:image"[^>]+content="([^"]*)"'), found(r'<meta[^>]+name="twitter:image"[^>]+content="([^"]*)"'), F.when(icon.isNotNull(), ur.absolute(icon, url)), F.lit(default))


def reader_text(df: DataFrame, url: str = "url", text: str = "text", most: int = 6000, least: int = 300) -> DataFrame:
    """Full texts for summaries and why others fail: skipped sites and files, or too short."""
    skipped = F.col(url).rlike(r"(?i)\.pdf(?:$|[?#])") | ur.in_domains(ur.host(F.col(url)), ["youtube.com", "youtu.be", "x.com", "twitter.com"])
    body = F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n{3,}", "\n\n")), 1, most)
    return df.withColumn("body", body).withColumn("failure", F.when(skipped, "skipped").when(F.length("body") < least, "too_short"))


def valid_episodes(df: DataFrame) -> DataFrame:
    """Content entries that are ready, have 7 to 20 sources and secure audio."""
    return df.where((F.col("status") == "ready") & F.col("source_count").between(7, 20) & F.startswith("audio_url", F.lit("https://")))


def prioritized_union(sources: list[tuple[int, DataFrame]]) -> DataFrame:
    """Items of all sources; of one link the source that comes first in the priority order wins, then the first row."""
    out = None
    for priority, df in sources:
        df = df.withColumn("__p", F.lit(priority))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return first_by_link(out, [F.asc("__p"), F.desc_nulls_last("published_at"), F.asc("link"), F.asc("title")]).drop("__p")


def regional_results(rows: DataFrame, kind: str, most: int = 300) -> DataFrame:
    """Results of the regional search, of columns ``title, originallink, link, description, pub_date, postdate`` and others.

    Title and snippet lose bold marks and references; the date is a header date or eight digits; without link or title a
    result is left out.
    """

    def plain(c: Column) -> Column:
        t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)</?b>", "")
        for name, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'")):
            t = F.replace(t, F.lit(name), F.lit(sign))
        return tx.collapse(t)

    url = F.coalesce(F.nullif("originallink", F.lit("")), F.nullif("link", F.lit("")))
    header = F.try_to_timestamp(F.regexp_replace("pub_date", r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z")).cast("timestamp_ntz")
    digits = F.when(F.col("postdate").rlike(r"^\d{8}$"), F.try_to_timestamp("postdate", F.lit("yyyyMMdd")).cast("timestamp_ntz"))
    out = rows.withColumns({"title": plain(F.col("title")), "url": url})
    out = out.withColumns({"domain": ur.host(F.col("url")), "snippet": F.substring(plain(F.col("description")), 1, most), "published_at": F.coalesce(header, digits), "type": F.lit(kind), "provider": F.lit("regional")})
    return out.where("url is not null and title <> ''").drop("originallink", "link", "description", "pub_date", "postdate")


def web_results(rows: DataFrame) -> DataFrame:
    """Results of a web search, of columns ``title, url, text, published``: a URL is required, the rest may be blank."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    return rows.where("url is not null and url <> ''").select(blank("title").alias("title"), "url", blank("text").alias("content"), F.col("published").alias("published_at"))


# How a search's failure tells that a key's quota is spent, or that it asked too often; characters of a snippet.
QUOTA_WORDS = ["quota", "credit", "billing", "insufficient", "exceeded"]
RATE_WORDS = ["rate limit", "ratelimit", "too many requests", "throttle"]
SEARCH_SNIPPET = 120


def failure_kind(status: Column, message: Column) -> Column:
    """``quota``, ``rate_limit`` or ``other`` for a failed search, null for one that went through (neither status nor message)."""
    text = F.lower(F.coalesce(message, F.lit("")))
    kind = F.when(tx.contains_any(text, QUOTA_WORDS), "quota").when((F.coalesce(status, F.lit(0)) == 429) | tx.contains_any(text, RATE_WORDS), "rate_limit").otherwise("other")
    return F.when(status.isNotNull() | message.isNotNull(), kind)


def pooled_results(attempts: DataFrame, fallback: DataFrame, most_keys: int = 2) -> DataFrame:
    """``query, provider, title, url, domain, snippet, published_at``: what a search over a pool of keys comes to.

    ``attempts`` has ``query, place, status, message, results``: a query's attempts by key, of which the first ``most_keys`` count. Spent and throttled keys
    pass the query on; the first other attempt decides, and one that failed gives nothing. A query without results takes those of ``fallback`` (``query, results``).
    """
    # Attempts are few bytes when they are shuffled and many in a task's memory, so they are dealt out by a fixed number, not by their size; all steps by
    # query, the join with the fall-back included, then run on these parts.
    dealt = attempts.repartition(4 * attempts.sparkSession.sparkContext.defaultParallelism, "query")
    judged = dealt.withColumn("kind", failure_kind(F.col("status"), F.col("message")))
    ranked = judged.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy("place"))).where(F.col("__n") <= most_keys)
    passed_on = F.coalesce(F.col("kind").isin("quota", "rate_limit"), F.lit(False))
    decided = ranked.groupBy("query").agg(F.min_by(F.struct("kind", "results"), F.when(~passed_on, F.col("__n"))).alias("a"))
    answered = F.coalesce(F.col("a").isNotNull() & F.col("a.kind").isNull() & (F.size("a.results") > 0), F.lit(False))
    own = decided.where(answered).select("query", F.lit("first").alias("provider"), F.col("a.results").alias("results"))
    other = decided.where(~answered).select("query").join(fallback.hint("merge"), "query").select("query", F.lit("fallback").alias("provider"), "results")
    rows = own.unionByName(other).select("query", "provider", F.inline("results"))
    return rows.select("query", "provider", "title", "url", ur.host(F.col("url")).alias("domain"), F.substring(F.coalesce("content", F.lit("")), 1, SEARCH_SNIPPET).alias("snippet"), "published_at")


def configured_feeds(feeds: DataFrame) -> DataFrame:
    """Alert feeds ``position, url, title, tier, lang`` fit for use: with a URL, each URL once, blanks filled in."""
    rows = feeds.withColumn("url", F.trim("url")).where("url rlike '^https?://'")
    first = rows.groupBy("url").agg(F.min_by(F.struct("position", "title", "tier", "lang"), "position").alias("f")).select("url", "f.*")
    title = F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Alert "), F.col("position").cast("string")))
    tier = F.when(F.col("tier").isin("P0_CURATED", "P1_CONTEXT", "P2_RAW", "COMMUNITY"), F.col("tier")).otherwise("P1_CONTEXT")
    return first.select("position", "url", title.alias("title"), tier.alias("tier"), F.when(F.col("lang") == "ko", "ko").otherwise("en").alias("lang"))


def channel_items(entries: DataFrame, channels: DataFrame) -> DataFrame:
    """Entries of channel feeds as items, each link once; a channel named in Hangul is Korean."""
    rows = entries.join(F.broadcast(channels.select("channel_id", "name")), "channel_id")
    lang = F.when(F.col("name").rlike(tx.HANGUL), "ko").otherwise("en")
    once = rows.groupBy("link").agg(F.min_by(F.struct("title", "published_at", "summary", "name"), F.struct("published_at", "title")).alias("r")).select("link", "r.*")
    return as_items(once, title=F.trim("title"), link=F.col("link"), published_at=F.col("published_at"), summary=F.substring(F.coalesce("summary", F.lit("")), 1, 500), source_domain=ur.host(F.col("link")), feed_title=F.col("name"), tier=F.lit("P1_CONTEXT"), lang=lang)
