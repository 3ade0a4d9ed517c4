"""Queries over keyword text, article text, URLs, times and JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.functions import text as tx
from trendspan.functions import times as tm
from trendspan.functions import urls as ur
from trendspan.plans.registry import Registry
from trendspan.sources.tables import NAMES_SQL, names, pages, spread, table

R = Registry()

#: Names with version and event suffixes in turn, so that every branch of the policies occurs.
SUFFIXES = ["", " 2.0", " 1.2.3", " 3.5 mini", " b1234", " outage", " plugin support", " sdk 2.1 release", " Release 4 react", "GptPro5 beta"]


def suffixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spread(names(spark, sf_dir))
    return n.select("keyword_id", F.concat("keyword", F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("keyword_id") % len(SUFFIXES)).cast("int") + 1)).alias("keyword"), "family", "size", "price")


SUFFIXED = f"WITH {NAMES_SQL}, s AS (SELECT keyword_id, keyword || list_extract({SUFFIXES!r}, CAST(keyword_id % {len(SUFFIXES)} AS INTEGER) + 1) AS keyword, family, size, price FROM names)"
SIGNS_SQL = "'[“”\"''`~!@#$%^&*()+=\\[\\]{}|\\\\:;<>?,]'"


def surface_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '([a-z])(\\d+(?:\\.\\d+)?)\\b', '\\1 \\2', 'g'), '[_\\-·/]+', ' ', 'g'), {SIGNS_SQL}, ' ', 'g'), '\\s+', ' ', 'g'))"


CAMEL = "regexp_replace(trim(keyword), '([a-z])([A-Z])', '\\1 \\2', 'g')"


@R.query(f"{SUFFIXED} SELECT keyword_id, {surface_sql('keyword')} AS policy, {surface_sql(CAMEL)} AS surface, regexp_replace({surface_sql(CAMEL)}, '[. ]+', '', 'g') AS compact FROM s")
def keyword_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The normal forms that keywords are compared by."""
    k = F.col("keyword")
    return suffixed(spark, sf_dir).select("keyword_id", tx.policy_surface(k).alias("policy"), tx.keyword_surface(k).alias("surface"), tx.compact(k).alias("compact"))


@R.query(f"""{SUFFIXED} SELECT keyword_id, CASE WHEN regexp_matches(lower(keyword), '\\bb\\d{{3,}}\\b|\\bbuild[\\s-]*\\d{{3,}}\\b') THEN 'build' WHEN v = '' THEN 'none'
 WHEN len(string_split(v, '.')) >= 3 THEN 'patch' WHEN len(string_split(v, '.')) = 2 AND string_split(v, '.')[2] <> '0' THEN 'minor' ELSE 'major' END AS version_kind
FROM (SELECT *, regexp_extract({surface_sql("keyword")}, '\\b\\d+(?:\\.\\d+){{0,2}}\\b') AS v FROM s)""")
def version_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of version in each keyword."""
    return suffixed(spark, sf_dir).select("keyword_id", tx.version_kind(F.col("keyword")).alias("version_kind"))


def hints_sql(x: str, hints: list[str]) -> str:
    return f"len(list_filter({hints!r}, lambda h: contains({x}, h))) > 0"


KIND_SQL = f"""k AS (SELECT *, {surface_sql("keyword")} AS p, CASE WHEN regexp_matches(lower(keyword), '\\bb\\d{{3,}}\\b') THEN 'build' WHEN v = '' THEN 'none'
 WHEN len(string_split(v, '.')) >= 3 THEN 'patch' WHEN len(string_split(v, '.')) = 2 AND string_split(v, '.')[2] <> '0' THEN 'minor' ELSE 'major' END AS version_kind
 FROM (SELECT *, regexp_extract({surface_sql("keyword")}, '\\b\\d+(?:\\.\\d+){{0,2}}\\b') AS v FROM s)),
m AS (SELECT *, CASE WHEN {hints_sql("p", tx.INCIDENT_HINTS)} THEN 'incident' WHEN {hints_sql("p", tx.FEATURE_HINTS)} THEN 'feature_event' WHEN version_kind = 'none' THEN 'named_topic'
 WHEN len(list_filter(string_split(p, ' '), lambda t: NOT regexp_matches(t, '^(?:b|build)\\d{{3,}}$|^\\d+(?:\\.\\d+){{0,2}}$') AND NOT list_contains({tx.MINOR_VARIANT_WORDS!r}, t) AND NOT list_contains({tx.FRAMEWORK_SUFFIXES!r}, t))) <= 3 THEN 'version_only'
 ELSE 'version_release' END AS keyword_kind FROM k)"""


@R.query(f"{SUFFIXED}, {KIND_SQL} SELECT keyword_id, version_kind, keyword_kind FROM m")
def keyword_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incident, feature, named topic or version."""
    s = suffixed(spark, sf_dir).withColumn("version_kind", tx.version_kind(F.col("keyword")))
    return s.select("keyword_id", "version_kind", tx.keyword_kind(F.col("keyword"), F.col("version_kind")).alias("keyword_kind"))


_TRIM = "|".join(dict.fromkeys(tx.FAMILY_TRAILING_NOISE))


@R.query(f"""{SUFFIXED}, p AS (SELECT keyword_id, {surface_sql("keyword")} AS p FROM s),
t AS (SELECT keyword_id, string_split(regexp_replace(p, '^(\\S+ \\S+.*?)(?: (?:{_TRIM}|(?:b|build)\\d{{3,}}|\\d+(?:\\.\\d+){{0,2}}))+$', '\\1'), ' ') AS t FROM p)
SELECT keyword_id, array_to_string(t[1:CASE WHEN list_contains(t, 'sdk') OR list_contains(t, 'api') OR list_contains(t, 'code') THEN 3 ELSE 2 END], ' ') AS family
FROM (SELECT keyword_id, CASE WHEN len(t) >= 4 AND list_contains({tx.FRAMEWORK_SUFFIXES!r}, t[len(t)]) THEN t[1:len(t) - 1] ELSE t END AS t FROM t)""")
def stem_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The family of each keyword by its stem."""
    return suffixed(spark, sf_dir).select("keyword_id", tx.stem_family(F.col("keyword")).alias("family"))


HASH_SQL = "lower(to_base(list_reduce(list_prepend(0::bigint, list_transform(string_split({0}, ''), lambda c: unicode(c)::bigint)), lambda h, c: (h * 31 + c) % 4294967296), 36))"


@R.query(f"""{SUFFIXED} SELECT keyword_id, trim(regexp_replace(lower(trim(keyword)), '[^a-z0-9]+', '_', 'g'), '_') AS slug, 'manual_realtime_' || {HASH_SQL.format("lower(trim(keyword))")} AS manual_id FROM s""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of keywords, and of manual keywords."""
    return suffixed(spark, sf_dir).select("keyword_id", tx.slug(F.col("keyword")).alias("slug"), tx.manual_id(F.lit("realtime"), F.col("keyword")).alias("manual_id"))


@R.query(f"""{SUFFIXED}, x AS (SELECT keyword_id, {surface_sql(CAMEL)} AS a, {surface_sql("family")} AS b FROM s)
SELECT keyword_id, unnest(list_distinct(list_filter([a, regexp_replace(a, '[. ]+', '', 'g'), b, regexp_replace(b, '[. ]+', '', 'g')], lambda v: length(v) >= 2))) AS lookup_key FROM x""")
def alias_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each key that a keyword is looked up by, sixty at most by contract."""
    keys = F.slice(tx.lookup_keys(F.col("keyword"), F.array("family")), 1, 60)
    return suffixed(spark, sf_dir).select("keyword_id", F.explode(keys).alias("lookup_key"))


@R.query(f"""{SUFFIXED} SELECT keyword_id, regexp_replace({surface_sql(CAMEL)}, '(?: (?:{"|".join(tx.KEYWORD_VARIANT_WORDS)}))+$', '') AS core,
 array_to_string(list_sort(list_distinct(regexp_extract_all({surface_sql(CAMEL)}, '(\\d+(?:\\.\\d+){{0,2}})', 1))), ',') AS versions,
 array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split({surface_sql(CAMEL)}, ' '), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')), lambda t: regexp_matches(t, '[a-z]') AND length(t) >= 3 AND NOT list_contains({tx.KEYWORD_VARIANT_WORDS!r}, t)))), ',') AS words FROM s""")
def keyword_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pair test of clustering compares: core surface, version tokens, ASCII words."""
    k = F.col("keyword")
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return suffixed(spark, sf_dir).select("keyword_id", tx.trim_minor_suffix(tx.keyword_surface(k)).alias("core"), join(tx.version_tokens(k)).alias("versions"), join(tx.ascii_core_tokens(k)).alias("words"))


@R.query("""SELECT conv_id, turn, CASE WHEN length(coalesce(text, '')) <= 60 THEN coalesce(text, '') ELSE rtrim(substr(text, 1, 59)) || '…' END AS short,
 substr(trim(regexp_replace(regexp_replace(text, '(?m)^[ \\t]*(?:[-*•]|\\d+[.)])[ \\t]+', '', 'g'), '\\s+', ' ', 'g')), 1, 440) AS summary,
 CASE WHEN length(text) <= 120 THEN text WHEN regexp_extract(substr(text, 1, 120), '(?s)^(.*[.!?])(?:\\s|$)', 1) <> '' THEN regexp_extract(substr(text, 1, 120), '(?s)^(.*[.!?])(?:\\s|$)', 1)
  ELSE rtrim(substr(text, 1, 119)) || '…' END AS sentence FROM conversations""")
def truncations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut with an ellipsis, as a clean summary, and at a sentence's end."""
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", tx.truncate(t, 60).alias("short"), tx.clean_summary(t).alias("summary"), tx.truncate_at_sentence(t, 120).alias("sentence"))


@R.query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS host, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS sanitized,
 regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url_key
FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT list_contains(['utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'ref', 'fbclid'], string_split(p, '=')[1])) AS kept FROM pages)""")
def url_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts, sanitised URLs, and the keys that first-wins dedup compares."""
    u = F.col("url")
    return pages(spark, sf_dir).select("page_id", ur.host(u).alias("host"), ur.sanitize(u).alias("sanitized"), ur.url_key(u).alias("url_key"))


@R.query(f"""SELECT page_id, lower(regexp_extract(url, '^([^/]*//[^/?#]*)', 1)) || regexp_extract(url, '^[^/]*//[^/?#]*([^?#]*)', 1)
 || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(list_sort(kept), '&') ELSE '' END AS canonical
FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '=.') AND NOT list_contains({ur.TRACKING!r}, lower(string_split(p, '=')[1]))) AS kept FROM pages)""")
def url_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical URLs."""
    return pages(spark, sf_dir).select("page_id", ur.canonical(F.col("url")).alias("canonical"))


@R.query("""WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://github.com/Own' || page_id || '/Repo' || '?tab=x' WHEN 1 THEN 'https://youtu.be/abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0')
 WHEN 2 THEN 'https://www.youtube.com/watch?t=1&v=abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') WHEN 3 THEN 'https://youtube.com/shorts/abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') ELSE url END AS u FROM pages)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'own' || page_id || '/repo' END AS repo, CASE WHEN page_id % 5 IN (1, 2, 3) THEN 'abcdefgh' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') END AS video FROM u""")
def repo_and_video_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories and video ids in URLs of the usual forms."""
    n = F.lpad((F.col("page_id") % 1000).cast("string"), 3, "0")
    k = F.col("page_id") % 5
    u = (
        F.when(k == 0, F.concat(F.lit("https://github.com/Own"), F.col("page_id").cast("string"), F.lit("/Repo?tab=x")))
        .when(k == 1, F.concat(F.lit("https://youtu.be/abcdefgh"), n))
        .when(k == 2, F.concat(F.lit("https://www.youtube.com/watch?t=1&v=abcdefgh"), n))
        .when(k == 3, F.concat(F.lit("https://youtube.com/shorts/abcdefgh"), n))
        .otherwise(F.col("url"))
    )
    return pages(spark, sf_dir).select("page_id", ur.github_repo(u).alias("repo"), ur.youtube_id(u).alias("video"))


@R.query("""WITH p AS (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '^www\\.', '') AS d, url FROM pages), c AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'old.reddit.com' WHEN 1 THEN 'export.arxiv.org' ELSE d END AS domain, CASE WHEN page_id % 7 = 0 THEN url || '/a.pdf' ELSE url END AS u FROM p)
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'social' WHEN page_id % 4 = 1 THEN 'data' WHEN page_id % 7 = 0 THEN 'data' ELSE 'news' END AS category FROM c""")
def source_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Social, data or news by site and kind of file."""
    k = F.col("page_id")
    domain = F.when(k % 4 == 0, "old.reddit.com").when(k % 4 == 1, "export.arxiv.org").otherwise(ur.host(F.col("url")))
    u = F.when(k % 7 == 0, F.concat("url", F.lit("/a.pdf"))).otherwise(F.col("url"))
    return pages(spark, sf_dir).select("page_id", ur.source_category(F.lit(None).cast("string"), domain, u).alias("category"))


@R.query("""SELECT o_orderkey AS id, strftime(o_orderdate + to_minutes(o_orderkey % 1440) + INTERVAL 9 HOUR, '%Y%m%d_%H%M') AS snapshot_name,
 CASE WHEN o_orderkey % 1440 < 10 THEN o_orderdate + INTERVAL 10 MINUTE WHEN o_orderkey % 1440 < 130 THEN o_orderdate + INTERVAL 130 MINUTE WHEN o_orderkey % 1440 < 250 THEN o_orderdate + INTERVAL 250 MINUTE
  WHEN o_orderkey % 1440 < 370 THEN o_orderdate + INTERVAL 370 MINUTE ELSE o_orderdate + INTERVAL 1450 MINUTE END AS next_run,
 o_orderdate + to_hours(CASE WHEN o_orderkey % 30 IN (6, 12, 24) THEN o_orderkey % 30 ELSE 6 END) AS expires FROM orders""")
def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot names in Korean time, the next scheduled run, and the end of a manual row."""
    o = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int")))
    return o.select(F.col("o_orderkey").alias("id"), tm.snapshot_id_kst(F.col("t")).alias("snapshot_name"), tm.next_slot(F.col("t"), ["00:10", "02:10", "04:10", "06:10"]).alias("next_run"), tm.manual_expiry(F.col("o_orderdate"), F.lit(None).cast("timestamp_ntz"), F.col("o_orderkey") % 30).alias("expires"))


@R.query("""WITH d AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'PT' || (event_id % 400) || 'S' WHEN 1 THEN 'PT' || (event_id % 7) || 'M' || (event_id % 60) || 'S' ELSE 'PT1H' || (event_id % 60) || 'M' END AS d,
 CASE event_id % 3 WHEN 0 THEN event_id % 400 WHEN 1 THEN (event_id % 7) * 60 + event_id % 60 ELSE 3600 + (event_id % 60) * 60 END AS s, ts FROM events)
SELECT event_id, CAST(s AS INTEGER) AS seconds, CASE WHEN s <= 180 THEN 'shorts' ELSE 'longform' END AS kind, CAST(timezone('America/Los_Angeles', timezone('UTC', ts)) AS DATE) AS pacific_day FROM d""")
def video_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO durations in seconds, the type of video, and the day in Los Angeles."""
    k = F.col("event_id")
    s = lambda c: c.cast("string")
    d = F.when(k % 3 == 0, F.concat(F.lit("PT"), s(k % 400), F.lit("S"))).when(k % 3 == 1, F.concat(F.lit("PT"), s(k % 7), F.lit("M"), s(k % 60), F.lit("S"))).otherwise(F.concat(F.lit("PT1H"), s(k % 60), F.lit("M")))
    e = table(spark, sf_dir, "events").withColumn("seconds", tm.iso_duration_seconds(d))
    return e.select("event_id", "seconds", tm.video_type(F.col("seconds")).alias("kind"), tm.pacific_date(F.col("ts")).alias("pacific_day"))


@R.query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(CASE WHEN event_id % 3 = 0 THEN 2 WHEN event_id % 3 = 1 THEN 0 ELSE 1 END AS INTEGER) AS bullets FROM events""")
def model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON picked out of a model's answer, and lists kept as text; what isn't valid is empty."""
    e = table(spark, sf_dir, "events")
    answer = F.concat(F.lit("Here you are:\n```json\n"), F.col("props"), F.lit("\n```"))
    listed = F.when(F.col("event_id") % 3 == 0, '["a", "b"]').when(F.col("event_id") % 3 == 1, "not json").otherwise('["c"]')
    return e.select("event_id", F.from_json(tx.first_json(answer, "object"), "k int")["k"].alias("k"), F.size(tx.bullets(listed)).alias("bullets"))


@R.query("""SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, coalesce(nullif(regexp_extract(html, '<meta property="og:image" content="([^"]*)"', 1), ''), nullif(regexp_extract(html, '<link rel="icon" href="([^"]*)"', 1), ''), 'default.png') AS image,
 CAST(len(regexp_extract_all(html, '<a href="[^"]*"')) AS INTEGER) AS links FROM pages""")
def html_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's title, its picture by order of preference, and its links."""
    from trendspan.sources.mappers import page_image

    return pages(spark, sf_dir).select("page_id", F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1).alias("title"), page_image(F.col("html"), F.col("url"), "default.png").alias("image"), F.size(F.regexp_extract_all("html", F.lit('(<a href="[^"]*")'), 1)).alias("links"))


@R.query(f"""{SUFFIXED} SELECT keyword_id, regexp_matches(keyword, '["“”‘’]|\\d+종|(?:다|요|까)$|[.!?]$') AS is_headline, regexp_matches(family || '/' || replace(keyword, ' ', '-'), '^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$') AS is_repo,
 len(list_filter(string_split(lower(keyword), ' '), lambda w: length(w) >= 3 AND NOT list_contains({tx.STOP_WORDS!r}, w))) > 4 AS is_verbose FROM s""")
def keyword_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines, repository slugs, and keywords of too many words."""
    k = F.col("keyword")
    return suffixed(spark, sf_dir).select("keyword_id", tx.headline(k).alias("is_headline"), tx.repo_slug(F.concat("family", F.lit("/"), F.replace(k, F.lit(" "), F.lit("-")))).alias("is_repo"), (F.size(tx.significant_words(k)) > 4).alias("is_verbose"))


@R.query("SELECT item_id, 'https://x.com/search?q=' || replace(url_encode(text), '+', '%20') AS link, CAST(len(string_split(text, chr(10))) AS INTEGER) AS lines FROM benchmark")
def deep_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search links of social sites for a text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.concat(F.lit("https://x.com/search?q="), tx.uri_component(F.col("text"))).alias("link"), F.size(F.split("text", "\n")).alias("lines"))
