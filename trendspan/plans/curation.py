"""Queries that curate keywords, sources, titles and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.functions import text as tx
from trendspan.operators import consolidation as co
from trendspan.operators.ranking import checkpoint_dir
from trendspan.operators.relational import first_per
from trendspan.plans import ranking as rp
from trendspan.plans import store
from trendspan.plans.registry import Registry
from trendspan.plans.texts import SUFFIXED, suffixed, surface_sql
from trendspan.sources.tables import AS_OF_ITEMS, ITEMS_SQL, items, pages, table

R = Registry()

RULES = {"excluded": ["red widget", "hot gear"], "prefixes": ["tiny"], "patterns": [r"^blue \w+ 2\.0$"], "generic": ["small", "ring", "big", "bolt"], "outlets": ["green"], "other_topics": ["outage"]}


@R.query(f"""{SUFFIXED}, p AS (SELECT keyword_id, keyword, size, {surface_sql("keyword")} AS p, list_filter(string_split(regexp_replace(replace(lower(trim(keyword)), '-', ' '), '\\s+', ' ', 'g'), ' '), lambda w: w <> '' AND NOT list_contains({tx.FUNCTION_WORDS!r}, w)) AS ws,
 list_filter(string_split(regexp_replace(keyword, '\\s+', ' ', 'g'), ' '), lambda w: length(w) >= 2 AND NOT list_contains({kw.PARTICLES!r}, lower(w))) AS counted FROM s),
r AS (SELECT CASE WHEN size % 4 = 0 THEN 'no_match' WHEN p IN ('red widget', 'hot gear') OR starts_with(p, 'tiny') OR regexp_matches(p, '^blue \\w+ 2\\.0$') THEN 'excluded' WHEN p IN ('small', 'ring', 'big', 'bolt') THEN 'generic'
 WHEN len(ws) >= 2 AND len(list_filter(ws, lambda w: w NOT IN ('small', 'ring', 'big', 'bolt'))) = 0 THEN 'all_generic' WHEN len(counted) > 4 THEN 'verbose' WHEN regexp_matches(keyword, '["“”‘’]|\\d+종|(?:다|요|까)$|[.!?]$') THEN 'headline'
 WHEN lower(keyword) = 'green' OR starts_with(lower(keyword), 'green ') OR ends_with(lower(keyword), ' green') THEN 'outlet' WHEN contains(lower(keyword), 'outage') THEN 'other_topic' ELSE 'kept' END AS reason FROM p)
SELECT reason, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY 1""")
def keyword_drop_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many keywords each rule of the drop chain takes; the first that holds counts."""
    reason = kw.drop_reason(F.col("keyword"), F.col("size") % 4, F.lit(2), RULES)
    return suffixed(spark, sf_dir).select(F.coalesce(reason, F.lit("kept")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@R.query(f"""{SUFFIXED}, t AS (SELECT keyword_id, list_distinct(list_filter(string_split(regexp_replace(keyword, '\\s+', ' ', 'g'), ' '), lambda w: regexp_matches(w, '^[A-Z][a-z]+[A-Z]') OR (length(w) >= 4 AND regexp_matches(w, '^[A-Za-z]+-?\\d+(?:\\.\\d+)?$')))) AS t FROM s)
SELECT term, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(t) AS term FROM t) GROUP BY 1""")
def fallback_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that patterns find where no model gave any, counted."""
    return suffixed(spark, sf_dir).select(F.explode(kw.fallback_terms(F.col("keyword"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


_CAMEL = "regexp_replace(trim(keyword), '([a-z])([A-Z])', '\\1 \\2', 'g')"


@R.query(f"""{SUFFIXED}, c AS (SELECT keyword_id, keyword, {surface_sql(_CAMEL)} AS p FROM s), a AS (SELECT *, regexp_replace(p, '^(.+) (?:{"|".join(kw.TRAILING_ACTION_WORDS)})$', '\\1') AS q FROM c),
k AS (SELECT keyword_id, keyword, regexp_replace(CASE WHEN q <> p THEN q ELSE regexp_replace(p, '(?: (?:{"|".join(tx.KEYWORD_VARIANT_WORDS)}))+$', '') END, '[. ]+', '', 'g') AS core FROM a)
SELECT core, min(keyword_id) AS keyword_id, CAST(count(DISTINCT keyword) AS BIGINT) AS aliases FROM k GROUP BY 1""")
def core_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords with one core are one: the first stays, the others are its aliases."""
    return suffixed(spark, sf_dir).groupBy(kw.core_key(F.col("keyword")).alias("core")).agg(F.min("keyword_id").alias("keyword_id"), F.count_distinct("keyword").alias("aliases"))


@R.query("""WITH i AS (SELECT l_partkey AS keyword_id, 'own' || (l_suppkey % 7) || '/repo' AS repo, l_orderkey AS idx FROM lineitem),
v AS (SELECT keyword_id, repo, count(*) AS n, min(idx) AS first FROM i GROUP BY 1, 2) SELECT keyword_id, 'repo:' || repo AS family, CAST(n AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY n DESC, first, repo) AS k FROM v) WHERE k = 1""")
def repo_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repository that most of a keyword's items are from names its family; ties go to the first seen."""
    from trendspan.functions.urls import github_repo
    from trendspan.sources.tables import keywords

    url = F.concat(F.lit("https://github.com/Own"), (F.col("source_id") % 7).cast("string"), F.lit("/Repo/releases"))
    rows = keywords(spark, sf_dir).select("keyword_id", github_repo(url).alias("repo"), F.col("snapshot_id").alias("idx"))
    votes = rows.groupBy("keyword_id", "repo").agg(F.count("*").alias("votes"), F.min("idx").alias("first"))
    best = first_per(votes, ["keyword_id"], [F.desc("votes"), F.asc("first"), F.asc("repo")])
    return best.select("keyword_id", F.concat(F.lit("repo:"), "repo").alias("family"), "votes")


@R.query(f"""{rp.BRIDGE_SQL}, t AS (SELECT keyword_id, item_idx, row_number() OVER (PARTITION BY keyword_id ORDER BY CASE tier WHEN 'P0_CURATED' THEN 0 WHEN 'P1_CONTEXT' THEN 1 WHEN 'P2_RAW' THEN 2 ELSE 3 END, item_idx) AS n FROM bridge JOIN items USING (item_idx))
SELECT keyword_id, item_idx, CAST(n AS INTEGER) AS position FROM t WHERE n <= 2""")
def title_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two titles of each keyword, best tier first."""
    rows = rp.bridge(spark, sf_dir)
    order = F.when(F.col("tier") == "P0_CURATED", 0).when(F.col("tier") == "P1_CONTEXT", 1).when(F.col("tier") == "P2_RAW", 2).otherwise(3)
    position = F.row_number().over(Window.partitionBy("keyword_id").orderBy(order, "item_idx"))
    return rows.withColumn("position", position).where("position <= 2").select("keyword_id", "item_idx", "position")


@R.query(f"""WITH {ITEMS_SQL}, s AS (SELECT item_idx, domain, tier, CAST(round(item_idx % 10 / 10.0 + CASE WHEN lang = 'fr' THEN 1.2 WHEN lang = 'de' THEN 0.6 ELSE 0.0 END + CASE WHEN domain = 'src1' THEN 0.2 ELSE 0 END + CASE WHEN item_idx % 50 = 0 THEN 2.0 ELSE 0 END
 + CASE WHEN published_at >= TIMESTAMP '{AS_OF_ITEMS}' - INTERVAL 72 HOUR THEN 0.3 ELSE 0 END, 4) AS DOUBLE) AS priority FROM items)
SELECT item_idx, domain, priority FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY priority DESC, item_idx) AS n FROM s) WHERE n <= 4""")
def source_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four sources of each bucket by priority: quality, language, portal, origin and age."""
    fresh = F.col("published_at") >= F.lit(AS_OF_ITEMS).cast("timestamp_ntz") - F.expr("INTERVAL 72 HOURS")
    p = kw.source_priority(F.col("item_idx") % 10 / 10.0, F.col("lang") == "fr", F.col("lang") == "de", F.col("domain") == "src1", F.col("item_idx") % 50 == 0, fresh)
    rows = items(spark, sf_dir).withColumn("priority", F.round(p, 4))
    return first_per(rows, ["domain"], [F.desc("priority"), F.asc("item_idx")], 4).select("item_idx", "domain", "priority")


@R.query("""WITH m AS (SELECT 0 AS p, page_id AS id, 'v' || (page_id % 100) AS video, CAST(CASE WHEN page_id % 3 = 0 THEN 'unknown' WHEN page_id % 3 = 1 THEN 'shorts' ELSE 'longform' END AS VARCHAR) AS kind FROM pages
 UNION ALL SELECT 1, event_id, 'v' || (event_id % 300), CASE WHEN event_id % 2 = 0 THEN 'shorts' ELSE 'longform' END FROM events)
SELECT video, p AS origin, kind FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY p, id) AS n FROM m) WHERE n = 1 AND kind IN ('longform', 'unknown')""")
def video_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manual and automatic videos, manual ones first, each once; long ones and those of unknown length are shown."""
    k, e = F.col("page_id"), F.col("event_id")
    manual = pages(spark, sf_dir).select(F.lit(0).alias("origin"), k.alias("id"), F.concat(F.lit("v"), (k % 100).cast("string")).alias("video"), F.when(k % 3 == 0, "unknown").when(k % 3 == 1, "shorts").otherwise("longform").alias("kind"))
    auto = table(spark, sf_dir, "events").select(F.lit(1).alias("origin"), e.alias("id"), F.concat(F.lit("v"), (e % 300).cast("string")).alias("video"), F.when(e % 2 == 0, "shorts").otherwise("longform").alias("kind"))
    first = first_per(manual.unionByName(auto), ["video"], [F.asc("origin"), F.asc("id")])
    return first.where(F.col("kind").isin("longform", "unknown")).select("video", "origin", "kind")


@R.query(f"""{store.WITH}, v AS (SELECT keyword_id, count(*) AS n FROM views GROUP BY 1), t AS (SELECT keyword_id, row_number() OVER (ORDER BY n DESC, keyword_id) AS r FROM v),
g AS (SELECT keyword_id FROM names WHERE size % 2 = 0) SELECT keyword_id, CASE WHEN r <= 20 THEN 'evergreen' ELSE 'replacement' END AS role FROM t WHERE (r <= 20 AND keyword_id IN (SELECT keyword_id FROM g)) OR (r > 20 AND keyword_id NOT IN (SELECT keyword_id FROM g))""")
def evergreen_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the top twenty those that are evergreen, and what could stand in for them."""
    from trendspan.sources.tables import names, views

    counted = views(spark, sf_dir).where("keyword_id is not null").groupBy("keyword_id").agg(F.count("*").alias("n"))
    # Only the first twenty need their places; whatever comes behind them can stand in.
    top = counted.orderBy(F.desc("n"), "keyword_id").limit(20).select("keyword_id")
    green = names(spark, sf_dir).where("size % 2 = 0").select("keyword_id")
    old = top.join(green, "keyword_id", "left_semi").select("keyword_id", F.lit("evergreen").alias("role"))
    return old.unionByName(counted.join(top, "keyword_id", "left_anti").join(green, "keyword_id", "left_anti").select("keyword_id", F.lit("replacement").alias("role")))


@R.query("""WITH f AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'protected' ELSE 'noise' END AS kind, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 30 + 1 END AS before, CASE WHEN p_partkey % 11 <> 0 THEN (p_partkey * 7) % 30 + 1 END AS after FROM part)
SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE before IS NOT NULL AND after <= before + 2) AS BIGINT) AS retained, CAST(count(*) FILTER (WHERE after IS NULL) AS BIGINT) AS hidden, CAST(count(*) FILTER (WHERE after > before + 2) AS BIGINT) AS demoted FROM f GROUP BY 1""")
def quality_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a policy does to protected keywords and to noise: retained, demoted, hidden."""
    k = F.col("p_partkey")
    f = table(spark, sf_dir, "part").select(F.when(F.col("p_size") % 2 == 0, "protected").otherwise("noise").alias("kind"), F.when(k % 9 != 0, k % 30 + 1).alias("before"), F.when(k % 11 != 0, k * 7 % 30 + 1).alias("after"))
    return f.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("after") <= F.col("before") + 2).alias("retained"), F.count_if(F.col("after").isNull()).alias("hidden"), F.count_if(F.col("after") > F.col("before") + 2).alias("demoted"))


@R.query(f"""{store.RANKED_SQL}, last3 AS (SELECT mode, snapshot_id FROM (SELECT *, max(seq) OVER (PARTITION BY mode) - seq AS age FROM ordered) WHERE age < 3),
w AS (SELECT DISTINCT l.mode, p.snapshot_id, unnest(string_split(n.keyword, ' ')) AS term FROM placed p JOIN last3 l USING (snapshot_id) JOIN names n USING (keyword_id)),
c AS (SELECT mode, term, count(DISTINCT snapshot_id) AS n FROM w WHERE length(term) BETWEEN 3 AND 30 AND term NOT IN ('red', 'blue') GROUP BY 1, 2)
SELECT mode, term, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY n DESC, term) AS r FROM c WHERE n >= 2) WHERE r <= 20""")
def dynamic_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that recur in a mode's recent snapshots, twenty at most."""
    from trendspan.sources.tables import keywords, names

    recent = store.newest(spark, sf_dir, 3).select("snapshot_id", "mode")
    rows = keywords(spark, sf_dir).select("snapshot_id", "keyword_id").join(recent, "snapshot_id").join(names(spark, sf_dir).select("keyword_id", "keyword"), "keyword_id")
    terms = rows.select("mode", "snapshot_id", F.explode(F.split("keyword", " ")).alias("term")).where(F.length("term").between(3, 30) & ~F.col("term").isin("red", "blue"))
    counts = terms.groupBy("mode", "term").agg(F.count_distinct("snapshot_id").alias("n")).where("n >= 2")
    return first_per(counts, ["mode"], [F.desc("n"), F.asc("term")], 20).select("mode", "term", "n")


@R.query("""WITH p AS (SELECT p_partkey AS id, (p_partkey % 26) / 25.0 AS j, p_size % 2 = 0 AS v, p_size % 3 = 0 AS a, p_size % 5 = 0 AS c, p_partkey % 101 = 0 AS same FROM part)
SELECT id, same OR (j >= 0.92 AND (v OR a OR c)) OR (j >= 0.8 AND v AND (a OR c)) OR (j >= 0.75 AND a AND (v OR c)) AS merged FROM p""")
def pair_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether pairs of keywords are one."""
    s, k = F.col("p_size"), F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), kw.should_merge(k % 26 / 25.0, k % 101 == 0, s % 2 == 0, s % 3 == 0, s % 5 == 0).alias("merged"))


GENERIC = ["small", "ring", "big", "bolt"]
HEAD_SQL = f"(list_contains({tx.CONTEXT_HEAD_HINTS!r}, t) OR regexp_matches(t, '{tx.CONTEXT_HEAD_SUFFIX}'))"
ANCHOR_SQL = f"length(t) >= 2 AND NOT list_contains({[*GENERIC, *tx.FUNCTION_WORDS, *tx.STOP_WORDS]!r}, t) AND NOT {HEAD_SQL} AND regexp_matches(t, '[a-z0-9]')"


@R.query(f"""{SUFFIXED}, p AS (SELECT *, {surface_sql(_CAMEL)} AS p FROM s), w AS (SELECT *, list_filter(string_split(p, ' '), lambda t: t <> '') AS ts FROM p),
a AS (SELECT *, len(list_filter(ts, lambda t: {ANCHOR_SQL})) AS anchors FROM w),
q AS (SELECT *, 40 + 10 + CASE WHEN regexp_matches(p, '[a-z]\\s+\\d+(?:\\.\\d+)?') THEN 8 ELSE 0 END + 5 * least(4, anchors) + least(size, 20) + CASE WHEN size % 4 = 0 THEN 4 ELSE 0 END
 - CASE WHEN anchors = 0 AND (len(list_filter(ts, lambda t: NOT {HEAD_SQL})) = 0 OR (len(ts) = 2 AND list_contains({GENERIC!r}, ts[1]) AND len(list_filter(ts[2:2], lambda t: {HEAD_SQL})) = 1)) THEN 14 ELSE 0 END
 - CASE WHEN list_contains({tx.KEYWORD_VARIANT_WORDS!r}, ts[len(ts)]) THEN 6 ELSE 0 END AS score FROM a)
SELECT family, keyword_id, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, anchors DESC, length(p), keyword, keyword_id) AS n FROM q) WHERE n = 1""")
def canonical_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword that names each cluster."""
    k, tier = F.col("keyword"), F.when(F.col("size") % 4 == 0, "P0_CURATED").otherwise("P2_RAW")
    s = suffixed(spark, sf_dir).withColumn("score", kw.canonical_score(k, F.array().cast("array<string>"), F.col("size"), tier, GENERIC))
    order = [F.desc("score"), F.size(tx.anchor_tokens(k, GENERIC)).desc(), F.length(tx.keyword_surface(k)).asc(), k.asc(), F.asc("keyword_id")]
    return first_per(s, ["family"], order).select("family", "keyword_id", "score")


@R.query(f"""{rp.CANDIDATES_SQL} SELECT keyword_id, appearances + 5 <= 10 OR is_new OR domains > 3 OR version_kind <> 'none' OR velocity >= 0.6 OR engagement >= 0.65 AS shown,
 CAST(CASE WHEN matches = 0 THEN price ELSE round(price + engagement / 100, 4) END AS DOUBLE) AS total FROM c""")
def display_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which keywords behind the tenth are shown, and totals with a delta applied."""
    c = rp.candidates(spark, sf_dir)
    shown = kw.displayed(F.col("appearances") + 5, F.col("is_new"), F.greatest(F.col("domains") - 3, F.lit(0)), F.lit(None).cast("string"), F.col("version_kind") != "none", F.col("velocity"), F.col("engagement"))
    delta = F.when(F.col("matches") == 0, F.lit(float("nan"))).otherwise(F.col("engagement") / 100)
    return c.select("keyword_id", shown.alias("shown"), kw.applied_delta(F.col("price"), delta).alias("total"))


@R.query("""SELECT doc_id, CAST(2 * ((contains(lower(text), 'the'))::INT + (contains(lower(text), 'with'))::INT) - 2 * (contains(lower(text), 'der'))::INT AS INTEGER) AS focus, CASE WHEN contains(h, ' ') AND NOT starts_with(h, '"') THEN '"' || h || '"' ELSE h END AS query FROM (SELECT *, trim(regexp_replace(string_split(text, chr(10))[1], '\\s+', ' ', 'g')) AS h FROM documents)""")
def focus_and_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Focus scores by words contained, and searches for a phrase."""
    head = tx.collapse(F.substring_index("text", "\n", 1))
    return table(spark, sf_dir, "documents").select("doc_id", kw.focus_score(F.lower("text"), ["the", "with"], ["der"]).alias("focus"), kw.exact_query(head).alias("query"))


_INNER, _OUTER = (bytes(b ^ x for b in b"secret".ljust(64, b"\0")).hex() for x in (0x36, 0x5C))


@R.query(f"SELECT user_id, sha256(unhex('{_OUTER}') || unhex(sha256(unhex('{_INNER}') || encode(CAST(user_id AS VARCHAR))))) AS viewer, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def viewer_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Viewers as keyed hashes, and how many events each has."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", kw.viewer_hash("secret", F.col("user_id").cast("string")).alias("viewer"), "n")


@R.query()
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different titles alike by 0.85 or more, each title under its first place: pages' own, and a feed's with a mark behind them."""
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    own = pages(spark, sf_dir).select((F.col("page_id") * 2).alias("id"), title.alias("title"))
    marked = own.select((F.col("id") + 1).alias("id"), F.concat("title", F.lit(" #1")).alias("title"))
    t = own.unionByName(marked).select("id", tx.title_key(F.col("title")).alias("key")).where("key <> ''").groupBy("key").agg(F.min("id").alias("position"))
    checkpoint_dir(spark)
    t = t.checkpoint()
    k = lambda c: t.select(F.col("position").alias(c), F.col("key").alias(f"k{c}"))
    pairs = co.alike_titles(t, 0.85).join(k("x"), "x").join(k("y"), "y")
    return pairs.select(F.col("x").alias("title_id"), F.col("y").alias("other"), kw.title_similarity(F.col("kx"), F.col("ky")).alias("similarity"))
