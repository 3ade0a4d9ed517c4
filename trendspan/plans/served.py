"""Consolidation of keywords and articles, and the answers that are served: lists, details, search, meta data, promos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.functions import scoring as sc
from trendspan.functions import text as tx
from trendspan.functions import urls as ur
from trendspan.operators import consolidation as co
from trendspan.operators.relational import best_of, keep_after, upsert
from trendspan.plans import ranking as rp
from trendspan.plans import store
from trendspan.plans.registry import Registry
from trendspan.plans.texts import CAMEL, SUFFIXED, suffixed, surface_sql
from trendspan.sources.tables import AS_OF_SNAPSHOTS, keywords, names, pages, snapshots, table, views

R = Registry()

_ROWS = ", ".join(f"('{i}', '{k}', {a!r}::VARCHAR[])" for i, k, a in rp.CATALOGUE)
_SURFACE = surface_sql("regexp_replace(trim(x), '([a-z])([A-Z])', '\\1 \\2', 'g')")
_VARIANT = f"'(?: (?:{'|'.join(tx.KEYWORD_VARIANT_WORDS)}))+$'"
_HEAD = f"(list_contains({tx.CONTEXT_HEAD_HINTS!r}, t) OR regexp_matches(t, '{tx.CONTEXT_HEAD_SUFFIX}'))"
_ANCHOR = f"length(t) >= 2 AND NOT list_contains({[*tx.FUNCTION_WORDS, *tx.STOP_WORDS]!r}, t) AND NOT {_HEAD} AND regexp_matches(t, '[a-z0-9가-힣]')"


@R.query(f"""WITH RECURSIVE {rp.BRIDGE_SQL[5:]}, c AS (SELECT * FROM (VALUES {_ROWS}) AS v(keyword_id, keyword, aliases)),
e AS (SELECT keyword_id, keyword, unnest(list_prepend(keyword, aliases)) AS x, generate_subscripts(list_prepend(keyword, aliases), 1) AS pos FROM c),
f AS (SELECT keyword_id, keyword, x, pos, {_SURFACE} AS s FROM e), g AS (SELECT keyword_id, x, s AS form FROM f WHERE s <> '' UNION SELECT keyword_id, x, regexp_replace(s, {_VARIANT}, '') FROM f WHERE s <> ''),
sig AS (SELECT keyword_id, list_distinct(list(regexp_replace(form, '[. ]+', '', 'g'))) AS compacts, list_distinct(flatten(list(regexp_extract_all(form, '(\\d+(?:\\.\\d+){{0,2}})', 1)))) AS versions,
 list_distinct(list_filter(flatten(list(list_transform(string_split(form, ' '), lambda t: regexp_replace(t, '[^a-z0-9]', '', 'g')))), lambda t: regexp_matches(t, '[a-z]') AND length(t) >= 3 AND NOT list_contains({tx.KEYWORD_VARIANT_WORDS!r}, t))) AS cores,
 bool_or(regexp_matches(x, '[가-힣]')) AS hangul, bool_or(regexp_matches(x, '[A-Za-z]')) AS ascii FROM g GROUP BY 1),
n AS (SELECT keyword_id, count(*) AS n FROM bridge GROUP BY 1), o AS (SELECT a.keyword_id AS a, b.keyword_id AS b, count(*) AS k FROM bridge a JOIN bridge b USING (item_idx) WHERE a.keyword_id < b.keyword_id GROUP BY 1, 2),
j AS (SELECT p.keyword_id AS a, q.keyword_id AS b, coalesce(o.k / (x.n + y.n - o.k), 0) AS jaccard, len(list_intersect(p.compacts, q.compacts)) > 0 AS same, len(list_intersect(p.versions, q.versions)) > 0 AS v, len(list_intersect(p.cores, q.cores)) > 0 AS w, (p.hangul AND q.ascii) OR (q.hangul AND p.ascii) AS x
 FROM sig p JOIN sig q ON p.keyword_id < q.keyword_id LEFT JOIN o ON o.a = p.keyword_id AND o.b = q.keyword_id LEFT JOIN n x ON x.keyword_id = p.keyword_id LEFT JOIN n y ON y.keyword_id = q.keyword_id),
l AS (SELECT a, b FROM j WHERE same OR (jaccard >= 0.92 AND (v OR w OR x)) OR (jaccard >= 0.8 AND v AND (w OR x)) OR (jaccard >= 0.75 AND w AND (v OR x))),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT keyword_id, keyword_id FROM c), reach AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a), grp AS (SELECT a AS keyword_id, min(b) AS g FROM reach GROUP BY 1),
own AS (SELECT keyword_id, count(*) AS own, min(CASE tier WHEN 'P0_CURATED' THEN 0 ELSE 1 END) AS best FROM bridge JOIN items USING (item_idx) GROUP BY 1),
sc AS (SELECT f.keyword_id, f.keyword, s, len(list_filter(string_split(s, ' '), lambda t: {_ANCHOR})) AS anchors, CASE WHEN sig.ascii THEN 40 ELSE 0 END + CASE WHEN sig.hangul THEN 0 ELSE 10 END + CASE WHEN regexp_matches(s, '[a-z]\\s+\\d+') THEN 8 ELSE 0 END
 + 5 * least(4, len(list_filter(string_split(s, ' '), lambda t: {_ANCHOR}))) + least(coalesce(own, 0), 20) + CASE WHEN best = 0 THEN 4 ELSE 0 END - CASE WHEN list_contains({tx.KEYWORD_VARIANT_WORDS!r}, string_split(s, ' ')[-1]) THEN 6 ELSE 0 END
 - CASE WHEN len(list_filter(string_split(s, ' '), lambda t: {_ANCHOR})) = 0 AND len(list_filter(string_split(s, ' '), lambda t: NOT {_HEAD})) = 0 THEN 14 ELSE 0 END AS score FROM f JOIN sig USING (keyword_id) LEFT JOIN own USING (keyword_id) WHERE pos = 1),
ch AS (SELECT g, keyword_id, keyword, s FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, anchors DESC, length(s), keyword, keyword_id) AS r FROM sc JOIN grp USING (keyword_id)) WHERE r = 1),
al AS (SELECT g, string_agg(x, '|' ORDER BY keyword_id, pos) AS aliases FROM (SELECT grp.g, f.keyword_id, pos, x, row_number() OVER (PARTITION BY grp.g, f.s ORDER BY f.keyword_id, pos) AS r FROM f JOIN grp USING (keyword_id) JOIN ch ON ch.g = grp.g WHERE f.s <> ch.s AND f.s <> '') WHERE r = 1 GROUP BY 1),
m AS (SELECT g, count(DISTINCT item_idx) AS matches, count(DISTINCT domain) AS domains, max(published_at) AS latest_at, CASE min(CASE tier WHEN 'P0_CURATED' THEN 0 WHEN 'P1_CONTEXT' THEN 1 ELSE 2 END) WHEN 0 THEN 'P0_CURATED' WHEN 1 THEN 'P1_CONTEXT' ELSE 'P2_RAW' END AS tier FROM bridge JOIN items USING (item_idx) JOIN grp USING (keyword_id) GROUP BY 1)
SELECT ch.keyword_id, ch.keyword, coalesce(al.aliases, '') AS aliases, CAST(coalesce(matches, 0) AS BIGINT) AS matches, CAST(coalesce(domains, 0) AS BIGINT) AS domains, latest_at, coalesce(tier, 'P2_RAW') AS tier FROM ch LEFT JOIN al USING (g) LEFT JOIN m USING (g)""")
def keyword_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's keywords consolidated: those of one form, or of alike items and shared words, under the best name."""
    catalogue = spark.createDataFrame([(i, k, list(a)) for i, k, a in rp.CATALOGUE], "keyword_id string, keyword string, aliases array<string>")
    found = co.consolidate(catalogue, rp.bridge(spark, sf_dir), rp.pair_jaccard(spark, sf_dir).select("a", "b", "jaccard"))
    return found.withColumn("aliases", F.array_join("aliases", "|"))


@R.query(f"""{SUFFIXED}, g AS (SELECT keyword_id AS position, keyword AS member, min(keyword) OVER (PARTITION BY family) AS canonical, price FROM s),
v AS (SELECT position, lower(member) AS low, lower(canonical) AS into_ FROM g WHERE price > 1500 UNION ALL SELECT position, 'ghost ' || position, lower(canonical) FROM g WHERE price > 1500),
k AS (SELECT DISTINCT lower(keyword) AS low FROM s), t AS (SELECT low, arg_max(into_, position) AS into_ FROM v WHERE low IN (SELECT low FROM k) GROUP BY 1),
m AS (SELECT s.keyword_id AS position, s.keyword, s.family, t.into_ FROM s LEFT JOIN t ON t.low = lower(s.keyword)), x AS (SELECT into_, count(DISTINCT n) AS n, count(*) AS c FROM (SELECT into_, unnest([keyword, family]) AS n FROM m WHERE into_ IS NOT NULL) GROUP BY 1),
d AS (SELECT m.position, m.keyword, m.family, count(DISTINCT a.n) AS n FROM m JOIN (SELECT into_, unnest([keyword, family]) AS n FROM m WHERE into_ IS NOT NULL) a ON a.into_ = lower(m.keyword) WHERE m.into_ IS NULL AND a.n <> m.family GROUP BY 1, 2, 3)
SELECT m.position, m.keyword, CAST(1 + coalesce(d.n, 0) AS INTEGER) AS n_aliases FROM m LEFT JOIN d USING (position) WHERE m.into_ IS NULL""")
def semantic_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords after groups that a model gave are merged; members and names that don't exist change nothing."""
    s = suffixed(spark, sf_dir)
    k = s.select(F.col("keyword_id").alias("position"), "keyword", F.array("family").alias("aliases"))
    g = s.select(F.col("keyword_id").alias("position"), F.col("keyword").alias("member"), F.min("keyword").over(Window.partitionBy("family")).alias("canonical"), "price").where("price > 1500")
    ghosts = g.select("position", F.concat(F.lit("ghost "), F.col("position").cast("string")).alias("member"), "canonical")
    out = co.semantic_merge(k, g.select("position", "member", "canonical").unionByName(ghosts))
    return out.select("position", "keyword", F.size("aliases").alias("n_aliases"))


@R.query("""WITH b AS (SELECT p_partkey AS position, CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS keyword, p_brand AS alias FROM part),
a AS (SELECT lower(keyword) AS low, string_agg(DISTINCT alias, ',' ORDER BY alias) AS aliases FROM b GROUP BY 1)
SELECT f.position, f.keyword, a.aliases FROM (SELECT *, row_number() OVER (PARTITION BY lower(keyword) ORDER BY position) AS n FROM b) f JOIN a ON a.low = lower(f.keyword) WHERE n = 1""")
def batch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of several batches, equal but for case, as one."""
    n = names(spark, sf_dir)
    b = n.select(F.col("keyword_id").alias("position"), F.when(F.col("keyword_id") % 2 == 0, F.upper("keyword")).otherwise(F.col("keyword")).alias("keyword"), F.array("family").alias("aliases"))
    return co.merge_batches(b).withColumn("aliases", F.array_join("aliases", ","))


@R.query("""SELECT l_partkey AS keyword_id, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS matches, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS domains, max(l_shipdate) AS latest_at,
 CASE min(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END) WHEN 0 THEN 'P0_CURATED' WHEN 1 THEN 'P1_CONTEXT' ELSE 'P2_RAW' END AS tier, max(l_discount) AS domain_bonus FROM lineitem GROUP BY 1""")
def candidates_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of one keyword id as one: sets united, latest time, best tier, largest bonus."""
    k = keywords(spark, sf_dir)
    tier = F.when(F.col("type") == "A", "P0_CURATED").when(F.col("type") == "N", "P1_CONTEXT").otherwise("P2_RAW")
    best = F.min(co.tier_rank(tier))
    return k.groupBy("keyword_id").agg(
        F.count_distinct("snapshot_id").alias("matches"),
        F.count_distinct("source_id").alias("domains"),
        F.max("seen_at").alias("latest_at"),
        F.element_at(F.array(*map(F.lit, co.TIER_ORDER)), (best + 1).cast("int")).alias("tier"),
        F.max("discount").alias("domain_bonus"),
    )


_BROAD = "trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(keyword)), '[_\\-·/@:]+', ' ', 'g'), '[“”\"''`~!#$%^&*()+=\\[\\]{}|\\\\;<>?,.]', ' ', 'g'), '\\s+', ' ', 'g'))"


@R.query(SUFFIXED + f""", w AS (SELECT keyword_id, keyword, list_filter(string_split({surface_sql(CAMEL)}, ' '), lambda t: t <> '') AS ts FROM s)
SELECT keyword_id, """ + _BROAD + f""" AS broad, array_to_string(list_filter(ts, lambda t: {_ANCHOR}), ' ') AS anchors, CAST(len(list_filter(ts, lambda t: {_HEAD})) AS INTEGER) AS heads,
 len(ts) > 0 AND len(list_filter(ts, lambda t: {_ANCHOR})) = 0 AND len(list_filter(ts, lambda t: NOT {_HEAD})) = 0 AS dependent, CASE WHEN keyword_id % 3 = 0 THEN trim(regexp_replace(keyword, '\\s+', ' ', 'g')) END AS variant FROM w""")
def keyword_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that anchor a keyword, its head words, and what is left of one with Hangul in it."""
    k = F.col("keyword")
    hangul = F.when(F.col("keyword_id") % 3 == 0, F.concat(F.lit("모델-"), k, F.lit("리얼"))).otherwise(k)
    heads = F.filter(tx.tokens(tx.keyword_surface(k)), tx.context_head)
    return suffixed(spark, sf_dir).select("keyword_id", tx.broad_surface(k).alias("broad"), F.array_join(tx.anchor_tokens(k, []), " ").alias("anchors"), F.size(heads).alias("heads"), tx.context_dependent(k, []).alias("dependent"), tx.ascii_variant(hangul).alias("variant"))


@R.query()
def curated_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as articles without duplicates, by canonical URL and, where curated, by alike titles; how many go by which."""
    k = F.col("page_id")
    tier = F.element_at(F.array(*map(F.lit, co.ARTICLE_TIERS)), (k % 5).cast("int") + 1)
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    a = pages(spark, sf_dir).select(k.alias("position"), F.col("url").alias("link"), title.alias("title"), tier.alias("tier"), F.when(k % 2 == 0, "curated").otherwise("raw").alias("origin_type"), (k % 7 / 7).alias("confidence"), (k % 11).cast("double").alias("score"))
    return co.dedup_articles(a).select("position", "title", "tier")


# --- served answers ---------------------------------------------------------------------------------------------------

#: A snapshot of many keywords: all of a mode's orders of one day.
DAYS_SQL = f"""{store.WITH}, d AS (SELECT mode, CAST(created_at AS DATE) AS day, snapshot_id, created_at FROM snapshots), l AS (SELECT mode, max(day) AS day FROM d WHERE snapshot_id IN (SELECT snapshot_id FROM keywords) GROUP BY 1),
now AS (SELECT d.mode, d.snapshot_id, d.created_at FROM d JOIN l USING (mode, day)), rows AS (SELECT now.mode, k.* FROM keywords k JOIN now USING (snapshot_id)),
t AS (SELECT mode, keyword_id, sum(score) AS total, count(DISTINCT source_id) FILTER (WHERE quantity >= 10) AS sources, max(discount) * 10 AS engagement, max(type) AS type, max(tax) AS velocity FROM rows GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY total DESC, keyword_id) AS rank FROM t)"""


def last_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mode, snapshot_id, created_at`` of the newest day that has keywords, by mode."""
    s = snapshots(spark, sf_dir).select("mode", "snapshot_id", "created_at", F.to_date("created_at").alias("day"))
    last = s.join(keywords(spark, sf_dir).select("snapshot_id"), "snapshot_id", "left_semi").groupBy("mode").agg(F.max("day").alias("day"))
    return s.join(F.broadcast(last), ["mode", "day"]).select("mode", "snapshot_id", "created_at")


def ranked_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keywords(spark, sf_dir).join(F.broadcast(last_day(spark, sf_dir)), "snapshot_id")
    t = rows.groupBy("mode", "keyword_id").agg(
        F.sum("score").alias("total"), F.count_distinct(F.when(F.col("quantity") >= 10, F.col("source_id"))).alias("sources"), (F.max("discount") * 10).alias("engagement"), F.max("type").alias("type"), F.max("tax").alias("velocity")
    )
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("total"), "keyword_id")))


@R.query(f"""{DAYS_SQL}, a AS (SELECT DISTINCT keyword_id FROM names WHERE size > 25)
SELECT r.mode, r.keyword_id, n.keyword, CAST(r.rank AS INTEGER) AS rank, CASE r.type WHEN 'R' THEN 'social' WHEN 'A' THEN 'data' ELSE 'news' END AS kind FROM r JOIN names n USING (keyword_id)
WHERE NOT (r.type = 'R' AND r.keyword_id NOT IN (SELECT keyword_id FROM a)) AND (r.rank <= 10 OR r.sources > 0 OR r.velocity >= 0.6 OR r.engagement >= 0.65) AND r.rank <= 60""")
def served_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The served list of each mode: ranked, manual rows that expired hidden, ranks behind ten only with a reason, old types renamed."""
    r, n = ranked_day(spark, sf_dir).where("rank <= 60"), names(spark, sf_dir)
    active = n.where("size > 25").select("keyword_id", F.lit(True).alias("active"))
    rows = r.join(n.select("keyword_id", "keyword"), "keyword_id").join(active, "keyword_id", "left")
    shown = kw.displayed(F.col("rank"), F.lit(False), F.col("sources"), F.lit(None).cast("string"), F.lit(False), F.col("velocity"), F.col("engagement"))
    stored = F.when(F.col("type") == "R", "community").when(F.col("type") == "A", "video").otherwise("news")
    kind = kw.legacy_type(stored, F.lit(None).cast("string"), F.lit(None).cast("string"))
    return rows.where(~((F.col("type") == "R") & F.col("active").isNull()) & shown).select("mode", "keyword_id", "keyword", "rank", kind.alias("kind"))


@R.query(f"""{store.WITH}, lk AS (SELECT keyword_id, max(snapshot_id) AS snapshot_id FROM keywords GROUP BY 1),
src AS (SELECT k.keyword_id, CASE k.type WHEN 'R' THEN 'social' WHEN 'A' THEN 'data' ELSE 'news' END AS category, k.source_id, max(CASE WHEN k.quantity >= 5 THEN k.seen_at END) AS seen_at FROM keywords k GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY keyword_id, category ORDER BY coalesce(seen_at, TIMESTAMP '1970-01-01') DESC, source_id) AS n FROM src),
g AS (SELECT keyword_id, category, string_agg(CAST(source_id AS VARCHAR), ',' ORDER BY n) FILTER (WHERE n <= 5) AS sources FROM o GROUP BY 1, 2),
days AS (SELECT keyword_id, CAST(ts AS DATE) AS day, count(*) AS c FROM views GROUP BY 1, 2), sp AS (SELECT keyword_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY day) AS sparkline FROM (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY day DESC) AS k FROM days) WHERE k <= 7 GROUP BY 1)
SELECT g.keyword_id, n.keyword, lk.snapshot_id, g.category, g.sources, coalesce(sp.sparkline, '') AS sparkline FROM g JOIN lk USING (keyword_id) JOIN names n USING (keyword_id) LEFT JOIN sp USING (keyword_id)""")
def served_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each keyword's detail: last snapshot, five sources of each category, newest first and undated last, and its sparkline."""
    k = keywords(spark, sf_dir)
    last = k.groupBy("keyword_id").agg(F.max("snapshot_id").alias("snapshot_id"))
    kind = F.when(F.col("type") == "R", "social").when(F.col("type") == "A", "data").otherwise("news")
    src = k.groupBy("keyword_id", ur.source_category(kind, F.lit(None).cast("string"), F.lit(None).cast("string")).alias("category"), "source_id").agg(F.max(F.when(F.col("quantity") >= 5, F.col("seen_at"))).alias("seen_at"))
    dated = F.coalesce("seen_at", F.lit("1970-01-01").cast("timestamp_ntz"))
    w = Window.partitionBy("keyword_id", "category").orderBy(dated.desc(), "source_id")
    top = src.withColumn("n", F.row_number().over(w)).where("n <= 5")
    listed = F.array_sort(F.collect_list(F.struct("n", F.col("source_id").cast("string").alias("s"))))
    grouped = top.groupBy("keyword_id", "category").agg(F.array_join(F.transform(listed, lambda x: x["s"]), ",").alias("sources"))
    spark_line = store.sparkline(spark, sf_dir).select("keyword_id", F.col("counts").alias("sparkline"))
    out = grouped.join(last, "keyword_id").join(names(spark, sf_dir).select("keyword_id", "keyword"), "keyword_id").join(spark_line, "keyword_id", "left")
    return out.select("keyword_id", "keyword", "snapshot_id", "category", "sources", F.coalesce("sparkline", F.lit("")).alias("sparkline"))


@R.query(f"""{store.WITH}, h AS (SELECT DISTINCT keyword_id, keyword FROM names WHERE keyword ILIKE '%ring%' OR alias ILIKE '%ECON%')
SELECT h.keyword_id, h.keyword, CAST(count(DISTINCT source_id) FILTER (WHERE type NOT IN ('R', 'A')) AS BIGINT) AS news, CAST(count(DISTINCT source_id) FILTER (WHERE type = 'R') AS BIGINT) AS social, CAST(count(DISTINCT source_id) FILTER (WHERE type = 'A') AS BIGINT) AS data
FROM h LEFT JOIN keywords k USING (keyword_id) GROUP BY 1, 2""")
def served_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords found by a pattern in name or alias, with their sources by category."""
    hits = names(spark, sf_dir).where(F.col("keyword").ilike("%ring%") | F.col("alias").ilike("%ECON%")).select("keyword_id", "keyword").distinct()
    rows = hits.join(keywords(spark, sf_dir).select("keyword_id", "type", "source_id"), "keyword_id", "left")
    of = lambda c, name: F.count_distinct(F.when(c, F.col("source_id"))).alias(name)
    t = F.col("type")
    return rows.groupBy("keyword_id", "keyword").agg(of(~t.isin("R", "A"), "news"), of(t == "R", "social"), of(t == "A", "data"))


@R.query(f"""{store.WITH}, k AS (SELECT DISTINCT snapshot_id FROM keywords), p AS (SELECT s.*, k.snapshot_id IS NOT NULL AS filled FROM snapshots s LEFT JOIN k USING (snapshot_id)),
b AS (SELECT mode, snapshot_id, created_at, row_number() OVER (PARTITION BY mode ORDER BY filled DESC, created_at DESC, snapshot_id DESC) AS n FROM p)
SELECT mode, snapshot_id, created_at AS updated_at, CAST(greatest(0, floor(epoch(TIMESTAMP '{AS_OF_SNAPSHOTS}') - epoch(created_at))) AS BIGINT) AS lag_seconds FROM b WHERE n = 1""")
def served_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each mode's snapshot to show, one with keywords if there is any, and how many seconds old it is."""
    s = snapshots(spark, sf_dir)
    filled = keywords(spark, sf_dir).select("snapshot_id").distinct().withColumn("filled", F.lit(1))
    p = s.join(filled, "snapshot_id", "left").withColumn("filled", F.coalesce("filled", F.lit(0)))
    best = best_of(p, ["mode"], F.struct("filled", "created_at", "snapshot_id"), ["snapshot_id", "created_at"])
    seconds = lambda c: F.unix_timestamp(c.cast("timestamp"))
    lag = F.greatest(F.lit(0), seconds(F.lit(AS_OF_SNAPSHOTS).cast("timestamp_ntz")) - seconds(F.col("created_at")))
    return best.select("mode", "snapshot_id", F.col("created_at").alias("updated_at"), lag.cast("long").alias("lag_seconds"))


@R.query("""WITH p AS (SELECT c_custkey AS id, c_name AS title_en, '' AS title_ko, c_acctbal AS sort_order, c_acctbal > 0 AS enabled, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INTEGER)) AS updated_at FROM customer), m AS (SELECT max(updated_at) AS last FROM p WHERE enabled)
SELECT id, title_en AS title, m.last AS last_modified FROM p, m WHERE enabled AND m.last > TIMESTAMP '2024-01-20'""")
def served_promos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enabled promos in one language; nothing where none has changed since the caller's time."""
    k = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("title_en"), F.lit("").alias("title_ko"), (F.col("c_acctbal") > 0).alias("enabled"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(days=(k % 30).cast("int"))).alias("updated_at")).where("enabled")
    last = p.agg(F.max("updated_at").alias("last_modified"))
    since = F.lit("2024-01-20").cast("timestamp_ntz")
    return p.crossJoin(F.broadcast(last.where(F.col("last_modified") > since))).select("id", tx.prefer(F.col("title_ko"), F.col("title_en")).alias("title"), "last_modified")


@R.query("""WITH e AS (SELECT event_type AS source_key, max(ts) AS last_published, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1), o AS (SELECT event_type AS source_key, max(ts) AS last_published, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1)
SELECT coalesce(e.source_key, o.source_key) AS source_key, coalesce(e.last_published, o.last_published) AS last_published, CAST(coalesce(e.n, o.n) AS BIGINT) AS last_item_count FROM e FULL JOIN o USING (source_key)""")
def ingestion_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each source after a second run: an upsert of its newest item and count."""
    e, split = table(spark, sf_dir, "events"), F.lit("2024-01-15").cast("timestamp_ntz")
    run = lambda rows: rows.groupBy(F.col("event_type").alias("source_key")).agg(F.max("ts").alias("last_published"), F.count("*").alias("last_item_count"))
    return upsert(run(e.where(F.col("ts") < split)), run(e.where(F.col("ts") >= split)), ["source_key"])


@R.query("""SELECT 1 AS id, round(max(l_discount), 4) AS w_recency, round(avg(l_tax), 4) AS w_frequency, 0.14::DOUBLE AS w_authority FROM lineitem""")
def ranking_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single row of weights after an upsert of measured ones; what isn't given stays."""
    old = spark.createDataFrame([(1, 0.24, 0.10, 0.14)], "id int, w_recency double, w_frequency double, w_authority double")
    new = table(spark, sf_dir, "lineitem").agg(F.lit(1).alias("id"), F.round(F.max("l_discount"), 4).alias("w_recency"), F.round(F.avg("l_tax"), 4).alias("w_frequency"))
    return upsert(old, new, ["id"])


@R.query(f"""{store.WITH}, lim AS (SELECT TIMESTAMP '{AS_OF_SNAPSHOTS}' - INTERVAL 1100 DAY AS t), s AS (SELECT * FROM snapshots, lim WHERE created_at >= t), k AS (SELECT k.* FROM keywords k, lim WHERE k.seen_at >= t AND k.snapshot_id IN (SELECT snapshot_id FROM s)),
a AS (SELECT DISTINCT n.keyword_id FROM names n WHERE n.keyword_id IN (SELECT keyword_id FROM k))
SELECT 'aggregated' AS relation, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT CAST(s.created_at AS DATE), k.keyword_id FROM keywords k JOIN snapshots s USING (snapshot_id) WHERE s.created_at >= TIMESTAMP '{AS_OF_SNAPSHOTS}' - INTERVAL 1500 DAY)
UNION ALL SELECT 'keywords', count(*) FROM k UNION ALL SELECT 'snapshots', count(*) FROM s UNION ALL SELECT 'aliases', count(*) FROM a""")
def retention_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each relation once old rows are rolled up by day and then deleted, children before parents."""
    s, k, n = snapshots(spark, sf_dir), keywords(spark, sf_dir), names(spark, sf_dir)
    rolled = k.join(keep_after(s, "created_at", AS_OF_SNAPSHOTS, 1500), "snapshot_id").select(F.to_date("created_at").alias("day"), "keyword_id").distinct()
    kept_s = keep_after(s, "created_at", AS_OF_SNAPSHOTS, 1100)
    kept_k = keep_after(k, "seen_at", AS_OF_SNAPSHOTS, 1100).join(kept_s.select("snapshot_id"), "snapshot_id", "left_semi")
    kept_a = n.join(kept_k.select("keyword_id"), "keyword_id", "left_semi")
    out = None
    for relation, rows in {"aggregated": rolled, "keywords": kept_k, "snapshots": kept_s, "aliases": kept_a}.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(relation).alias("relation"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@R.query(f"""{store.RANKED_SQL}, m AS (SELECT mode, count(*) AS n FROM snapshots JOIN keywords USING (snapshot_id) GROUP BY 1), a AS (SELECT o_orderstatus AS mode, count(DISTINCT o_custkey) AS manual FROM orders WHERE o_totalprice > 400000 GROUP BY 1),
l AS (SELECT m.mode, m.n, least(60, greatest(20, coalesce(a.manual, 0) + 10)) AS ranking_limit FROM m LEFT JOIN a USING (mode))
SELECT mode, CAST(ranking_limit AS INTEGER) AS ranking_limit, CAST(least(greatest(ranking_limit * 3, 40), greatest(n, ranking_limit)) AS BIGINT) AS candidate_limit FROM l""")
def candidate_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many candidates each mode ranks and keeps, by its active manual keywords and all it has."""
    s = snapshots(spark, sf_dir)
    n = s.join(keywords(spark, sf_dir).select("snapshot_id"), "snapshot_id").groupBy("mode").agg(F.count("*").alias("n"))
    manual = s.where("weight > 400000").groupBy("mode").agg(F.count_distinct("owner_id").alias("manual"))
    limit = F.least(F.lit(60), F.greatest(F.lit(20), F.coalesce("manual", F.lit(0)) + 10))
    rows = n.join(manual, "mode", "left").withColumn("ranking_limit", limit)
    return rows.select("mode", F.col("ranking_limit").cast("int").alias("ranking_limit"), F.least(F.greatest(F.col("ranking_limit") * 3, F.lit(40)), F.greatest("n", "ranking_limit")).alias("candidate_limit"))


@R.query(f"""{DAYS_SQL} SELECT mode, keyword_id, CASE WHEN rank <= 10 THEN 'detail' ELSE 'rest' END AS part FROM r""")
def detail_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of a snapshot get details, the rest are listed."""
    return ranked_day(spark, sf_dir).select("mode", "keyword_id", F.when(F.col("rank") <= 10, "detail").otherwise("rest").alias("part"))


@R.query(f"""WITH p AS (SELECT doc_id, source, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '([a-z])(\\d)', '\\1 \\2', 'g'), '[_\\-·/@:]+', ' ', 'g'), '[“”"''`~!#$%^&*()+=\\[\\]{{}}|\\\\;<>?,.]', ' ', 'g'), '\\s+', ' ', 'g')) AS x FROM documents),
m AS (SELECT doc_id, x, (contains(x, 'mit')::INT + contains(x, 'license')::INT) / 2.0 AS r FROM p)
SELECT doc_id, 'MIT License' AS keyword FROM m WHERE least(1.0, round(CASE WHEN contains(x, 'mit license') THEN 0.62 ELSE 0 END + CASE WHEN r >= 0.5 THEN 0.28 * r + 0.18 * r ELSE 0 END, 4)) >= 0.45 UNION ALL SELECT doc_id, 'License' FROM documents""")
def relevant_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of two keywords: one of several words keeps what fits well enough, one of a single word keeps all."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = d.select("doc_id", "text", F.explode(F.array(F.lit("MIT License"), F.lit("License"))).alias("keyword"))
    words = F.size(F.filter(tx.tokens(tx.source_surface(F.col("keyword"))), lambda w: (F.length(w) >= 2) & (w != "ai")))
    quality = sc.source_quality(F.col("keyword"), F.col("text"), F.col("text"), F.lit(""), F.lit("none"))
    return rows.where((words <= 1) | (quality >= 0.45)).select("doc_id", "keyword")


@R.query("""WITH r AS (SELECT user_id, list_distinct(list_filter(list_transform(list(event_type || '_' || CAST(json_extract_string(props, '$.k') AS VARCHAR) ORDER BY event_id), lambda x: trim(x)), lambda x: regexp_matches(x, '^[a-z0-9_]{1,64}$'))) AS ids, min(event_id) AS first FROM events GROUP BY 1)
SELECT user_id, CAST(least(20, len(ids)) AS INTEGER) AS n_ids FROM r""")
def requested_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid, different ids of each viewer's request, twenty at most."""
    e = table(spark, sf_dir, "events").select("user_id", F.trim(F.concat("event_type", F.lit("_"), F.get_json_object("props", "$.k"))).alias("id"))
    valid = e.where(F.col("id").rlike("^[a-z0-9_]{1,64}$")).distinct()
    n = valid.groupBy("user_id").agg(F.count("*").alias("n"))
    return e.select("user_id").distinct().join(n, "user_id", "left").select("user_id", F.least(F.lit(20), F.coalesce("n", F.lit(0))).cast("int").alias("n_ids"))


_FAILS = "CASE WHEN event_type = 'purchase' THEN 24 * 3600 WHEN event_type = 'click' THEN 15 * 60 ELSE 0 END"


@R.query(f"""WITH e AS (SELECT event_id, user_id % 50 AS api_key, epoch(ts) AS t, {_FAILS} AS cool FROM events), w AS (SELECT *, max(CASE WHEN cool > 0 THEN struct_pack(t := t, i := event_id, u := t + cool) END) OVER (PARTITION BY api_key ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM e)
SELECT api_key, CAST(count(*) FILTER (WHERE last IS NULL OR t >= last.u) AS BIGINT) AS available, CAST(count(*) FILTER (WHERE t < last.u) AS BIGINT) AS cooling FROM w GROUP BY 1""")
def key_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each key was available: after a rate limit it rests 15 minutes, after a used-up quota 24 hours; the last failure counts."""
    cool = F.when(F.col("event_type") == "purchase", 24 * 3600).when(F.col("event_type") == "click", 15 * 60).otherwise(0)
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 50).alias("api_key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), (cool.cast("long") * 1_000_000).alias("cool"))
    w = Window.partitionBy("api_key").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    until = F.last(F.when(F.col("cool") > 0, F.col("t") + F.col("cool")), ignorenulls=True).over(w)
    rows = e.withColumn("until", until)
    return rows.groupBy("api_key").agg(F.count_if(F.col("until").isNull() | (F.col("t") >= F.col("until"))).alias("available"), F.count_if(F.col("t") < F.col("until")).alias("cooling"))


@R.query("""WITH d AS (SELECT doc_id, source || '/' || doc_id AS link, 'Title ' || doc_id AS title FROM documents), e AS (SELECT doc_id, max(quality) AS score, max(toxic) AS toxic FROM labels GROUP BY 1)
SELECT d.doc_id, e.score, CASE WHEN d.doc_id % 3 = 0 THEN 'exact' WHEN d.doc_id % 3 = 1 THEN 'folded' END AS matched FROM d LEFT JOIN e USING (doc_id)""")
def joined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model scores joined by link; summaries joined to articles by title, as it stands or else but for case and blanks."""
    k = F.col("doc_id")
    link = F.concat("source", F.lit("/"), k.cast("string"))
    d = table(spark, sf_dir, "documents").select("doc_id", link.alias("link"), F.concat(F.lit("Title "), k.cast("string")).alias("title"))
    evaluations = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("score")).join(d.select("doc_id", "link"), "doc_id").select("link", "score")
    written = F.when(k % 3 == 0, F.col("title")).when(k % 3 == 1, F.concat(F.lit("  "), F.upper("title"))).otherwise(F.concat("title", F.lit("?")))
    summaries = d.select(written.alias("summary"))
    exact = summaries.select(F.col("summary").alias("title"), F.lit("exact").alias("by_title"))
    folded = summaries.select(F.lower(F.trim("summary")).alias("low"), F.lit("folded").alias("by_low"))
    rows = d.join(evaluations, "link", "left").join(exact, "title", "left").withColumn("low", F.lower(F.trim("title"))).join(folded, "low", "left")
    return rows.select("doc_id", "score", F.coalesce("by_title", "by_low").alias("matched"))


@R.query(r"""SELECT item_id, 'Found ' || item_id || ' & "more"' AS title, 'https://n' || (item_id % 7) || '.example.org/' || item_id AS url, 'n' || (item_id % 7) || '.example.org' AS domain, CASE WHEN item_id % 2 = 0 THEN TIMESTAMP '2024-01-05 00:00:00' END AS published_at FROM benchmark""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a regional search: markup off, references decoded, dates of two forms, results without a link left out."""
    from trendspan.sources.mappers import regional_results

    n = F.col("item_id").cast("string")
    url = F.concat(F.lit("https://www.n"), (F.col("item_id") % 7).cast("string"), F.lit(".example.org/"), n)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("Found <b>"), n, F.lit("</b> &amp;  &quot;more&quot;")).alias("title"), F.replace(url, F.lit("www."), F.lit("")).alias("originallink"), F.lit("").alias("link"), F.col("text").alias("description"), F.lit(None).cast("string").alias("pub_date"), F.when(F.col("item_id") % 2 == 0, "20240105").otherwise("soon").alias("postdate"))
    none = rows.withColumns({"originallink": F.lit(None).cast("string"), "link": F.lit(None).cast("string")})
    return regional_results(rows.unionByName(none), "news").select("item_id", "title", "url", "domain", "published_at")
