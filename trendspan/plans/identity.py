"""Queries of keyword identity: ids carried over between snapshots, manual keywords put first, heads that need a companion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.functions import text as tx
from trendspan.operators import consolidation as co
from trendspan.operators import identity as idt
from trendspan.operators import ranking as rk
from trendspan.plans.registry import Registry
from trendspan.plans.texts import surface_sql
from trendspan.sources.tables import ITEMS_SQL, items, keywords, names, table

R = Registry()


def _aliased(df: DataFrame) -> DataFrame:
    """A part's names: its own, its brand and size, its type and size."""
    return df.withColumn("aliases", F.array(F.concat_ws(" ", "family", "size"), F.concat_ws(" ", "alias", "size")))


@R.query("""WITH RECURSIVE known AS (SELECT unnest([p_name, p_brand || ' ' || p_size, p_type || ' ' || p_size]) AS alias, 'k' || (3 * l_partkey) AS id, l_shipdate AS seen FROM lineitem JOIN part ON p_partkey = l_partkey),
newest AS (SELECT key, arg_max(id, (seen, id)) AS id FROM (SELECT unnest([lower(alias), replace(lower(alias), ' ', '')]) AS key, id, seen FROM known) GROUP BY 1),
w AS (SELECT p_partkey AS position, unnest([p_name, p_brand || ' ' || p_size, p_type || ' ' || p_size]) AS alias, unnest([0, 2, 4]) AS pos FROM part),
k AS (SELECT position, unnest([lower(alias), replace(lower(alias), ' ', '')]) AS key, pos + unnest([0, 1]) AS pos FROM w),
ids AS (SELECT position, list(id ORDER BY pos) AS ids FROM k JOIN newest USING (key) WHERE id NOT IN (SELECT 'k' || p_partkey FROM part) GROUP BY 1),
n AS MATERIALIZED (SELECT row_number() OVER (ORDER BY position) AS i, position, ids FROM ids),
f AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, NULL::BIGINT AS position, NULL::VARCHAR AS id UNION ALL
 SELECT i, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END, position, id FROM (SELECT n.i, used, n.position, list_filter(n.ids, lambda x: NOT list_contains(used, x))[1] AS id FROM f JOIN n ON n.i = f.i + 1))
SELECT 'k' || p_partkey AS own_id, coalesce(f.id, 'k' || p_partkey) AS canonical_id FROM part LEFT JOIN f ON f.position = p_partkey""")
def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part's id, or the one that its names had in the newest snapshots, which none before it took."""
    parts = _aliased(names(spark, sf_dir))
    # Of a part's lines only the newest decides, so they are added up before they get the part's names.
    newest = keywords(spark, sf_dir).groupBy("keyword_id").agg(F.max("seen_at").alias("seen_at"))
    seen = newest.join(parts, "keyword_id")
    every = F.concat(F.array("keyword"), "aliases")
    history = seen.select(F.explode(every).alias("alias"), F.concat(F.lit("k"), 3 * F.col("keyword_id")).alias("canonical_id"), F.col("seen_at").alias("created_at"))
    today = parts.select(F.col("keyword_id").alias("position"), F.concat(F.lit("k"), "keyword_id").alias("own_id"), "keyword", "aliases")
    return idt.canonical_ids(today, history)


@R.query("""WITH RECURSIVE r AS (SELECT p_partkey AS rank, p_brand || p_size AS keyword_id, p_name AS keyword, p_retailprice AS total, p_retailprice / 10 AS internal, list_distinct([lower(p_name), lower(p_brand || ' ' || p_size)]) AS keys FROM part),
m AS (SELECT key, arg_min(keyword, position) AS keyword, min(position) AS position FROM (SELECT 2 * n_nationkey AS position, n_name AS keyword, lower(n_name) AS key FROM nation UNION ALL
 SELECT 2 * s_suppkey + 1, 'Brand#' || (s_suppkey % 25) || '  ' || s_nationkey, lower('Brand#' || (s_suppkey % 25) || ' ' || s_nationkey) FROM supplier) GROUP BY 1),
rk AS (SELECT rank, keyword_id, unnest(keys) AS key FROM r), hit AS (SELECT rank, keyword_id, key, position FROM rk JOIN m USING (key)),
manual AS (SELECT rank, list(key) AS manual FROM hit GROUP BY 1), best AS (SELECT key, min(rank) AS rank FROM hit GROUP BY 1),
ask AS (SELECT 0 AS part, position AS place, 'id ' || r.keyword_id AS id, coalesce(manual, []) AS manual, r.rank, NULL::VARCHAR AS fresh FROM best JOIN m USING (key) JOIN r USING (rank) LEFT JOIN manual USING (rank)
 UNION ALL SELECT 0, position, 'id manual ' || key, [key], NULL, regexp_replace(keyword, ' +', ' ', 'g') FROM m WHERE key NOT IN (SELECT key FROM best)
 UNION ALL SELECT 1, rank, 'id ' || keyword_id, coalesce(manual, []), rank, NULL FROM r LEFT JOIN manual USING (rank)),
n AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY part, place) AS i FROM ask),
f AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS used, false AS got UNION ALL
 SELECT n.i, CASE WHEN list_has_any(used, list_append(n.manual, n.id)) THEN used ELSE list_concat(used, list_append(n.manual, n.id)) END, NOT list_has_any(used, list_append(n.manual, n.id)) FROM f JOIN n ON n.i = f.i + 1)
SELECT CAST(n.part AS INTEGER) AS part, CAST(n.place AS BIGINT) AS "order", coalesce(n.fresh, r.keyword) AS keyword, CASE WHEN n.fresh IS NOT NULL THEN 3.0 WHEN len(n.manual) > 0 THEN round(r.internal + 3, 4) ELSE r.internal END AS internal,
 CASE WHEN n.fresh IS NOT NULL THEN 16.0 WHEN len(n.manual) > 0 THEN round(r.total + 6, 4) ELSE r.total END AS total, len(n.manual) > 0 AS is_manual, n.fresh IS NOT NULL AS inserted FROM f JOIN n USING (i) LEFT JOIN r ON r.rank = n.rank WHERE f.got""")
def manual_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts in the order of their keys, behind those that nations and suppliers name; a brand and size is an id."""
    p = names(spark, sf_dir)
    ranked = p.select(
        F.col("keyword_id").alias("rank"), F.concat("family", "size").alias("keyword_id"), "keyword", F.array(F.concat_ws(" ", "family", "size")).alias("aliases"), (F.col("price") / 10).alias("internal"), F.col("price").alias("total")
    )
    s = table(spark, sf_dir, "supplier")
    brands = s.select((2 * F.col("s_suppkey") + 1).alias("position"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 25, F.lit("  "), "s_nationkey").alias("keyword"))
    nations = table(spark, sf_dir, "nation").select((2 * F.col("n_nationkey")).cast("long").alias("position"), F.col("n_name").alias("keyword"))
    out = idt.manual_priority(ranked, nations.unionByName(brands), "realtime")
    return out.select("place.part", "place.order", "keyword", "internal", "total", "is_manual", "inserted")


#: Rare words stand for keywords: those of one letter in ten name a mode, which says nothing by itself; some others name a mode as well.
_MODES = """words AS (SELECT DISTINCT doc_id AS item_idx, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
rare AS (SELECT w FROM words WHERE length(w) BETWEEN 7 AND 9 GROUP BY 1 HAVING count(*) BETWEEN 2 AND 6),
k AS (SELECT w AS keyword_id, CASE WHEN ascii(w) % 20 = 0 THEN 'mode' WHEN ascii(w) % 10 = 0 THEN w || 'mode' WHEN ascii(w) % 7 = 0 THEN w || ' mode' ELSE w END AS keyword, [w] AS aliases, ascii(w) % 10 = 0 AS dependent FROM rare)"""


def rare_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Keywords made of rare words, and the items that hold each."""
    words = items(spark, sf_dir).select("item_idx", "domain", "published_at", "tier", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("body"), F.lit("[a-z]+"), 0))).alias("keyword_id"))
    rare = words.where(F.length("keyword_id").between(7, 9)).groupBy("keyword_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, 6)).select("keyword_id")
    w, code = F.col("keyword_id"), F.ascii("keyword_id")
    text = F.when(code % 20 == 0, F.lit("mode")).when(code % 10 == 0, F.concat(w, F.lit("mode"))).when(code % 7 == 0, F.concat(w, F.lit(" mode"))).otherwise(w)
    return rare.select("keyword_id", text.alias("keyword"), F.array(w).alias("aliases")), words.join(rare, "keyword_id", "left_semi")


_ANCHORS = f"len(list_filter(string_split(s, ' '), lambda t: length(t) >= 2 AND NOT list_contains({[*tx.FUNCTION_WORDS, *tx.STOP_WORDS]!r}, t) AND NOT (list_contains({tx.CONTEXT_HEAD_HINTS!r}, t) OR regexp_matches(t, '{tx.CONTEXT_HEAD_SUFFIX}')) AND regexp_matches(t, '[a-z0-9]')))"


@R.query(f"""WITH {ITEMS_SQL}, {_MODES}, b AS (SELECT words.w AS keyword_id, item_idx, domain, published_at, tier FROM words JOIN rare USING (w) JOIN items USING (item_idx)),
s AS (SELECT *, {surface_sql('keyword')} AS s FROM k), e AS (SELECT *, {_ANCHORS} AS anchors FROM s),
c AS (SELECT keyword_id, count(*) AS n, count(DISTINCT domain) AS domains, bool_or(tier = 'P0_CURATED') AS curated FROM b GROUP BY 1),
o AS (SELECT x.keyword_id AS head, y.keyword_id AS companion, count(*) AS shared FROM b x JOIN e h ON h.keyword_id = x.keyword_id AND h.dependent JOIN b y USING (item_idx) JOIN e g ON g.keyword_id = y.keyword_id AND NOT g.dependent AND g.anchors > 0 WHERE g.keyword <> h.keyword GROUP BY 1, 2),
z AS (SELECT head, companion, shared, h.n, shared / (h.n + g.n - shared) AS overlap, shared / (h.n + g.n - shared) * 100 + shared * 8 + least(g.domains, 8) * 2 + least(e.anchors, 5) * 3 + CASE WHEN g.curated THEN 4 ELSE 0 END AS score
 FROM o JOIN c h ON h.keyword_id = head JOIN c g ON g.keyword_id = companion JOIN e ON e.keyword_id = companion),
best AS (SELECT head, companion FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY round(score, 9) DESC, companion) AS r FROM z WHERE shared >= greatest(1, least(2, n)) AND overlap >= CASE WHEN n <= 2 THEN 0.35 ELSE 0.45 END) WHERE r = 1),
out AS (SELECT 0 AS part, keyword_id AS place, keyword, aliases AS names, [keyword_id] AS ids FROM e WHERE NOT dependent
 UNION ALL SELECT 1, h.keyword_id, CASE WHEN contains(g.s, h.s) THEN g.keyword WHEN contains(h.s, g.s) THEN h.keyword ELSE g.keyword || ' ' || h.keyword END,
  CASE WHEN contains(g.s, h.s) THEN list_concat(g.aliases, [h.keyword], h.aliases) ELSE list_concat(g.aliases, h.aliases, [h.keyword]) END, [companion, head] FROM best JOIN e h ON h.keyword_id = head JOIN e g ON g.keyword_id = companion
 UNION ALL SELECT 1, keyword_id, keyword, aliases, [keyword_id] FROM e JOIN c USING (keyword_id) WHERE dependent AND keyword_id NOT IN (SELECT head FROM best) AND n >= 4 AND domains >= 3),
first AS (SELECT lower(keyword) AS key, arg_min(keyword, (part, place)) AS keyword FROM out GROUP BY 1),
al AS (SELECT key, string_agg(a, '|' ORDER BY part, place, pos) AS aliases FROM (SELECT *, row_number() OVER (PARTITION BY key, a ORDER BY part, place, pos) AS r FROM (SELECT lower(keyword) AS key, part, place, unnest(names) AS a, unnest(range(len(names))) AS pos FROM out)) WHERE r = 1 GROUP BY 1),
src AS (SELECT DISTINCT lower(keyword) AS key, unnest(ids) AS keyword_id FROM out),
many AS (SELECT lower(keyword) AS key, sum(len(ids)) > 1 AS merged FROM out GROUP BY 1),
agg AS (SELECT key, count(DISTINCT item_idx) AS matches, count(DISTINCT domain) AS domains, max(published_at) AS latest_at, min(CASE tier WHEN 'P0_CURATED' THEN 0 WHEN 'P1_CONTEXT' THEN 1 WHEN 'P2_RAW' THEN 2 ELSE 3 END) AS t FROM src JOIN b USING (keyword_id) GROUP BY 1)
SELECT first.keyword, aliases, matches, domains, latest_at, CASE WHEN t = 0 THEN 'P0_CURATED' WHEN t = 1 THEN 'P1_CONTEXT' ELSE 'P2_RAW' END AS tier FROM first JOIN al USING (key) JOIN agg USING (key) JOIN many USING (key)""")
def context_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords once those that say nothing by themselves are joined to their best companion."""
    found, bridge = rare_words(spark, sf_dir)
    rk.checkpoint_dir(spark)
    bridge = bridge.checkpoint()  # read six times below
    return co.enrich_context(found.withColumn("position", F.col("keyword_id")), bridge).withColumn("aliases", F.array_join("aliases", "|"))
