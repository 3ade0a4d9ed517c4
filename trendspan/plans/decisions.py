"""Queries of decisions and of the small functions around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.functions import scoring as sc
from trendspan.functions import text as tx
from trendspan.functions import times as tm
from trendspan.functions import urls as ur
from trendspan.operators import decisions as dc
from trendspan.operators import ranking as rk
from trendspan.operators import sinks
from trendspan.plans import ranking as rp
from trendspan.plans.registry import Registry
from trendspan.sources import mappers as mp
from trendspan.sources.tables import items, names, table

R = Registry()


@R.query(f"""{rp.BRIDGE_SQL}, r AS (SELECT keyword_id, item_idx, domain, row_number() OVER (PARTITION BY keyword_id ORDER BY item_idx) AS n FROM bridge JOIN items USING (item_idx))
SELECT keyword_id, string_agg(item_idx || ':' || domain, ',' ORDER BY item_idx) AS sources FROM r WHERE n <= 5 GROUP BY 1""")
def quality_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sources that a keyword's quality decision looks at."""
    bridge = rk.match_bridge(items(spark, sf_dir), rp.catalogue(spark), ["domain"])
    listed = F.transform("sources", lambda s: F.concat(s["item_idx"].cast("string"), F.lit(":"), s["domain"]))
    return dc.first_sources(bridge, ["domain"]).select("keyword_id", F.array_join(listed, ",").alias("sources"))


_QUALITY = rp.R.oracles["quality_delta"]


@R.query(f"""WITH q AS ({_QUALITY}), c AS (SELECT q.keyword_id, q.quality, p_retailprice AS total, p_partkey + 1 AS rank, p_partkey % 9 = 0 AS is_manual FROM q JOIN part ON p_partkey = q.keyword_id),
a AS (SELECT *, CASE WHEN is_manual THEN 0.0 ELSE quality END AS applied FROM c)
SELECT keyword_id, quality AS raw_delta, CAST(applied AS DOUBLE) AS applied_delta, CAST(round(total + applied, 4) AS DOUBLE) AS adjusted_total, CAST(row_number() OVER (ORDER BY round(total + applied, 4) DESC, rank) AS INTEGER) AS place, 0.0::DOUBLE AS shadow_delta, CAST(rank AS INTEGER) AS shadow_place FROM a""")
def quality_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality deltas in force and in the shadow; manual keywords keep their totals."""
    p = names(spark, sf_dir).select("keyword_id", F.col("price").alias("total"), (F.col("keyword_id") + 1).alias("rank"), (F.col("keyword_id") % 9 == 0).alias("is_manual"))
    c = rp.quality_delta(spark, sf_dir).select("keyword_id", "quality").join(p, "keyword_id")
    shadow = dc.quality_decisions(c, True).select("keyword_id", F.col("applied_delta").alias("shadow_delta"), F.col("place").alias("shadow_place"))
    return dc.quality_decisions(c, False).join(shadow, "keyword_id").select("keyword_id", "raw_delta", "applied_delta", "adjusted_total", "place", "shadow_delta", "shadow_place")


@R.query(f"""{rp.SCORE_SQL}, d AS (SELECT *, CAST(substr(keyword_id, 2) AS INTEGER) AS n FROM scored)
SELECT keyword_id, CAST(round(total - (recency * 0.24 + frequency * 0.10 + authority * 0.14 + velocity * 0.30 + engagement * 0.22) + n, 3) AS DOUBLE) AS bonus,
nullif(concat_ws(', ', CASE WHEN n % 2 = 0 THEN 'policy' END, CASE WHEN n % 3 = 0 THEN 'stability' END, CASE WHEN n % 5 = 0 THEN CASE WHEN n > 5 THEN 'manual_insert' ELSE 'manual_boost' END END, CASE WHEN n % 4 = 0 THEN 'quality:repeat' END), '') AS reason FROM d""")
def candidate_debug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a total has beyond its axes, and which policies changed it."""
    n = F.substring("keyword_id", 2, 9).cast("int")
    delta = lambda k, v: F.when(n % k == 0, F.lit(v)).otherwise(F.lit(0.00001))
    reason = dc.internal_reason(delta(2, 0.1), delta(3, -0.2), F.when(n % 5 == 0, 6.0).otherwise(F.lit(float("nan"))), n > 5, F.when(n % 4 == 0, F.array(F.lit("repeat"))))
    bonus = kw.fixed_bonus(F.col("total") + n, {k: F.col(k) for k in sc.WEIGHTS})
    return rp.scored(spark, sf_dir).select("keyword_id", F.round(bonus, 3).alias("bonus"), reason.alias("reason"))


@R.query(f"""{rp.BRIDGE_SQL}, r AS (SELECT keyword_id, item_idx, domain, CASE tier WHEN 'P0_CURATED' THEN 0 WHEN 'P1_CONTEXT' THEN 1 WHEN 'P2_RAW' THEN 2 ELSE 3 END AS t, item_idx // 3 AS u FROM bridge JOIN items USING (item_idx)),
o AS (SELECT *, row_number() OVER (PARTITION BY keyword_id, u ORDER BY t, item_idx) AS n FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY keyword_id ORDER BY t, item_idx) AS place FROM o WHERE n = 1)
SELECT keyword_id, CAST(place AS INTEGER) AS place, item_idx, 'https://n.example.org/' || u || '?utm_source=' || item_idx AS link FROM p WHERE place <= 5""")
def event_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles that tell each keyword's event: the best tiers first, each URL once."""
    bridge = rk.match_bridge(items(spark, sf_dir), rp.catalogue(spark), ["tier"])
    link = F.concat(F.lit("https://n.example.org/"), F.floor(F.col("item_idx") / 3).cast("string"), F.lit("?utm_source="), F.col("item_idx").cast("string"))
    return dc.event_articles(bridge.withColumn("link", link), ()).select("keyword_id", "place", "item_idx", "link")


RULES = [(["License"], 2.0), (["stupid", "idiot"], 1.0), (["que", "der"], 0.8)]


@R.query("""WITH d AS (SELECT doc_id, lower(text) AS low, n_chars, source, length(text) AS n, len(string_split(text, chr(10))) AS lines, text FROM documents)
SELECT doc_id, CAST(round(greatest(0.0, (n_chars % 6) * 0.35 + (doc_id % 6) * 0.25 + ((n_chars + doc_id) % 6) * 0.25 + greatest(0.0, 5 * pow(0.5, (doc_id % 72) / 36.0) - CASE WHEN doc_id % 72 > 24 THEN 0.5 ELSE 0 END) * 0.15
 - CASE WHEN contains(low, 'license') THEN 2.0 ELSE 0 END - CASE WHEN contains(low, 'stupid') OR contains(low, 'idiot') THEN 1.0 ELSE 0 END - CASE WHEN contains(low, 'que') OR contains(low, 'der') THEN 0.8 ELSE 0 END), 4) AS DOUBLE) AS score,
CASE WHEN source = 'src3' THEN 'topic' WHEN n_chars % 6 <= 2 THEN 'impact' WHEN (n_chars + doc_id) % 6 <= 2 THEN 'proof' WHEN n < 200 THEN 'short'
 WHEN CAST(length(trim(coalesce(string_split(text, chr(10))[1], ''))) >= 15 AS INTEGER) + CAST(length(trim(coalesce(string_split(text, chr(10))[2], ''))) >= 15 AS INTEGER) + CAST(length(trim(coalesce(string_split(text, chr(10))[3], ''))) >= 15 AS INTEGER) < 2 THEN 'insights' END AS reason FROM d""")
def article_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article scores with three penalties, and why an article is dropped; a document's first lines are its insights."""
    d = table(spark, sf_dir, "documents")
    impact, novelty, proof = F.col("n_chars") % 6, F.col("doc_id") % 6, (F.col("n_chars") + F.col("doc_id")) % 6
    score = sc.article_score(impact, novelty, proof, F.col("doc_id") % 72, dc.penalties(F.lower("text"), RULES))
    insights = [F.get(F.split("text", "\n"), F.lit(k)) for k in range(3)]
    return d.select("doc_id", score.alias("score"), dc.drop_reason(F.col("source"), impact, proof, F.col("text"), insights, ["src3"]).alias("reason"))


@R.query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'A1 (株) ' || doc_id ELSE 'plain ' || doc_id END AS folded, CASE WHEN doc_id % 2 = 0 THEN '# Title ' || doc_id ELSE 'no  title' END AS plain,
 CASE WHEN doc_id % 2 = 0 THEN 'one|two ' || doc_id ELSE '' END AS numbered, 'example' || doc_id || '.com' AS host, CASE WHEN doc_id % 4 = 1 THEN false WHEN doc_id % 4 = 2 THEN false ELSE true END AS image_ok, 'https://x/' || doc_id || '.png' AS source_set,
 CASE WHEN doc_id % 3 = 0 THEN DATE '2023-12-25' WHEN doc_id % 3 = 1 THEN DATE '2024-02-06' ELSE DATE '2024-01-02' END AS day,
 CASE WHEN doc_id % 2 = 0 THEN '---' || chr(10) || 'tags: []' || chr(10) || 'title: x' || chr(10) || '---' ELSE '---' || chr(10) || 'tags:' || chr(10) || '  - a' || chr(10) || '---' END AS front FROM documents""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compatibility forms folded, emojis off headings, numbered lines, hosts, pictures, dates without a year, tags repaired."""
    k = F.col("doc_id")
    s = k.cast("string")
    wide = F.concat(F.when(k % 3 == 0, "Ａ１ ㈱ ").otherwise("plain "), s)
    heading = F.when(k % 2 == 0, F.concat(F.lit("#🚀Title "), s, F.lit("✨"))).otherwise("no 🎉 title")
    lines = F.when(k % 2 == 0, F.concat(F.lit("1. one\n2) two "), s, F.lit("\nrest"))).otherwise("rest")
    image = F.concat(F.when(k % 4 == 1, "ftp://a/").otherwise("https://a/"), s, F.when(k % 4 == 2, "-logo.png").otherwise(".jpg"))
    day = F.when(k % 3 == 0, "12-25").when(k % 3 == 1, "02-06").otherwise("01-02")
    front = F.when(k % 2 == 0, "---\ntags:\ntitle: x\n---").otherwise("---\ntags:\n  - a\n---")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.fold_compatibility(wide).alias("folded"),
        tx.remove_emojis(heading).alias("plain"),
        F.array_join(tx.numbered_lines(lines), "|").alias("numbered"),
        ur.normalize_host(F.concat(F.lit(" HTTPS://www.Example"), s, F.lit(".com:8080//"))).alias("host"),
        kw.valid_image(image).alias("image_ok"),
        kw.first_of_srcset(F.concat(F.lit(" https://x/"), s, F.lit(".png 1x, https://x/b.png 2x"))).alias("source_set"),
        tm.guess_year(day, F.lit("2024-01-31").cast("timestamp_ntz")).alias("day"),
        sinks.repair_tags(front).alias("front"),
    )


@R.query("""SELECT item_id, item_id % 30 AS sources FROM benchmark WHERE item_id % 2 = 0 AND item_id % 30 BETWEEN 7 AND 20 AND item_id % 5 <> 0""")
def podcast_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes that are ready, of enough sources, with audio that may be played."""
    k = F.col("item_id")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.when(k % 2 == 0, "ready").otherwise("draft").alias("status"), (k % 30).alias("source_count"), F.when(k % 5 != 0, "https://a/x.mp3").otherwise("http://a/x.mp3").alias("audio_url"))
    return mp.valid_episodes(rows).select("item_id", F.col("source_count").alias("sources"))


@R.query(f"""WITH k AS (SELECT p_partkey AS keyword_id, CASE WHEN p_partkey % 4 = 0 THEN '"' || p_name || '"' WHEN p_partkey % 4 = 1 THEN '"' || p_name || '"' WHEN p_partkey % 4 = 2 THEN string_split(p_name, ' ')[2] ELSE '"' || p_name || '"' END AS exact, CASE WHEN p_partkey % 3 = 0 THEN ' ' || p_type || ' ' || p_brand ELSE '' END AS terms, p_partkey % 3 AS r FROM part)
SELECT keyword_id, exact || terms || ' {kw.NEWS_WORDS}' AS news, exact || terms || ' {kw.SOCIAL_SITES}' AS social, exact || ' {kw.DATA_SITES}' AS data, exact || terms AS broad, TIMESTAMP '2024-01-31' - to_days(CASE r WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END) AS start FROM k""")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four searches for each part, and where their range starts."""
    k = F.col("keyword_id")
    text = F.when(k % 4 == 0, F.concat(F.lit('"'), "keyword", F.lit('"'))).when(k % 4 == 2, F.get(F.split("keyword", " "), F.lit(1))).otherwise(F.concat(F.lit(" "), "keyword"))
    terms = F.when(k % 3 == 0, F.array("alias", "family"))
    start = kw.range_start(F.lit("2024-01-31").cast("timestamp_ntz"), F.when(k % 3 == 0, "day").when(k % 3 == 1, "week").otherwise("month"))
    return names(spark, sf_dir).select("keyword_id", kw.search_queries(text, terms).alias("q"), start.alias("start")).select("keyword_id", "q.*", "start")


@R.query("""WITH d AS (SELECT doc_id, unnest(['why_it_matters', 'key_evidence', 'who_should_care', 'next_action', 'comparison']) AS f, unnest(['이 소식이 중요한 이유는 a' || doc_id || '.', '구체적 근거로 근거입니다.', '특히 c' || doc_id || '에게 직접적인 도움이 됩니다', '이후에는 d' || doc_id || '.', '경쟁 대비 차별점은 e' || doc_id || '.']) AS t, unnest([doc_id % 2 = 0, doc_id % 3 = 0, doc_id % 2 = 1, doc_id % 5 = 0, doc_id % 7 = 0]) AS there FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5(doc_id || '-' || f)) AS n FROM d WHERE there)
SELECT doc_id, chr(10) || string_agg(t, chr(10) ORDER BY n) || chr(10) AS lines FROM r WHERE n <= 3 GROUP BY 1""")
def insight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of each article's insights as sentences."""
    k = F.col("doc_id")
    s = k.cast("string")
    when = lambda ok, letter: F.when(ok, F.concat(F.lit(letter), s))
    insights = {"why_it_matters": F.when(k % 2 == 0, F.concat(F.lit("a"), s, F.lit("."))), "key_evidence": F.when(k % 3 == 0, "근거입니다."), "who_should_care": when(k % 2 == 1, "c"), "next_action": when(k % 5 == 0, "d"), "comparison": when(k % 7 == 0, "e")}
    return table(spark, sf_dir, "documents").select("doc_id", kw.insight_lines(insights, s).alias("lines")).where("lines <> ''")


@R.query("""WITH a AS (SELECT p_partkey AS query, unnest([0, 1, 2, 3]) AS place FROM part), k AS (SELECT *, (query * 7 + place * 3) % 5 AS c FROM a),
d AS (SELECT query, min(place) FILTER (WHERE c > 1 AND place < 3) AS place FROM k GROUP BY 1), o AS (SELECT d.query, k.c FROM d LEFT JOIN k USING (query, place))
SELECT query, CASE WHEN c = 4 THEN 'first' ELSE 'fallback' END AS provider, CASE WHEN c = 4 THEN 't' ELSE 'f' END || query AS title, 'n.example.org' AS domain FROM o WHERE c = 4 OR query % 3 <> 0""")
def pooled_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches over a pool of keys: spent and throttled ones pass on, a query without results falls back."""
    result = "array<struct<title:string,url:string,content:string,published_at:string>>"
    one = lambda letter, q: F.array(F.struct(F.concat(F.lit(letter), q.cast("string")).alias("title"), F.lit("https://www.n.example.org/x").alias("url"), F.lit("text").alias("content"), F.lit(None).cast("string").alias("published_at"))).cast(result)
    q = F.col("query")
    rows = names(spark, sf_dir).select(F.col("keyword_id").alias("query"), F.explode(F.array(*map(F.lit, range(4)))).alias("place"))
    c = (q * 7 + F.col("place") * 3) % 5
    status = F.when(c == 0, 429).when(c == 2, 500)
    message = F.when(c == 1, "Your plan quota is exceeded").when(c == 2, "broken").when(c == 0, "slow down")
    attempts = rows.select("query", "place", status.alias("status"), message.alias("message"), F.when(c == 3, F.array().cast(result)).otherwise(one("t", q)).alias("results"))
    fallback = names(spark, sf_dir).where("keyword_id % 3 <> 0").select(F.col("keyword_id").alias("query")).select("query", one("f", q).alias("results"))
    return mp.pooled_results(attempts, fallback, 3).select("query", "provider", "title", "domain")
