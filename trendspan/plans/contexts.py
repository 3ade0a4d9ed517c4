"""Queries over longer texts: readmes, providers' changelogs, what a summary is told about a keyword."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.functions import elements as el
from trendspan.operators import budgets as bd
from trendspan.operators import changelogs as cl
from trendspan.operators import localize as lc
from trendspan.plans.registry import Registry
from trendspan.sources.tables import AS_OF_ITEMS, ITEMS_SQL, items, names, table

R = Registry()

#: Words of documents, so that marks of markdown and HTML are those that the query puts in.
_PLAIN = "trim(regexp_replace(regexp_replace(text, '[^A-Za-z \\n]', '', 'g'), '[ ]+', ' ', 'g'))"


def _plain(text: str) -> F.Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z \n]", ""), "[ ]+", " "))


@R.query(f"SELECT doc_id, trim(regexp_replace('Title ' || doc_id || chr(10) || chr(10) || 'see docs, bold and  here.' || chr(10) || chr(10) || 'item' || chr(10) || chr(10) || chr(10) || {_PLAIN}, '^\\s+|\\s+$', '', 'g'), chr(10) || ' ') AS text FROM documents")
def readme_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readmes as text: without code blocks, inline code, pictures and marks."""
    head = F.concat(F.lit("# Title "), F.col("doc_id").cast("string"), F.lit("\n\nsee [docs](https://x), **bold** and `code` here.\n\n![shot](a.png)- item\n```py\nx = 1\n```\n\n"))
    text = F.regexp_replace(F.concat(head, _plain("text")), r"!\[shot\]\(a.png\)- ", "- ![shot](a.png)")
    return table(spark, sf_dir, "documents").select("doc_id", el.readme_text(text).alias("text"))


#: Every document is a page of a provider: an entry of some days ago with a launch, one with the document's words, one of last year's end.
_LINES = f"list_filter(list_transform(string_split({_PLAIN}, chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '')"


@R.query(f"""WITH d AS (SELECT doc_id, {_LINES} AS ls FROM documents),
w AS (SELECT doc_id, list_transform(range(len(ls)), lambda i: CASE WHEN i = 0 OR len(array_to_string(ls[1:i], ' ')) <= 1200 - length('New models for agents are here.') - 1 THEN ls[i + 1] END) AS ks FROM d),
b AS (SELECT doc_id, array_to_string(list_filter(ks, lambda x: x IS NOT NULL), ' ') AS body FROM w)
SELECT doc_id, 'January ' || (30 - doc_id % 2) AS heading, TIMESTAMP '2024-01-30' - to_days(CAST(doc_id % 2 AS INTEGER)) AS published_at, 'We launched Model ' || doc_id || ' mini (beta), which is fast.' AS body FROM b
UNION ALL SELECT doc_id, 'December 25', TIMESTAMP '2023-12-25', trim('New models for agents are here. ' || body) FROM b""")
def changelog_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dated entries of every page, with their dates; long bodies end with the line that makes them too long."""
    found = cl.entries(_changelogs(spark, sf_dir), ["doc_id"])
    day = cl.provider_date(F.col("heading"), F.lit(AS_OF_ITEMS).cast("timestamp_ntz")).cast("timestamp_ntz")
    return found.select("doc_id", "heading", day.alias("published_at"), "body")


def _changelogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    lines = F.array_join(F.transform(F.split(_plain("text"), "\n"), lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "")
    launch = F.concat(F.lit("<h2>January "), (30 - k % 2).cast("string"), F.lit("</h2><ul><li>We launched <b>Model "), k.cast("string"), F.lit("</b>\n mini (beta), which is fast.</li></ul><script>var x = 1</script>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(launch, F.lit("<h2>December 25</h2><div>New models for agents are here.</div>"), lines).alias("html"))


@R.query("SELECT doc_id, 'Acme: Model ' || doc_id || ' mini' AS title, TIMESTAMP '2024-01-30' - to_days(CAST(doc_id % 2 AS INTEGER)) AS published_at, 'launched Model ' || doc_id || ' mini (beta), which is fast.' AS summary FROM documents")
def changelog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What providers' changelogs launched in the window, each title once a page; what stands before an action goes."""
    pages = _changelogs(spark, sf_dir).withColumn("provider", F.lit("Acme"))
    return cl.release_items(pages, ["doc_id", "provider"], AS_OF_ITEMS).select("doc_id", "title", "published_at", "summary")


_TOLD = "'- [TRIGGER] [' || strftime(published_at, '%Y-%m-%d') || '] ' || title || ' (' || domain || '): ' || substr(summary, 1, 200)"


@R.query(f"""WITH {ITEMS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY item_idx) AS n, row_number() OVER (PARTITION BY domain ORDER BY item_idx DESC) AS m, sum(length(body)) OVER (PARTITION BY domain ORDER BY item_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent FROM items WHERE body IS NOT NULL),
t AS (SELECT domain, string_agg({_TOLD}, chr(10) ORDER BY item_idx) FILTER (WHERE title <> '') AS t FROM r WHERE n <= 5 GROUP BY 1),
b AS (SELECT domain, string_agg('- [BACKGROUND] ' || title || ': ' || summary, chr(10) ORDER BY item_idx DESC) AS b FROM r WHERE m <= 5 GROUP BY 1),
f AS (SELECT domain, string_agg('(domain: ' || domain || ')' || chr(10) || substr(body, 1, CAST(8000 - coalesce(spent, 0) AS BIGINT)), chr(10) || chr(10) ORDER BY item_idx) AS f FROM r WHERE coalesce(spent, 0) < 8000 GROUP BY 1),
k AS (SELECT domain, count(*) AS n, max(published_at) AS latest FROM r GROUP BY 1)
SELECT domain AS keyword_id, sha256('Keyword: "' || domain || '"' || chr(10) || 'Ranking signals: ' || CASE WHEN n % 2 = 0 THEN 'first appearance on the ranking today' ELSE 'already on the ranking before today' END || '; ' || n || ' trigger article(s) matched; latest trigger article: ' || strftime(latest, '%Y-%m-%d') || '.'
 || chr(10) || chr(10) || 'Context:' || chr(10) || concat_ws(chr(10), t, b) || chr(10) || chr(10) || '[full texts; where they differ from snippets they count]' || chr(10) || f) AS message FROM k JOIN t USING (domain) JOIN b USING (domain) JOIN f USING (domain)""")
def summary_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a summary of each domain is told: its first items, its last ones, and full texts up to the budget."""
    i = items(spark, sf_dir).where("body is not null").withColumn("keyword_id", F.col("domain"))
    keys = i.groupBy("keyword_id").agg(F.count("*").alias("matched"), F.max("published_at").alias("latest"))
    keys = keys.select("keyword_id", F.col("keyword_id").alias("keyword"), (F.col("matched") % 2 == 0).alias("is_new"), "matched", "latest")
    triggers = i.select("keyword_id", F.col("item_idx").alias("place"), "title", F.col("summary").alias("snippet"), "published_at", "domain")
    backgrounds = i.select("keyword_id", (-F.col("item_idx")).alias("place"), "title", F.col("summary").alias("snippet"), F.lit(None).cast("timestamp_ntz").alias("published_at"))
    texts = i.select("keyword_id", F.col("item_idx").alias("place"), "domain", F.col("body").alias("text"))
    return bd.contexts(keys, triggers, backgrounds, texts).select("keyword_id", F.sha2("message", 256).alias("message"))


#: What some words of parts are called; colours and sizes have forms of their own only in some names.
SAID = {"red": "빨간", "blue": "파란", "hot": "뜨거운", "ring": "고리", "bolt": "볼트", "gear": "기어"}
NATURAL = {"Red Widget": "레드 위젯", "hot ring": "핫링"}
_PAIRS = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in d.items())


@R.query(f"""WITH said AS (SELECT * FROM (VALUES {_PAIRS(SAID)}) t(word, localized)), nat AS (SELECT lower(form) AS low, localized FROM (VALUES {_PAIRS(NATURAL)}) t(form, localized)),
k AS (SELECT p_partkey AS keyword_id, CASE WHEN p_partkey % 7 = 0 THEN p_name || ' 모델' WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS keyword FROM part),
w AS (SELECT keyword_id, unnest(string_split(lower(keyword), ' ')) AS word, unnest(range(len(string_split(keyword, ' ')))) AS at_ FROM k),
c AS (SELECT keyword_id, string_agg(localized, ' ' ORDER BY at_) AS said FROM w LEFT JOIN said USING (word) GROUP BY 1 HAVING count(*) = count(localized)),
a AS (SELECT k.*, nat.localized, c.said, CASE WHEN regexp_matches(keyword, '[가-힣]') THEN 'keep' WHEN nat.localized IS NOT NULL THEN 'natural' WHEN c.said IS NOT NULL THEN 'translate' ELSE 'keep' END AS action FROM k LEFT JOIN nat ON nat.low = lower(keyword) LEFT JOIN c USING (keyword_id))
SELECT keyword_id, keyword, action, CASE action WHEN 'natural' THEN localized WHEN 'translate' THEN said ELSE keyword END AS localized FROM a""")
def keyword_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How parts' names are shown: kept, under a form of their own, or put word by word."""
    k = F.col("keyword_id")
    text = F.when(k % 7 == 0, F.concat("keyword", F.lit(" 모델"))).when(k % 5 == 0, F.upper("keyword")).otherwise(F.col("keyword"))
    natural = spark.createDataFrame(list(NATURAL.items()), "form string, localized string")
    concepts = spark.createDataFrame(list(SAID.items()), "word string, localized string")
    return lc.classify(names(spark, sf_dir).select("keyword_id", text.alias("keyword")), natural, concepts)


@R.query("""WITH r AS (SELECT item_id // 20 AS batch, item_id AS position, CASE WHEN item_id % 4 = 0 THEN '제목 ' ELSE '' END || trim(substring(regexp_replace(text, '[^A-Za-z]+', ' ', 'g'), 1, 30 + item_id % 50)) AS title FROM benchmark),
t AS (SELECT *, CASE WHEN position % 4 = 0 THEN 'en' ELSE 'ko' END AS target FROM r WHERE title <> ''),
c AS (SELECT *, CAST(floor(coalesce(sum(length(title)) OVER (PARTITION BY batch, target ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4 / sum(length(title)) OVER (PARTITION BY batch, target)) AS INTEGER) AS call FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY batch, target, call ORDER BY position) AS place, count(*) OVER (PARTITION BY batch, target, call) AS n FROM c)
SELECT batch, position, target, call, CASE WHEN call = 3 OR (call = 2 AND place = n) THEN title ELSE upper(title) END AS localized FROM p""")
def title_localization(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in four calls a language; of the third call's answers the last line is missing, the fourth one has none."""
    k = F.col("item_id")
    text = F.trim(F.expr("substring(regexp_replace(text, '[^A-Za-z]+', ' '), 1, cast(30 + item_id % 50 as int))"))
    titles = table(spark, sf_dir, "benchmark").select(F.floor(k / 20).alias("batch"), k.alias("position"), F.concat(F.when(k % 4 == 0, "제목 ").otherwise(""), text).alias("title"))
    calls = lc.title_calls(titles)
    said = lc.prompts(calls).where("call < 3").withColumn("reply", F.upper("lines"))
    replies = said.withColumn("reply", F.when(F.col("call") == 2, F.array_join(F.slice(F.split("reply", "\n"), F.lit(1), (F.col("n") - 1).cast("int")), "\n")).otherwise(F.col("reply")))
    return lc.joined_answers(calls, replies).join(calls.select("batch", "position", "target", "call"), ["batch", "position"]).select("batch", "position", "target", "call", "localized")
