"""Decisions, answers and searches on small cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.operators import answers as an
from trendspan.operators import decisions as dc
from trendspan.sources import mappers as mp

NAN = float("nan")


def test_the_shadow_changes_nothing(spark):
    df = spark.createDataFrame([("a", 1, 1.0, -0.1, False), ("b", 2, 0.95, 0.0, False), ("c", 3, 0.9, -0.12, True)], "keyword_id string, rank int, total double, quality double, is_manual boolean")
    got = {r.keyword_id: (r.applied_delta, r.adjusted_total, r.place) for r in dc.quality_decisions(df, True).collect()}
    assert got == {"a": (0.0, 1.0, 1), "b": (0.0, 0.95, 2), "c": (0.0, 0.9, 3)}
    got = {r.keyword_id: (r.applied_delta, r.adjusted_total, r.place) for r in dc.quality_decisions(df, False).collect()}
    assert got == {"a": (-0.1, 0.9, 2), "b": (0.0, 0.95, 1), "c": (0.0, 0.9, 3)}


REASONS = [
    ((0.1, None, None, False, None), "policy"),
    ((0.0, -0.2, 6.0, True, ["x"]), "stability, manual_insert, quality:x"),
    ((NAN, 0.00001, 6.0, False, []), "manual_boost"),
    ((None, None, None, None, None), None),
]


@pytest.mark.parametrize(("deltas", "reason"), REASONS)
def test_reasons(spark, deltas, reason):
    df = spark.createDataFrame([deltas], "p double, s double, m double, i boolean, q array<string>")
    assert df.select(dc.internal_reason(*map(F.col, "psmiq"))).first()[0] == reason


def test_relevant_source_and_first_five(spark):
    rows = [("k", i, "Claude Code news" if i == 4 else "other", "d") for i in range(8)]
    first = dc.first_sources(spark.createDataFrame(rows, "keyword_id string, item_idx int, title string, domain string").withColumns({"snippet": F.lit(None).cast("string"), "url": F.lit("https://x")}), ["title", "snippet", "url", "domain"])
    row = first.select(F.transform("sources", lambda s: s["item_idx"]).alias("i"), dc.relevant_source(F.lit("Claude Code"), F.col("sources")).alias("r"), dc.relevant_source(F.lit("Unknown Thing"), F.col("sources")).alias("n")).first()
    assert (list(row.i), row.r, row.n) == ([0, 1, 2, 3, 4], True, False)


def test_articles_of_an_event(spark):
    rows = [("k", 1, "COMMUNITY", "https://a/x?utm_source=1"), ("k", 2, "P0_CURATED", "https://a/x"), ("k", 3, "P2_RAW", "https://a/y")] + [("k", 10 + i, "P1_CONTEXT", f"https://b/{i}") for i in range(6)]
    got = dc.event_articles(spark.createDataFrame(rows, "keyword_id string, item_idx int, tier string, link string"), ()).orderBy("place").collect()
    assert [r.item_idx for r in got] == [2, 10, 11, 12, 13]


DROPS = [(("bad", 5, 5, "s" * 300, "i" * 15, "i" * 15), "topic"), (("ok", 2, 5, "s" * 300, "i" * 15, "i" * 15), "impact"), (("ok", 3, None, "s" * 300, "", ""), "proof"), (("ok", 3, 3, None, "i" * 20, "i" * 20), "short"), (("ok", 3, 3, "s" * 200, "i" * 15, " " + "i" * 14), "insights"), (("ok", 3, 3, "s" * 200, "i" * 15, "i" * 15), None)]


@pytest.mark.parametrize(("row", "reason"), DROPS)
def test_drops(spark, row, reason):
    df = spark.createDataFrame([row], "t string, i int, p int, s string, a string, b string")
    assert df.select(dc.drop_reason(F.col("t"), F.col("i"), F.col("p"), F.col("s"), [F.col("a"), F.col("b")], ["bad"])).first()[0] == reason


FAILURES = [((None, None), None), ((429, "slow"), "rate_limit"), ((429, "Quota exceeded"), "quota"), ((500, "Too many requests"), "rate_limit"), ((500, "broken"), "other"), ((None, "not enough credits"), "quota")]


@pytest.mark.parametrize(("failure", "kind"), FAILURES)
def test_failures_of_searches(spark, failure, kind):
    assert spark.createDataFrame([failure], "s int, m string").select(mp.failure_kind(F.col("s"), F.col("m"))).first()[0] == kind


def test_searches_pass_on_stop_and_fall_back(spark):
    got = [("t", "https://www.x.org/1", "c" * 400, "2024")]
    attempts = [("a", 1, 429, None, []), ("a", 2, None, None, got), ("b", 1, 500, "broken", []), ("b", 2, None, None, got), ("c", 1, None, None, []), ("d", 1, 429, None, []), ("d", 2, 429, None, []), ("d", 3, 429, None, []), ("d", 4, None, None, got)]
    result = "array<struct<title:string,url:string,content:string,published_at:string>>"
    df = spark.createDataFrame(attempts, f"query string, place int, status int, message string, results {result}")
    fallback = spark.createDataFrame([(q, [("f", "https://y.org", None, None)]) for q in "abcd"], f"query string, results {result}")
    rows = mp.pooled_results(df, fallback).collect()
    assert sorted((r.query, r.provider, r.title, r.domain, len(r.snippet)) for r in rows) == [("a", "first", "t", "x.org", 120), ("b", "fallback", "f", "y.org", 0), ("c", "fallback", "f", "y.org", 0), ("d", "fallback", "f", "y.org", 0)]


def test_searches_are_dealt_out_by_query(spark):
    result = "array<struct<title:string,url:string,content:string,published_at:string>>"
    got = F.array(F.struct(F.lit("t").alias("title"), F.lit("https://x.org").alias("url"), F.lit("c").alias("content"), F.lit(None).cast("string").alias("published_at"))).cast(result)
    one = lambda ok, of: F.when(ok, of)
    k = F.col("id")
    df = spark.range(4000).select((k % 1000).alias("query"), F.floor(k / 1000).alias("place"), one(k % 3 == 0, F.lit(429)).alias("status"), F.lit(None).cast("string").alias("message"), one(k % 2 == 0, got).alias("results"))
    fallback = spark.range(500).select(k.alias("query"), got.alias("results"))
    found = mp.pooled_results(df, fallback, 2).select("query", "provider")
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    want = []
    for q in range(1000):
        first = next((i for i in (q, q + 1000) if i % 3), None)
        if first is not None and first % 2 == 0:
            want.append((q, "first"))
        elif q < 500:
            want.append((q, "fallback"))
    assert sorted(map(tuple, found.collect())) == want


def test_exact_queries(spark):
    for keyword, exact in ((" two words ", '"two words"'), ('"kept as is"', '"kept as is"'), ("one", "one")):
        assert spark.createDataFrame([(keyword,)], "k string").select(kw.exact_query(F.col("k"))).first()[0] == exact


def test_recent_videos_hide_copies(spark):
    schema = "position long, video_id string, video_url string, published_at timestamp_ntz, video_type string"
    at = datetime.datetime(2024, 1, 1)
    manual = spark.createDataFrame([(1, "a", "u", at, "longform"), (2, "s", "u", at, "shorts"), (3, "", "https://only", at, "unknown"), (4, "a", "u", at, "longform"), (5, None, None, at, "longform")], schema)
    collected = spark.createDataFrame([(k, v, "u", at + datetime.timedelta(days=k), "longform") for k, v in enumerate("bacde")], schema)
    got = an.recent_videos(manual, collected, ["longform", "unknown"], 5)
    assert sorted((r.origin, r.order, r.video_id) for r in got.collect())[:2] == [(0, 1, "a"), (0, 3, "")]
    assert {r.video_id for r in got.collect()} == {"a", "", "e", "d", "c"}


def test_a_copied_title_is_no_snippet_behind_it(spark, tmp_path):
    from trendspan.plans import ranking, served

    rows = [(1, "That one. And the\nrest", "en", "a.com", 21), (2, "Of the that", "en", "a.com", 11), (3, "License given by MIT", "en", "a.com", 20), (4, None, None, None, None), (5, "An MIT license", "en", "a.com", 14), (6, "MITA licenses", "en", "a.com", 13)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.item_idx: r.quality for r in ranking.source_quality(spark, str(tmp_path)).collect()}
    assert got == {1: 0.46, 2: 1.0, 3: 0.0, 4: 0.0, 5: 0.0, 6: 0.0}
    kept = [r.doc_id for r in served.relevant_sources(spark, str(tmp_path)).where("keyword = 'MIT License'").collect()]
    assert sorted(kept) == [3, 5, 6]  # both words count for as much as 0.46
