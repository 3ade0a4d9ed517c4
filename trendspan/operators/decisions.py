"""What a ranking decides and why: sources that speak for a keyword, quality with a shadow switch, reasons kept for later."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspan.functions import scoring as sc
from trendspan.functions import urls as ur
from trendspan.operators.consolidation import tier_rank
from trendspan.operators.relational import first_per

# Sources that a quality decision looks at, articles of an event's context.
SOURCES, ARTICLES = 5, 5
# Insights that have to be there, and how long each has to be; the shortest summary.
FILLED, INSIGHT_CHARS, SUMMARY_CHARS = 2, 15, 200


def first_sources(bridge: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``keyword_id, sources``: the first five items that hold a keyword, as an array of structs of ``columns``, in item order."""
    first = first_per(bridge, ["keyword_id"], [F.asc("item_idx")], SOURCES)
    return first.groupBy("keyword_id").agg(F.array_sort(F.collect_list(F.struct("item_idx", *columns))).alias("sources"))


def relevant_source(keyword: Column, sources: Column) -> Column:
    """Whether any of a keyword's sources (structs of ``title, snippet, url, domain``) fits it."""
    return F.exists(sources, lambda s: sc.source_quality(keyword, s["title"], s["snippet"], s["url"], s["domain"]) >= sc.RELEVANT)


def quality_decisions(candidates: DataFrame, shadow: bool = True) -> DataFrame:
    """Add ``raw_delta, applied_delta, adjusted_total, place``. ``candidates`` has ``keyword_id, rank, total, quality, is_manual``.

    In the shadow, and for manual keywords, the delta is only noted. Out of it candidates are placed by what they come to, equal ones by their rank.
    """
    applied = F.when(F.lit(shadow) | F.col("is_manual"), F.lit(0.0)).otherwise(F.col("quality"))
    out = candidates.withColumns({"raw_delta": F.col("quality"), "applied_delta": applied}).withColumn("adjusted_total", F.round(F.col("total") + F.col("applied_delta"), 4))
    if shadow:
        return out.withColumn("place", F.col("rank").cast("int"))
    # A snapshot's candidates are a few hundred.
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("adjusted_total"), "rank")))


def internal_reason(policy: Column, stability: Column, manual: Column, inserted: Column, quality: Column) -> Column:
    """The names of the deltas that changed a total and of the quality reasons, or null. Deltas that are no number count as none."""
    counts = lambda d: F.coalesce(d.isNotNull() & ~F.isnan(d) & (F.round(d, 4) != 0), F.lit(False))
    named = F.array(F.when(counts(policy), "policy"), F.when(counts(stability), "stability"), F.when(counts(manual), F.when(inserted, "manual_insert").otherwise("manual_boost")))
    every = F.concat(F.array_compact(named), F.transform(F.coalesce(quality, F.array().cast("array<string>")), lambda r: F.concat(F.lit("quality:"), r)))
    return F.when(F.size(every) > 0, F.array_join(every, ", "))


def event_articles(bridge: DataFrame, columns: Sequence[str] = ("title", "domain")) -> DataFrame:
    """``keyword_id, place, item_idx, link`` and ``columns`` of the articles that tell an event: the best tiers first, each URL once, five at most.

    ``bridge`` has ``keyword_id, item_idx, tier, link`` and ``columns``. URLs are the same if they differ in tracking parameters only.
    """
    order = [tier_rank(F.col("tier")).asc(), F.asc("item_idx")]
    once = first_per(bridge.withColumn("__key", ur.url_key(F.col("link"))), ["keyword_id", "__key"], order)
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy("keyword_id").orderBy(*order))).where(F.col("place") <= ARTICLES)
    return placed.select("keyword_id", "place", "item_idx", "link", *columns)


def drop_reason(topic: Column, impact: Column, proof: Column, summary: Column, insights: Sequence[Column], blacklist: Sequence[str], least_impact: int = 2, least_proof: int = 2) -> Column:
    """The first reason for which an article is dropped, or null: topic, impact, proof, a short summary, too few insights."""
    filled = F.lit(0)
    for i in insights:
        filled = filled + (F.length(F.trim(F.coalesce(i, F.lit("")))) >= INSIGHT_CHARS).cast("int")
    return (
        F.when(topic.isin(*blacklist), "topic").when(F.coalesce(impact, F.lit(0)) <= least_impact, "impact").when(F.coalesce(proof, F.lit(0)) <= least_proof, "proof")
        .when(F.length(F.coalesce(summary, F.lit(""))) < SUMMARY_CHARS, "short").when(filled < FILLED, "insights")
    )


def penalties(text: Column, rules: Sequence[tuple[Sequence[str], float]]) -> list[Column]:
    """What each rule takes off: its number once, if a text in lower case holds any of its words."""
    out = []
    for words, n in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w.lower()))
        out.append(F.when(F.coalesce(hit, F.lit(False)), float(n)).otherwise(0.0))
    return out
