"""Keywords and what is already known of them: ids taken over from history, and rows that an editor put first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspan.functions import text as tx
from trendspan.operators.assignment import all_free, first_free
from trendspan.operators.relational import best_of, first_per


def names() -> Column:
    """A keyword and its aliases in one array."""
    return F.concat(F.array("keyword"), F.coalesce("aliases", F.array().cast("array<string>")))


def alias_keys(text: Column) -> Column:
    """The keys, of two letters or more, by which a name is looked up: in lower case with single blanks, and without blanks."""
    low = tx.collapse(F.lower(tx.fold_compatibility(text)))
    return F.filter(F.array_distinct(F.array(low, F.replace(low, F.lit(" "), F.lit("")))), lambda k: F.length(k) >= 2)


def newest_aliases(history: DataFrame) -> DataFrame:
    """``key, canonical_id`` of each alias key: the mapping made last, ties by the larger id. ``history`` has ``alias, canonical_id, created_at``."""
    keyed = history.select(F.explode(alias_keys(F.col("alias"))).alias("key"), "canonical_id", "created_at")
    return best_of(keyed, ["key"], F.struct("created_at", "canonical_id"), ["canonical_id"])


def canonical_ids(keywords: DataFrame, history: DataFrame) -> DataFrame:
    """``own_id, canonical_id``: each keyword in order takes the first id that history knows one of its names by.

    ``keywords`` has ``position`` (unique), ``own_id, keyword, aliases``. An id that a keyword before took, or that any keyword has as its own, is not
    to be had; keywords without one keep theirs.
    """
    # Names one to a row: compatibility forms are folded by a class of ICU, which no function over arrays can call.
    named = keywords.select("position", F.posexplode(names()).alias("at", "name")).where("name is not null")
    named = named.select("position", F.posexplode(alias_keys(F.col("name"))).alias("form", "key"), (F.col("at") * 2).alias("at")).withColumn("at", F.col("at") + F.col("form"))
    known = named.join(newest_aliases(history), "key").join(keywords.select(F.col("own_id").alias("canonical_id")).distinct(), "canonical_id", "left_anti")
    taken = first_free(known.select(F.col("position").alias("place"), "at", F.col("canonical_id").alias("id")))
    return keywords.join(taken, keywords.position == taken.place, "left").select("own_id", F.coalesce("id", "own_id").alias("canonical_id"))


def manual_key(text: Column) -> Column:
    """The key by which manual keywords are matched: in lower case with single blanks."""
    return F.lower(tx.collapse(tx.fold_compatibility(F.coalesce(text, F.lit("")))))


def manual_priority(ranked: DataFrame, manual: DataFrame, mode: str, internal_bonus: float = 3.0, total_bonus: float = 6.0) -> DataFrame:
    """Manual keywords first, in their own order, then the others by rank: ``place, keyword_id, keyword, internal, total, is_manual, inserted``.

    ``ranked`` has ``rank`` (unique), ``keyword_id, keyword, aliases, internal, total``; ``manual`` has ``position, keyword``. A manual keyword is the best
    ranked row that has its key among its own name's and its aliases' keys; without one it comes in as a new row. Rows that have any manual
    key gain both bonuses. A row whose id, or one of whose manual keys, a row before it in the new order has is left out.
    """
    m = first_per(manual.withColumn("key", manual_key(F.col("keyword"))).where("key <> ''"), ["key"], [F.asc("position")]).select("key", "position", F.col("keyword").alias("text"))
    keyed = ranked.select("rank", "keyword_id", F.explode(names()).alias("name")).select("rank", "keyword_id", manual_key(F.col("name")).alias("key")).distinct().join(m, "key")
    existing = keyed.groupBy("key", "position").agg(F.min("rank").alias("rank"))
    fresh = m.join(existing.select("key"), "key", "left_anti").withColumn("keyword", tx.collapse(tx.fold_compatibility(F.col("text")))).select("key", "position", "keyword", tx.manual_id(F.lit(mode), F.col("keyword")).alias("keyword_id"))
    # The order in which rows ask for their place: the manual ones' best rows and new rows, then all rows by rank.
    place = lambda part, order: F.struct(F.lit(part).alias("part"), order.cast("long").alias("order")).alias("place")
    asking = existing.select(place(0, F.col("position")), "rank").unionByName(ranked.select(place(1, F.col("rank")), "rank"))
    by_id = lambda df: df.select("place", F.concat(F.lit("id "), "keyword_id").alias("claim"))
    by_key = lambda df: df.select("place", F.concat(F.lit("key "), "key").alias("claim"))
    news = fresh.withColumn("place", place(0, F.col("position")))
    claims = by_id(asking.join(ranked, "rank")).unionByName(by_key(asking.join(keyed.select("rank", "key"), "rank"))).unionByName(by_id(news)).unionByName(by_key(news))
    chosen = all_free(claims)
    boosted = ranked.join(keyed.select("rank").distinct().withColumn("__manual", F.lit(True)), "rank", "left").withColumn("is_manual", F.coalesce("__manual", F.lit(False)))
    gain = lambda c, bonus: F.when(F.col("is_manual"), F.round(F.col(c) + bonus, 4)).otherwise(F.col(c)).alias(c)
    kept = asking.join(chosen, "place", "left_semi").join(boosted, "rank").select("place", "keyword_id", "keyword", gain("internal", internal_bonus), gain("total", total_bonus), "is_manual", F.lit(False).alias("inserted"))
    new = news.join(chosen, "place", "left_semi").select("place", "keyword_id", "keyword", F.lit(internal_bonus).alias("internal"), F.round(F.lit(10 + total_bonus), 4).alias("total"), F.lit(True).alias("is_manual"), F.lit(True).alias("inserted"))
    return kept.unionByName(new)
