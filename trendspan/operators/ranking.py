"""Operators over keywords and items: matching, roll-up, families, quotas, back-fill, identity."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.functions import scoring as sc
from trendspan.functions import times as tm
from trendspan.operators import automaton

def match_bridge(items: DataFrame, keywords: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """``keyword_id, item_idx`` of the items whose body holds the keyword, an alias or an ASCII variant; ``carried`` come along.

    ``keywords`` is a table of ``keyword_id, keyword, aliases`` of any size; items are read once for each of its blocks.
    """
    return automaton.match(items, keywords, "body", ["item_idx", *carried]).select("item_idx", *carried, "keyword_id")


#: What the roll-up needs of the items.
ROLLED = ("domain", "published_at", "tier", "points", "comments")


def candidate_rollup(bridge: DataFrame, as_of: str) -> DataFrame:
    """Each keyword's counts, domains, latest time, best tier, engagement and its items of two windows before ``as_of``.

    The bridge carries the columns ``ROLLED``, so items are read once.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    age = tm.age_hours(now, F.col("published_at"))
    order = F.when(F.col("tier") == "P0_CURATED", 0).when(F.col("tier") == "P1_CONTEXT", 1).otherwise(2)
    best = F.min(order)
    return bridge.groupBy("keyword_id").agg(
        F.count("*").alias("matches"),
        F.count_distinct("domain").alias("domains"),
        F.max("published_at").alias("latest_at"),
        # A candidate starts as raw and its tier only gets better.
        F.when(best == 0, "P0_CURATED").when(best == 1, "P1_CONTEXT").otherwise("P2_RAW").alias("tier"),
        F.sum("points").alias("points"),
        F.sum("comments").alias("comments"),
        F.count_if((age >= 0) & (age <= sc.RECENT_HOURS)).alias("recent"),
        F.count_if((age > sc.RECENT_HOURS) & (age <= sc.BASELINE_HOURS)).alias("baseline"),
    )


def score(candidates: DataFrame, as_of: str, weights: dict[str, float] = sc.WEIGHTS) -> DataFrame:
    """The five axes and the total; axes are rounded after the total is made of them."""
    now = F.lit(as_of).cast("timestamp_ntz")
    axes = {
        "recency": sc.recency(tm.age_hours(now, F.col("latest_at"))),
        "frequency": sc.frequency(F.col("domains"), F.lit(0.0)),
        "authority": sc.authority(F.col("tier"), F.lit(None).cast("double")),
        "velocity": sc.velocity(F.col("recent"), F.col("baseline"), F.col("domains")),
        "engagement": sc.engagement(F.col("points"), F.col("comments")),
    }
    return candidates.withColumns({**{k: F.round(v, 4) for k, v in axes.items()}, "total": F.round(sc.total(axes, weights), 4)})


def replay(stored: DataFrame, weights: dict[str, float] = sc.WEIGHTS) -> DataFrame:
    """A stored snapshot's totals and ranks against those that its stored axes give: how many agree, and whose ranks don't.

    ``stored`` has ``keyword_id, total, rank`` and the axes of a snapshot's few candidates.
    """
    again = stored.withColumn("replayed", F.round(sc.total({k: F.col(k) for k in weights}, weights), 4))
    both = ranked_by(again, "replayed", ["keyword_id"], name="replayed_rank")
    off = F.array_sort(F.collect_list(F.when(F.col("rank") != F.col("replayed_rank"), F.struct("rank", "keyword_id"))))
    return both.agg(F.count("*").alias("compared"), F.count_if(F.col("total") == F.col("replayed")).alias("score_matches"), F.count_if(F.col("rank") == F.col("replayed_rank")).alias("rank_matches"), F.array_join(F.transform(off, lambda x: x["keyword_id"]), ",").alias("mismatches"))


# The form of an id in a request, and how many count.
ID_FORM, MOST_REQUESTED = "^[A-Za-z0-9_-]{1,128}$", 20


def valid_ids(requests: DataFrame, by: Sequence[str], order: str, form: str = ID_FORM, most: int = MOST_REQUESTED) -> DataFrame:
    """``by, id, place``: the first different, trimmed ids of each request that have the form."""
    once = requests.withColumn("id", F.trim("id")).where(F.col("id").rlike(form)).groupBy(*by, "id").agg(F.min(order).alias("__first"))
    placed = once.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("__first", "id"))).where(F.col("place") <= most)
    return placed.select(*by, "id", "place")


def ranked_by(df: DataFrame, total: str, tie: Sequence[str], by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """1-based ranks by total; without ``by`` over the whole table, which has to be a snapshot's few candidates."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(total), *tie)))


def suppress_families(df: DataFrame, family: str = "family", total: str = "total", tie: str = "keyword_id") -> DataFrame:
    """Of each family: with an event and a version only what has no version; of two versions or more the best one."""
    versioned = F.col("version_kind") != "none"
    w = Window.partitionBy(family)
    best = F.row_number().over(Window.partitionBy(family, versioned).orderBy(F.desc(total), tie))
    marked = df.withColumns(
        {
            "__events": F.sum(F.col("keyword_kind").isin("feature_event", "incident").cast("int")).over(w),
            "__versions": F.sum(versioned.cast("int")).over(w),
            "__best": best,
        }
    )
    keep = F.when((F.col("__events") > 0) & (F.col("__versions") > 0), ~versioned).when(F.col("__versions") < 2, True).otherwise(~versioned | (F.col("__best") == 1))
    return marked.where(keep).drop("__events", "__versions", "__best")


def diversity_quotas(df: DataFrame, topic: str, order: Sequence[Column], least: dict[str, int], most: dict[str, int], target: int) -> DataFrame:
    """Each topic's minimum first, then the best of the rest within each topic's maximum, up to ``target``."""
    by_topic = Window.partitionBy(topic).orderBy(*order)
    low, high = F.lit(0), F.lit(None).cast("int")
    for t, n in least.items():
        low = F.when(F.col(topic) == t, n).otherwise(low)
    for t, n in most.items():
        high = F.when(F.col(topic) == t, n).otherwise(high)
    # No topic can give more than this, a literal, so Spark drops the rest before rows are moved.
    bound = max([target, *least.values()])
    placed = df.withColumn("__n", F.row_number().over(by_topic)).where(F.col("__n") <= bound).withColumns({"__low": low, "__high": high})
    placed = placed.where(F.col("__high").isNull() | (F.col("__n") <= F.greatest("__high", "__low")))
    first = F.col("__n") <= F.col("__low")
    # No topic can give more than the target, so what is ranked over all topics is small.
    placed = placed.where(F.col("__n") <= F.greatest(F.lit(target), F.col("__low")))
    rest = F.row_number().over(Window.partitionBy(first).orderBy(*order))
    taken = F.sum(first.cast("int")).over(Window.partitionBy(F.lit(0)))
    return placed.withColumns({"__rest": rest, "__taken": taken}).where(first | (F.col("__rest") <= target - F.col("__taken"))).drop("__n", "__low", "__high", "__rest", "__taken")


def audience(df: DataFrame, passes: Column, eligible: Column, quality: str, tie: str, least: int) -> DataFrame:
    """The rows that pass; if fewer than ``least`` do, the best eligible others fill up."""
    marked = df.withColumns({"__pass": passes, "__fill": ~passes & eligible})
    total = marked.agg(F.count_if("__pass").alias("__passed"))
    fill = F.row_number().over(Window.partitionBy("__fill").orderBy(F.desc(quality), tie))
    passed = marked.where("__pass")
    # Only the best few can fill up, so they are found by a top-k rather than by ranking all.
    few = marked.where("__fill").orderBy(F.desc(quality), tie).limit(least).withColumn("__k", fill)
    filled = few.where(F.col("__k") <= least - total.scalar()).drop("__k")
    return passed.unionByName(filled).drop("__pass", "__fill")


def stratified_sample(df: DataFrame, stratum: str, key: str, shares: dict[str, int]) -> DataFrame:
    """As many rows of each stratum as its share, in the order of a hash; what strata lack is filled from the rest."""
    target = sum(shares.values())
    want = F.lit(0)
    for s, n in shares.items():
        want = F.when(F.col(stratum) == s, n).otherwise(want)
    order = [F.md5(F.col(key).cast("string")), F.col(key)]
    placed = df.withColumn("__n", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("__n") <= target).withColumn("__own", F.col("__n") <= want)
    rest = F.row_number().over(Window.partitionBy("__own").orderBy(*order))
    taken = F.sum(F.col("__own").cast("int")).over(Window.partitionBy(F.lit(0)))
    return placed.withColumns({"__rest": rest, "__taken": taken}).where(F.col("__own") | (F.col("__rest") <= target - F.col("__taken"))).drop("__n", "__own", "__rest", "__taken")


def checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder that the cluster names; a temporary one stands in for it in a local session only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="trendspan-"))


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """``node, component`` (its smallest node) of undirected edges ``a, b``: minimum labels spread and jump until none changes.

    Each round is a reliable checkpoint, so a lost executor costs no more than a round.
    """
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")).checkpoint()
    for _ in range(most_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("next"), "component")
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("further"))
        after = step.join(jump, "next").select("node", F.least("next", "further").alias("component"), F.col("component").alias("before")).checkpoint()
        labels = after.select("node", "component")
        if after.where("component <> before").isEmpty():
            return labels
    raise RuntimeError("the components did not settle")
