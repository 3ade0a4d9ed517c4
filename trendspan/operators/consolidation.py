"""Consolidation of keywords: which are one, under which name, and what their candidates add up to.

Pairs come from equi-joins only: keywords with an equal compact form are linked to the first of them, and pairs whose
items overlap come from the items that they share. No keyword is compared with all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.functions import text as tx
from trendspan.functions import urls as ur
from trendspan.operators import ranking as rk
from trendspan.operators.relational import first_per
from trendspan.operators.titles import alike_titles

# Fixed value: tiers from best to worst.
TIER_ORDER = ["P0_CURATED", "P1_CONTEXT", "P2_RAW", "COMMUNITY"]


def tier_rank(tier: Column) -> Column:
    """A tier's place in their order; unknown tiers come last."""
    place = F.array_position(F.array(*map(F.lit, TIER_ORDER)), tier)
    return F.when(place > 0, place - 1).otherwise(9)


def signals(keywords: DataFrame) -> DataFrame:
    """``keyword_id, keyword, aliases`` with what the pair test compares, over a keyword and its aliases."""
    every = F.concat(F.array("keyword"), "aliases")
    surfaces = F.flatten(F.transform(every, lambda x: F.array(tx.keyword_surface(x), tx.trim_minor_suffix(tx.keyword_surface(x)))))
    forms = F.array_distinct(F.filter(surfaces, lambda x: x != ""))
    flat = lambda f: F.array_distinct(F.flatten(F.transform(F.col("forms"), f)))
    return keywords.withColumn("forms", forms).withColumns(
        {
            "compacts": F.array_distinct(F.filter(F.transform("forms", tx.compacted), lambda x: x != "")),
            "versions": flat(tx.version_tokens),
            "cores": flat(tx.ascii_core_tokens),
            "has_hangul": F.exists(every, lambda x: x.rlike(tx.ANY_HANGUL)),
            "has_ascii": F.exists(every, lambda x: x.rlike("[A-Za-z]")),
        }
    )


def links(marked: DataFrame, overlaps: DataFrame) -> DataFrame:
    """``a, b`` of keywords that are one. ``overlaps`` has ``a, b, jaccard`` of keywords that share items."""
    formed = marked.select("keyword_id", F.explode("compacts").alias("form"))
    first = formed.groupBy("form").agg(F.min("keyword_id").alias("a"))
    same = formed.join(first, "form").where("a <> keyword_id").select("a", F.col("keyword_id").alias("b"))
    side = lambda s: marked.select(*(F.col(c).alias(f"{c}_{s}") for c in ("keyword_id", "versions", "cores", "has_hangul", "has_ascii")))
    near = overlaps.where("jaccard >= 0.75").join(side("a"), F.col("a") == F.col("keyword_id_a")).join(side("b"), F.col("b") == F.col("keyword_id_b"))
    cross = (F.col("has_hangul_a") & F.col("has_ascii_b")) | (F.col("has_hangul_b") & F.col("has_ascii_a"))
    merge = kw.should_merge(F.col("jaccard"), F.lit(False), F.arrays_overlap("versions_a", "versions_b"), F.arrays_overlap("cores_a", "cores_b"), cross)
    return same.unionByName(near.where(merge).select("a", "b")).distinct()


def consolidate(keywords: DataFrame, bridge: DataFrame, overlaps: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """``keyword_id, keyword, aliases, matches, domains, latest_at, tier`` of each group of keywords that are one.

    ``bridge`` has a row for each keyword and item with ``domain, published_at, tier``.
    """
    marked = signals(keywords)
    groups = rk.components(links(marked, overlaps)).withColumnRenamed("node", "keyword_id").withColumnRenamed("component", "grp")
    placed = marked.join(groups, "keyword_id", "left").withColumn("grp", F.coalesce("grp", "keyword_id"))
    own = bridge.groupBy("keyword_id").agg(F.count("*").alias("own"), F.min(tier_rank(F.col("tier"))).alias("own_tier"))
    placed = placed.join(own, "keyword_id", "left").withColumns({"own": F.coalesce("own", F.lit(0)), "own_tier": F.coalesce("own_tier", F.lit(2))})
    k = F.col("keyword")
    score = kw.canonical_score(k, F.col("aliases"), F.col("own"), F.when(F.col("own_tier") == 0, "P0_CURATED").otherwise("P2_RAW"), generic)
    order = [score.desc(), F.size(tx.anchor_tokens(k, list(generic))).desc(), F.length(tx.keyword_surface(k)).asc(), k.asc(), F.asc("keyword_id")]
    chosen = first_per(placed, ["grp"], order).select("grp", "keyword_id", "keyword")
    # The first spelling of each form but the canonical one's, in the order of ids and aliases.
    spelled = placed.select("grp", "keyword_id", F.posexplode(F.concat(F.array("keyword"), "aliases")).alias("at", "alias")).withColumn("alias", F.trim("alias"))
    spelled = spelled.withColumn("form", tx.keyword_surface(F.col("alias"))).where("form <> ''")
    spelled = first_per(spelled, ["grp", "form"], [F.asc("keyword_id"), F.asc("at")])
    spelled = spelled.join(chosen.select("grp", tx.keyword_surface(k).alias("main")), "grp").where("form <> main")
    listed = F.array_sort(F.collect_list(F.struct("keyword_id", "at", "alias")))
    aliases = spelled.groupBy("grp").agg(F.transform(listed, lambda x: x["alias"]).alias("aliases"))
    # A group's items are the union of its keywords'; the tier starts as raw and only improves.
    rows = bridge.join(placed.select("keyword_id", "grp"), "keyword_id")
    best = F.least(F.min(tier_rank(F.col("tier"))), F.lit(2))
    merged = rows.groupBy("grp").agg(F.count_distinct("item_idx").alias("matches"), F.count_distinct("domain").alias("domains"), F.max("published_at").alias("latest_at"), F.element_at(F.array(*map(F.lit, TIER_ORDER)), (best + 1).cast("int")).alias("tier"))
    out = chosen.join(aliases, "grp", "left").join(merged, "grp", "left")
    return out.select("keyword_id", "keyword", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("domains", F.lit(0)).alias("domains"), "latest_at", F.coalesce("tier", F.lit("P2_RAW")).alias("tier"))


def companions(entries: DataFrame, bridge: DataFrame) -> DataFrame:
    """``head, companion`` of keywords that depend on context: the companion whose items are most alike, if any are enough.

    ``entries`` has ``position, keyword_id, keyword, dependent, anchors``. Keywords of exactly the same items (by count and two hashes of the set) are
    alike to anything by the same measure, so one of each such class stands for all: of companions the one with most anchors, the first of these.
    Only items of heads and of keywords with anchors meet. Equally good companions go by position. The session needs a checkpoint folder.
    """
    item = F.col("item_idx")
    sizes = bridge.groupBy("keyword_id").agg(
        F.count("*").alias("n"), F.count_distinct("domain").alias("domains"), F.max((F.col("tier") == "P0_CURATED").cast("int")).alias("curated"), F.bit_xor(F.xxhash64(item)).alias("x"), F.bit_xor(F.xxhash64(item, F.lit(1))).alias("y")
    )
    known = entries.select("keyword_id", "position", "dependent", F.least("anchors", F.lit(5)).alias("anchors")).join(sizes, "keyword_id").checkpoint()
    same = ["n", "x", "y"]
    heads = known.where("dependent").groupBy(*same).agg(F.min("keyword_id").alias("head"))
    firsts = known.where("not dependent and anchors > 0").groupBy(*same, "anchors").agg(F.min_by("keyword_id", "position").alias("companion"), F.min("position").alias("position"), F.first("domains").alias("domains"), F.first("curated").alias("curated"))
    best = firsts.groupBy(*same).agg(F.max_by(F.struct("companion", "position", "domains", "curated", "anchors"), "anchors").alias("c"))
    companion = best.select("c.*", F.col("n").alias("companion_n"))
    side = lambda df, name: bridge.select("item_idx", F.col("keyword_id").alias(name)).join(df.select(name), name, "left_semi")
    shared = side(heads, "head").join(side(companion, "companion"), "item_idx").groupBy("head", "companion").agg(F.count("*").alias("shared"))
    near = shared.join(heads.select("head", F.col("n").alias("head_n")), "head").join(companion, "companion")
    overlap = F.col("shared") / (F.col("head_n") + F.col("companion_n") - F.col("shared"))
    score = overlap * 100 + F.col("shared") * 8 + F.least("domains", F.lit(8)) * 2 + F.col("anchors") * 3 + F.col("curated") * 4
    enough = (F.col("shared") >= F.greatest(F.lit(1), F.least(F.lit(2), F.col("head_n")))) & (overlap >= F.when(F.col("head_n") <= 2, 0.35).otherwise(0.45))
    # Digits beyond those that sums of doubles agree in decide nothing.
    scored = near.where(enough).withColumn("score", F.round(score, 9))
    top = scored.groupBy("head").agg(F.max("score").alias("score"))
    chosen = scored.join(top, ["head", "score"]).groupBy("head").agg(F.min_by("companion", "position").alias("companion"))
    classes = heads.join(chosen, "head").drop("head")
    return known.where("dependent").join(classes, same).select(F.col("keyword_id").alias("head"), "companion")


def enrich_context(keywords: DataFrame, bridge: DataFrame, generic: Sequence[str] = ()) -> DataFrame:
    """``keyword, aliases, matches, domains, latest_at, tier`` once keywords that depend on context are joined to a companion.

    ``keywords`` has ``position, keyword_id, keyword, aliases``, ``bridge`` a row for each keyword and item with ``domain, published_at, tier``. A head
    whose companion holds its words is taken into it; another one makes a keyword of both texts; one without a companion
    stays if it has four items of three domains, or goes. Keywords equal but for case are one, under the first spelling.
    """
    k = F.col("keyword")
    entries = keywords.withColumns({"dependent": tx.context_dependent(k, list(generic)), "anchors": F.size(tx.anchor_tokens(k, list(generic))), "surface": tx.keyword_surface(k)})
    # Read seven times below, and dear to compute.
    rk.checkpoint_dir(keywords.sparkSession)
    entries = entries.checkpoint()
    pairs = companions(entries, bridge).checkpoint()
    plain = entries.where("not dependent").select(F.lit(0).alias("part"), "position", "keyword", "aliases", F.array("keyword_id").alias("ids"))
    heads = entries.where("dependent").join(pairs.withColumnRenamed("head", "keyword_id"), "keyword_id", "left")
    found = heads.where("companion is not null").alias("h").join(entries.alias("c"), F.col("h.companion") == F.col("c.keyword_id"))
    inside = F.contains("c.surface", F.col("h.surface"))
    text = F.when(inside, F.col("c.keyword")).otherwise(kw.enriched(F.col("c.keyword"), F.col("h.keyword"), F.col("c.surface"), F.col("h.surface")))
    own = F.array("h.keyword")
    joined = found.select(F.lit(1).alias("part"), "h.position", text.alias("keyword"), F.when(inside, F.concat("c.aliases", own, "h.aliases")).otherwise(F.concat("c.aliases", "h.aliases", own)).alias("aliases"), F.array("h.companion", "h.keyword_id").alias("ids"))
    strong = bridge.groupBy("keyword_id").agg(F.count("*").alias("n"), F.count_distinct("domain").alias("d")).where("n >= 4 and d >= 3")
    kept = heads.where("companion is null").join(strong, "keyword_id", "left_semi").select(F.lit(1).alias("part"), "position", "keyword", "aliases", F.array("keyword_id").alias("ids"))
    rows = plain.unionByName(joined).unionByName(kept).withColumns({"key": F.lower("keyword"), "place": F.struct("part", "position")}).checkpoint()
    names = rows.groupBy("key").agg(F.min_by("keyword", "place").alias("keyword"))
    spelled = rows.select("key", "place", F.posexplode("aliases").alias("at", "alias")).groupBy("key", "alias").agg(F.min(F.struct("place", "at")).alias("first"))
    listed = spelled.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "alias"))), lambda x: x["alias"]).alias("aliases"))
    sources = rows.select("key", F.explode("ids").alias("keyword_id")).distinct()
    # The tier starts as raw and only improves.
    best = F.least(F.min(tier_rank(F.col("tier"))), F.lit(2))
    merged = bridge.join(sources, "keyword_id").groupBy("key").agg(F.count_distinct("item_idx").alias("matches"), F.count_distinct("domain").alias("domains"), F.max("published_at").alias("latest_at"), F.element_at(F.array(*map(F.lit, TIER_ORDER)), (best + 1).cast("int")).alias("tier"))
    out = names.join(listed, "key", "left").join(merged, "key", "left")
    return out.select("keyword", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("domains", F.lit(0)).alias("domains"), "latest_at", F.coalesce("tier", F.lit("P2_RAW")).alias("tier"))


def semantic_merge(keywords: DataFrame, groups: DataFrame) -> DataFrame:
    """Keywords with those taken in that given groups name: ``keyword, aliases`` over ``position, keyword, aliases``.

    ``groups`` has ``position, canonical, member``; both have to be keywords, in any case. The last group of a member counts.
    A keyword that is a member itself goes, and what would have merged into it goes with it.
    """
    named = keywords.withColumn("low", F.lower("keyword"))
    known = named.select("low").distinct()
    valid = groups.select("position", F.lower("canonical").alias("into"), F.lower("member").alias("low"))
    valid = valid.join(known, "low", "left_semi").join(known.withColumnRenamed("low", "into"), "into", "left_semi")
    target = valid.groupBy("low").agg(F.max_by("into", "position").alias("into"))
    marked = named.join(target, "low", "left")
    gone = marked.where("into is not null")
    taken = gone.groupBy("into").agg(F.array_sort(F.collect_list(F.struct("position", F.concat(F.array("keyword"), "aliases").alias("names")))).alias("taken"))
    more = taken.select(F.col("into").alias("low"), F.flatten(F.transform("taken", lambda x: x["names"])).alias("more"))
    kept = marked.where("into is null").join(more, "low", "left")
    return kept.select("position", "keyword", F.when(F.col("more").isNull(), F.col("aliases")).otherwise(F.array_distinct(F.concat("aliases", "more"))).alias("aliases"))


def merge_batches(keywords: DataFrame) -> DataFrame:
    """Keywords of several batches, equal but for case, as one: the first spelling, all aliases. ``position, keyword, aliases``."""
    rows = keywords.withColumn("low", F.lower("keyword"))
    once = rows.select("low", F.explode("aliases").alias("alias")).distinct().groupBy("low").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    first = rows.groupBy("low").agg(F.min(F.struct("position", "keyword")).alias("f")).select("low", "f.*")
    return first.join(once, "low", "left").select("position", "keyword", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


# Fixed value: tiers of articles from best to worst, as dedup prefers them.
ARTICLE_TIERS = ["P0_CURATED", "P0_RELEASES", "P1_CONTEXT", "P2_RAW", "COMMUNITY"]


def better_first() -> list[Column]:
    """The order in which the winner of duplicates comes first: tier, curated, confidence, score, first come."""
    place = F.array_position(F.array(*map(F.lit, ARTICLE_TIERS)), F.col("tier"))
    return [F.when(place > 0, place).otherwise(9).asc(), F.when(F.col("origin_type") == "curated", 0).otherwise(1).asc(), F.desc_nulls_last("confidence"), F.desc_nulls_last("score"), F.asc("position")]


def dedup_articles(articles: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Articles without duplicates: one for each canonical URL, then of curated ones alike in title the best.

    ``position, link, title, tier, origin_type, confidence, score``; articles without a link go. A title goes if a better one
    that stays is alike. Decisions are taken in rounds, the undecided without a better undecided neighbour first, which is
    the greedy choice in order of preference.
    """
    rows = articles.where("link is not null and link <> ''").withColumn("__url", ur.canonical(F.col("link")))
    # Stored, as what follows reads it several times.
    rk.checkpoint_dir(articles.sparkSession)
    one = first_per(rows, ["__url"], better_first()).drop("__url").checkpoint()
    order = F.struct(*(c for c in [F.array_position(F.array(*map(F.lit, ARTICLE_TIERS)), F.col("tier")).alias("a"), (-F.coalesce("confidence", F.lit(0.0))).alias("b"), (-F.coalesce("score", F.lit(0.0))).alias("c"), F.col("position").alias("d")]))
    curated = one.where("origin_type = 'curated' and title <> ''").select("position", tx.title_key(F.col("title")).alias("key"), order.alias("o"))
    # Equal titles first, so that what is compared differs.
    titles = curated.groupBy("key").agg(F.min_by("position", "o").alias("position"), F.min("o").alias("o")).checkpoint()
    pairs = alike_titles(titles, threshold)
    gone = losers(titles.select("position", "o"), pairs)
    stays = titles.join(gone, "position", "left_anti").select("position")
    plain = one.where(~F.coalesce((F.col("origin_type") == "curated") & (F.col("title") != ""), F.lit(False)))
    return plain.unionByName(one.join(stays, "position", "left_semi"))


def losers(titles: DataFrame, pairs: DataFrame) -> DataFrame:
    """``position`` of the titles that lose against a better one that stays. A checkpoint a round."""
    rk.checkpoint_dir(titles.sparkSession)
    o = lambda c: titles.select(F.col("position").alias(c), F.col("o").alias(f"o{c}"))
    edges = pairs.join(o("x"), "x").join(o("y"), "y")
    first = F.col("ox") < F.col("oy")
    edges = edges.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("better"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("worse")).checkpoint()
    gone = edges.select(F.col("worse").alias("position")).where("false").checkpoint()
    while not edges.isEmpty():
        # Whoever has no better neighbour left stays, and its neighbours go.
        stays = edges.select(F.col("better").alias("p")).distinct().join(edges.select(F.col("worse").alias("p")).distinct(), "p", "left_anti")
        out = edges.join(stays.withColumnRenamed("p", "better"), "better", "left_semi").select(F.col("worse").alias("position")).distinct().checkpoint()
        gone = gone.unionByName(out)
        edges = edges.join(out.withColumnRenamed("position", "better"), "better", "left_anti").join(out.withColumnRenamed("position", "worse"), "worse", "left_anti").checkpoint()
    return gone.distinct()
