"""Links between the members of hash buckets, and the connected components of links.

A bucket may hold a third of all rows, so no group is ever collected and no bucket is expanded into its pairs.
Each member is first compared with its bucket's smallest member. After the components of the links found so,
only those pairs of a bucket matter that lie in different components; they are compared as well. A pair within
one component adds nothing to the components, so every link that could join two of them is tested.

For sets there is an exact second key (``set_components``): members of buckets that hold several components are
compared only where they share one of their rarest elements, as two sets that are alike enough must do. An edit makes
elements that hardly any other set has, so the many edited copies of one text, too far from each other to be linked,
do not meet again, though every band throws them together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspan.llm.shared import Scratch, growing

#: Of a set's rarest elements so many tell whether two sets met before.
HEAD = 16

Verify = Callable[[DataFrame], DataFrame]


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """The smallest node reachable from each node of ``links(a, b)``: ``node, component``.

    Large-star and small-star steps in turn (Kiveris et al., 2014): the number of links never grows, and the
    number of rounds grows as the logarithm of the longest path. Each round is written to the shared folder.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = least.select("u", F.col("m").alias("v")).unionByName(moved).distinct()
        after = scratch.write(small, "links")
        scratch.drop(edges)
        edges = after
        # Done when each node has one link, to a node that has none itself: all links are stars.
        many = edges.groupBy("u").count().where("count > 1").select(F.lit(1).alias("x"))
        inner = edges.join(edges.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select(F.lit(1).alias("x"))
        if many.unionAll(inner).isEmpty():
            break
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def bucket_components(scratch: Scratch, members: DataFrame, bucket: list[str], verify: Verify, similar: Column | None = None) -> DataFrame:
    """Components over all verified links between members that share a bucket: ``node, component``.

    ``members`` has the columns of ``bucket`` and ``id``; repeated rows are harmless. ``verify`` keeps the
    linked rows of a table of pairs ``(a, b)``. ``similar``, over the columns ``a`` and ``b``, is a test cheap
    enough to run inside the join. Members without a link are left out.
    """
    shared = members.groupBy(*bucket).agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").drop("last")
    held = scratch.write(members.join(growing(shared), bucket).distinct(), "members")
    scratch.release()
    stars = held.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b"))
    stars = stars.where(similar) if similar is not None else stars
    links = scratch.write(verify(stars.distinct()), "stars")
    first = scratch.write(connected_components(scratch, links), "components")

    placed = held.join(growing(first.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id")).drop("lead")
    sizes = placed.groupBy(*bucket, "component").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy(*bucket).agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    placed = scratch.write(placed.join(growing(mixed), bucket), "mixed")
    if placed.isEmpty():
        scratch.drop(placed, held, links)
        return first
    # Of a bucket's pairs across components, at least one side is outside its main component.
    outside = placed.where("component <> main").select(*bucket, F.col("id").alias("x"), F.col("component").alias("cx"))
    other = placed.select(*(F.col(c).alias(f"{c}_") for c in bucket), F.col("id").alias("y"), F.col("component").alias("cy"), "main")
    a, b = F.least("x", "y"), F.greatest("x", "y")
    on = F.lit(True)
    for c in bucket:
        on = on & (F.col(c) == F.col(f"{c}_"))
    on = on & (F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y")))
    if similar is not None:
        crossing = outside.withColumn("a", F.col("x")).join(growing(other.withColumn("b", F.col("y"))), on & similar)
    else:
        crossing = outside.join(growing(other), on)
    more = scratch.write(verify(crossing.select(a.alias("a"), b.alias("b")).distinct()), "crossing")
    out = first
    if not more.isEmpty():
        out = scratch.write(connected_components(scratch, links.unionByName(more)), "components")
    scratch.drop(placed, held, links, more)
    return out


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose sets have at least this Jaccard similarity."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    same = F.size(F.array_intersect("x", "y"))
    # Sets whose sizes differ by more than the similarity allows cannot be alike.
    sized = F.least(F.size("x"), F.size("y")) >= similarity * F.greatest(F.size("x"), F.size("y"))
    return pairs.join(a, "a").join(b, "b").where(sized).where(same >= similarity * (F.size("x") + F.size("y") - same)).select("a", "b")


def rarest(sets: DataFrame, similarity: float) -> DataFrame:
    """``id, component, n, element, i, j, short``: each set's elements that a set alike enough can have as its first in common.

    ``i`` is an element's place in its set, ``j`` its place among those that other sets have as well.

    A set's elements are ordered by how few sets have them. Sets of n and m elements with Jaccard similarity s share at
    least s / (1 + s) * (n + m). So the first element in common is within the first n - s * n + 1 of either, and within
    the first n - 2 * s / (1 + s) * n + 1 (``short``) of the one that is not the larger.
    """
    rows = sets.select("id", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("element"))
    often = rows.groupBy("element").agg(F.count("*").alias("c")).where("c > 1")
    order = Window.partitionBy("id").orderBy("c", "element")
    # An element that no other set has comes first, and cannot be the one in common.
    placed = rows.join(often, "element", "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumns({"i": F.row_number().over(order), "j": F.sum((F.coalesce("c", F.lit(1)) > 1).cast("int")).over(order)})
    n, i = F.col("n"), F.col("i")
    first = placed.where((F.col("c") > 1) & (i <= n - F.ceil(n * similarity - 1e-9) + 1))
    return first.select("id", "component", "n", "element", "i", "j", (i <= n - F.ceil(n * (2 * similarity / (1 + similarity)) - 1e-9) + 1).alias("short"))


def set_components(scratch: Scratch, members: DataFrame, bucket: list[str], sets: DataFrame, similarity: float) -> DataFrame:
    """Components over the links of Jaccard ``similarity`` between sets that share a bucket: ``node, component``.

    ``members`` has the columns of ``bucket`` and ``id``, ``sets`` the sets as arrays: ``id, shingles``.
    """
    shared = members.groupBy(*bucket).agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").drop("last")
    held = scratch.write(members.join(growing(shared), bucket).distinct(), "members")
    scratch.release()
    stars = held.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    links = scratch.write(alike(stars, sets, similarity), "stars")
    first = scratch.write(connected_components(scratch, links), "components")

    placed = held.join(growing(first.withColumnRenamed("node", "id")), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = placed.groupBy(*bucket).agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select(*bucket)
    apart = placed.join(growing(mixed), bucket).select("id", "component").distinct()
    keyed = scratch.write(rarest(sets.join(apart, "id"), similarity), "rarest")
    sizes = keyed.groupBy("element", "component").agg(F.count("*").alias("k"))
    main = sizes.groupBy("element").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    keyed = scratch.write(keyed.join(main, "element"), "mixed")
    scratch.drop(held)
    if keyed.isEmpty():
        scratch.drop(links, keyed)
        return first
    scratch.release()
    stored = keyed
    # The rarest few of each set's elements: two sets that have some of these in common meet at the first of them only.
    listed = F.array_sort(F.collect_list(F.struct("j", "element")))
    heads = keyed.where(F.col("j") <= HEAD).groupBy("id").agg(F.transform(listed, lambda e: e["element"]).alias("head"))
    keyed = keyed.join(heads, "id", "left").withColumn("head", F.coalesce("head", F.array().cast("array<long>")))
    # Of an element's pairs across components, at least one side is outside its main component.
    x = keyed.where("component <> main").select("element", *(F.col(c).alias(f"{c}_x") for c in ("id", "component", "n", "i", "short", "head")))
    y = keyed.select("element", "main", *(F.col(c).alias(f"{c}_y") for c in ("id", "component", "n", "i", "short", "head")))
    c = F.col
    enough = F.ceil((c("n_x") + c("n_y")) * (similarity / (1 + similarity)) - 1e-9)
    smaller = (c("short_x") & (c("n_x") <= c("n_y"))) | (c("short_y") & (c("n_y") <= c("n_x")))
    reach = F.least(c("n_x") - c("i_x"), c("n_y") - c("i_y")) + 1 >= enough
    across = (c("component_x") != c("component_y")) & ((c("component_y") == c("main")) | (c("id_x") < c("id_y")))
    met = F.array_intersect("head_x", "head_y")
    crossing = x.join(y, "element").where(smaller & reach & across & ((F.size(met) == 0) | (F.get(met, F.lit(0)) == F.col("element"))))
    pairs = crossing.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()
    more = scratch.write(alike(pairs, sets, similarity), "crossing")
    out = first
    if not more.isEmpty():
        out = scratch.write(connected_components(scratch, links.unionByName(more)), "components")
    scratch.drop(stored, links, more)
    return out
