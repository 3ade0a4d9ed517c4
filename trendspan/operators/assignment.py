"""Assignments that are folds over an order, made in parallel rounds: who comes first gets what it asks for.

Each round looks at every row that is still open at once, settles those whose turn depends on no other, and closes what they
took. A chain of rows that wait for one another takes as many rounds as it is long, any number of independent ones takes one. Every
round ends in a reliable checkpoint. Only minima are taken per key, which are combined before they are shuffled, so a key that a third
of all rows ask for is no larger than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspan.operators.ranking import checkpoint_dir


def first_free(wants: DataFrame) -> DataFrame:
    """``place, id``: each place in order takes the first of its wanted ids that no place before it has taken.

    ``wants`` has ``place, at, id``: a place's ids in the order ``at``; an id that it names twice counts once. Each place asks for its first
    id, the earliest of those who ask for an id holds it, and who comes later than the holder strikes it off. As all
    ids prefer places alike, what nobody is struck off from any more is what the fold gives. Places that get nothing have no row.
    """
    checkpoint_dir(wants.sparkSession)
    left = wants.groupBy("place", "id").agg(F.min("at").alias("at")).checkpoint()
    while True:
        asked = left.groupBy("place").agg(F.min_by("id", "at").alias("id"))
        holders = asked.groupBy("id").agg(F.min("place").alias("holder")).checkpoint()
        seen = left.join(holders, "id", "left")
        after = seen.where(F.col("holder").isNull() | (F.col("place") <= F.col("holder"))).drop("holder").checkpoint()
        if after.count() == left.count():
            return holders.select(F.col("holder").alias("place"), "id")
        left = after


def all_free(claims: DataFrame) -> DataFrame:
    """``place`` of the rows that get everything they claim, in order: a row that claims what one before it has got gets nothing.

    ``claims`` has ``place, claim``. A row whose claims are each first claimed by itself, among the open ones, gets them; whoever claims one of
    these is out.
    """
    checkpoint_dir(claims.sparkSession)
    left = claims.distinct().checkpoint()
    got = []
    while not left.isEmpty():
        first = left.groupBy("claim").agg(F.min("place").alias("first"))
        judged = left.join(first, "claim")
        winners = judged.groupBy("place").agg(F.min(F.col("place") == F.col("first")).alias("wins")).where("wins").select("place").checkpoint()
        got.append(winners)
        taken = left.join(winners, "place", "left_semi").select("claim").distinct()
        out = left.join(taken, "claim", "left_semi").select("place").distinct()
        left = left.join(out, "place", "left_anti").checkpoint()
    result = got[0] if got else claims.select("place").limit(0)
    for more in got[1:]:
        result = result.unionByName(more)
    return result
