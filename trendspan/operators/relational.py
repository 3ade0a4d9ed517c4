"""Relational building blocks: first row of a group, top-k, merges, inserts and retention.

Each is a composition of DataFrame operations with one shuffle by the group's key at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order (DISTINCT ON and ROW_NUMBER dedup)."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def numbered(df: DataFrame, by: Sequence[str], coarse: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add 1-based numbers within groups ``by``, in the order of ``coarse`` (never null) and then of ``order``.

    Rows of one ``coarse`` are numbered in one task, and start at the sizes of those before; so a group may hold any share
    of all rows.
    """
    keys = [*by, *coarse]
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__size"))
    earlier = F.sum("__size").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(*coarse)) - F.col("__size")
    before = sizes.select(*keys, earlier.alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__inside", inside).join(before, keys).withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")


def best_of(df: DataFrame, by: Sequence[str], rank: Column, columns: Sequence[str]) -> DataFrame:
    """One row for each group, the one with the largest ``rank``; aggregated before the shuffle, so hot groups are small."""
    best = df.groupBy(*by).agg(F.max_by(F.struct(*columns), rank).alias("__row"))
    return best.select(*by, *(F.col(f"__row.{c}").alias(c) for c in columns))


def upsert(target: DataFrame, source: DataFrame, key: Sequence[str], assign: dict[str, Column] | None = None) -> DataFrame:
    """Copy-on-write merge: rows of ``source`` replace those of ``target`` with the same key, others are added.

    ``assign`` gives, for columns that are not plainly overwritten, an expression over ``old.c`` and ``new.c``.
    """
    assign = assign or {}
    old, new = target.alias("old"), source.alias("new")
    on = [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in key]
    joined = old.join(new.withColumn("__new", F.lit(True)).alias("new"), on, "full_outer")
    out = []
    for c in target.columns:
        if c in key:
            out.append(F.when(F.col("new.__new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
        elif c in assign:
            out.append(assign[c].alias(c))
        elif c in source.columns:
            out.append(F.when(F.col("new.__new"), F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c))
        else:
            out.append(F.col(f"old.{c}").alias(c))
    return joined.select(*out)


def insert_if_absent(target: DataFrame, source: DataFrame, key: Sequence[str]) -> DataFrame:
    """Append the rows of ``source`` whose key is not in ``target`` (ON CONFLICT DO NOTHING); the first of equal keys."""
    fresh = source.join(target.select(*key), list(key), "left_anti")
    return target.unionByName(fresh.select(*target.columns), allowMissingColumns=True)


def keep_after(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Retention: the rows whose time is within ``days`` of ``as_of``."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days))
    return df.where(F.col(column) >= limit)
