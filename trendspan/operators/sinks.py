"""Documents, metrics and messages written from ranked rows.

Each sink first makes its output as rows, with ordered aggregation in Spark; writing them is a plain writer call.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspan.functions import text as tx


def ordered_concat(order: Column, text: Column, separator: str = "\n") -> Column:
    """The texts of a group in order, as one text."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), separator)


def daily_markdown(df: DataFrame) -> DataFrame:
    """``day, position, title, link, tags``: a document for each day with its tags in front, slashes made underscores."""
    tags = F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("tags")), lambda t: F.replace(t, F.lit("/"), F.lit("_")))))
    line = F.concat(F.lit("- ["), "title", F.lit("]("), "link", F.lit(")"))
    body = df.groupBy("day").agg(tags.alias("tags"), ordered_concat(F.col("position"), line).alias("body"))
    head = F.concat(F.lit("---\ntags:"), F.when(F.size("tags") > 0, F.concat(F.lit("\n  - "), F.array_join("tags", "\n  - "))).otherwise(" []"), F.lit("\n---\n"))
    return body.select("day", F.concat(head, "body").alias("document"))


def repair_tags(document: Column) -> Column:
    """Front matter with an empty ``tags:`` gets an empty list."""
    return F.regexp_replace(document, r"(?m)^tags:[ \t]*$(?!\n[ \t]+-)", "tags: []")


def messages(df: DataFrame, by: str, most: int = 5, width: int = 100) -> DataFrame:
    """``by, category, position, title, summary``: the first rows of each group as a message, a blank line between categories."""
    w = Window.partitionBy(by).orderBy("position")
    top = df.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    top = top.withColumn("broken", F.coalesce(F.lag("category").over(w) != F.col("category"), F.lit(False)))
    line = F.concat(F.when(F.col("broken"), "\n").otherwise(""), F.col("n").cast("string"), F.lit(". "), "title", F.lit(" - "), tx.truncate_at_sentence(F.col("summary"), width))
    return top.groupBy(by).agg(ordered_concat(F.col("n"), line).alias("message"))


def answer_lines(df: DataFrame) -> DataFrame:
    """``rank, keyword, delta_rank, is_new`` as markdown lines with a badge for the change of rank."""
    badge = F.when(F.col("is_new"), "NEW").when(F.col("delta_rank") > 0, F.concat(F.lit("▲"), F.col("delta_rank").cast("string"))).when(F.col("delta_rank") < 0, F.concat(F.lit("▼"), F.abs("delta_rank").cast("string"))).otherwise("-")
    return df.withColumn("line", F.concat(F.lit("**"), F.col("rank").cast("string"), F.lit(".** "), "keyword", F.lit(" ("), badge, F.lit(")")))
