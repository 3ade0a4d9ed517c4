"""What a summary is told about a keyword, within budgets of lines and characters: packing in order by running sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Lines of either class, characters of a trigger's snippet, of all full texts together.
TRIGGERS, BACKGROUNDS, SNIPPET, FULL_TEXT = 5, 5, 200, 8000


def _first(df: DataFrame, most: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy("keyword_id").orderBy("place"))).where(F.col("__n") <= most)


def _lines(df: DataFrame, name: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    return df.groupBy("keyword_id").agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias(name))


def within_budget(texts: DataFrame, budget: int = FULL_TEXT) -> DataFrame:
    """The texts of each keyword in order of ``place``, until their characters are spent; the last one that fits in part is cut. Empty texts are left out.

    Each text spends a character at least, so no more than the first ``budget`` texts of a keyword can count: ranks cut the others off before the shuffle,
    and a keyword that most texts belong to is no larger than others.
    """
    w = Window.partitionBy("keyword_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    left = F.lit(budget) - F.coalesce(F.sum("size").over(w), F.lit(0))
    sizes = _first(texts.where(F.length("text") > 0).select("keyword_id", "place", F.length("text").alias("size")), budget).withColumn("left", left).where("left > 0")
    return texts.join(sizes.select("keyword_id", "place", "left"), ["keyword_id", "place"]).withColumn("text", F.substring("text", F.lit(1), F.col("left").cast("int"))).drop("left")


def signal_line(is_new: Column, matched: Column, latest: Column) -> Column:
    """What the ranking knows of a keyword, in one line behind its name; nothing where it knows nothing."""
    parts = F.array_compact(
        F.array(
            F.when(is_new, "first appearance on the ranking today").when(~is_new, "already on the ranking before today"),
            F.when(matched > 0, F.concat(matched.cast("string"), F.lit(" trigger article(s) matched"))),
            F.when(latest.isNotNull(), F.concat(F.lit("latest trigger article: "), F.substring(latest.cast("string"), 1, 10))),
        )
    )
    return F.when(F.size(parts) > 0, F.concat(F.lit("\nRanking signals: "), F.array_join(parts, "; "), F.lit("."))).otherwise("")


def contexts(keywords: DataFrame, triggers: DataFrame, backgrounds: DataFrame, texts: DataFrame) -> DataFrame:
    """``keyword_id, message``: the keyword and its signals, the first trigger and background lines, and full texts within their budget.

    ``keywords`` has ``keyword_id, keyword, is_new, matched, latest``; ``triggers`` and ``backgrounds`` have ``keyword_id, place, title, snippet, published_at``
    (triggers also ``domain``), ``texts`` has ``keyword_id, place, domain, text``. ``place`` is unique within a keyword. The first five triggers are taken
    before those without a title are left out.
    """
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    tag = F.when(F.col("published_at").isNotNull(), F.concat(F.lit("["), F.substring(F.col("published_at").cast("string"), 1, 10), F.lit("] "))).otherwise("")
    domain = F.when(some(F.col("domain")), F.concat(F.lit(" ("), "domain", F.lit(")"))).otherwise("")
    snippet = F.when(some(F.col("snippet")), F.concat(F.lit(": "), F.substring("snippet", 1, SNIPPET))).otherwise("")
    told = _first(triggers, TRIGGERS).where(some(F.col("title"))).withColumn("line", F.concat(F.lit("- [TRIGGER] "), tag, "title", domain, snippet))
    known = _first(backgrounds, BACKGROUNDS).withColumn("line", F.concat(F.lit("- [BACKGROUND] "), tag, F.coalesce("title", F.lit("")), F.lit(": "), F.coalesce("snippet", F.lit(""))))
    quoted = within_budget(texts.where("text is not null")).withColumn("line", F.concat(F.lit("(domain: "), F.coalesce("domain", F.lit("")), F.lit(")\n"), "text"))
    listed = F.array_sort(F.collect_list(F.struct("place", "line")))
    full = quoted.groupBy("keyword_id").agg(F.concat(F.lit("\n\n[full texts; where they differ from snippets they count]\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n\n")).alias("full"))
    out = keywords.join(_lines(told, "t"), "keyword_id", "left").join(_lines(known, "b"), "keyword_id", "left").join(full, "keyword_id", "left")
    body = F.concat_ws("\n", "t", "b")
    return out.select("keyword_id", F.concat(F.lit('Keyword: "'), "keyword", F.lit('"'), signal_line(F.col("is_new"), F.col("matched"), F.col("latest")), F.lit("\n\nContext:\n"), body, F.coalesce("full", F.lit(""))).alias("message"))
