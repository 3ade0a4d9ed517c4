"""What is shown of keywords and titles in another language: classes of keywords, titles in few calls, answers joined back.

The calls themselves are outside; what they are asked and what becomes of their answers is here. Every row has a result, whatever an answer lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trendspan.functions import text as tx

#: Calls that one batch's titles of a language go into at most.
MOST_CALLS = 4


def answer_lines(reply: Column) -> Column:
    """The lines of an answer without their numbers; an answer of one line is parted at its numbers."""
    text = F.trim(F.regexp_replace(reply, r"^\s+|\s+$", ""))
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*\d+[.)\-:]\s+(?=\D)", ""))), lambda x: x != "")
    parts = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)\d+[.)]\s+(.+?)(?=\s+\d+[.)]\s+|$)"), 1), F.trim), lambda x: x != "")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).when((F.size(lines) > 1) | (F.size(parts) == 0), lines).otherwise(parts)


def classify(keywords: DataFrame, natural: DataFrame, concepts: DataFrame) -> DataFrame:
    """``keyword_id, keyword, action, localized``: how a keyword is shown to Korean readers.

    A keyword in Hangul, a name, or what is in no list is kept; one in ``natural`` (``form, localized``) has a form of its own; of ``concepts`` (``word,
    localized``) all words make a keyword a concept, which is put word by word. Both lists go by lower case.
    """
    low = keywords.withColumn("low", F.lower(tx.collapse(F.col("keyword"))))
    has = low.join(natural.select(F.lower("form").alias("low"), F.col("localized").alias("__natural")), "low", "left")
    words = low.where(~F.col("keyword").rlike(tx.ANY_HANGUL)).select("keyword_id", F.posexplode(F.split("low", " ")).alias("at", "word")).where("word <> ''")
    known = words.join(concepts.select(F.lower("word").alias("word"), F.col("localized").alias("said")), "word", "left")
    listed = F.array_sort(F.collect_list(F.struct("at", "said")))
    said = known.groupBy("keyword_id").agg(F.count_if(F.col("said").isNull()).alias("unknown"), F.array_join(F.transform(listed, lambda x: x["said"]), " ").alias("said")).where("unknown = 0").select("keyword_id", "said")
    joined = has.join(said, "keyword_id", "left")
    hangul = F.col("keyword").rlike(tx.ANY_HANGUL)
    action = F.when(hangul, "keep").when(F.col("__natural").isNotNull(), "natural").when(F.col("said").isNotNull(), "translate").otherwise("keep")
    return joined.select("keyword_id", "keyword", action.alias("action"), F.when(action == "natural", F.col("__natural")).when(action == "translate", F.col("said")).otherwise(F.col("keyword")).alias("localized"))


def title_calls(titles: DataFrame, most: int = MOST_CALLS) -> DataFrame:
    """``batch, target, call, place, position, title``: which titles go into which call, in order and of about equal length.

    ``titles`` has ``batch, position, title``; a title with Hangul is put into English, another one into Korean. Titles of a batch are ranked by one running sum of their
    lengths; a call holds what falls into its share of the sum. Batches are snapshots, of a few hundred titles.
    """
    rows = titles.where(F.length(F.trim("title")) > 0).withColumn("target", F.when(F.col("title").rlike(tx.ANY_HANGUL), "en").otherwise("ko"))
    by = Window.partitionBy("batch", "target")
    upto = F.sum(F.length("title")).over(by.orderBy("position").rowsBetween(Window.unboundedPreceding, -1))
    share = F.floor(F.coalesce(upto, F.lit(0)) * most / F.sum(F.length("title")).over(by)).cast("int")
    placed = rows.withColumn("call", share)
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("batch", "target", "call").orderBy("position"))).select("batch", "target", "call", "place", "position", "title")


def prompts(calls: DataFrame) -> DataFrame:
    """``batch, target, call, n, lines``: the numbered titles of each call."""
    listed = F.array_sort(F.collect_list(F.struct("place", "title")))
    return calls.groupBy("batch", "target", "call").agg(F.count("*").alias("n"), F.array_join(F.transform(listed, lambda x: F.concat(x["place"].cast("string"), F.lit(". "), x["title"])), "\n").alias("lines"))


def joined_answers(calls: DataFrame, replies: DataFrame) -> DataFrame:
    """``batch, position, title, localized``: each title with its line of the answer, or as it is where the answer has none. ``replies`` has ``batch, target, call, reply``."""
    keys = ["batch", "target", "call"]
    lines = replies.select(*keys, F.posexplode(answer_lines(F.col("reply"))).alias("at", "line")).select(*keys, (F.col("at") + 1).alias("place"), "line")
    return calls.join(lines, [*keys, "place"], "left").select("batch", "position", "title", F.coalesce("line", "title").alias("localized"))
