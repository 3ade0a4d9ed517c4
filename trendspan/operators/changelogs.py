"""Changelogs of providers: a state machine over a page's lines, by functions over the array of them.

A line that is a date opens an entry; the lines behind it are its body until the next date, or until the body has grown beyond 1,200
characters. A page is one value of a row and its lines are made of it as a whole, so the entries are cut out there and nothing is shuffled. Of each
entry only as many lines are looked at as a body can hold, so a page takes time in proportion to its length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendspan.functions import text as tx

# Names of months, what tells a release, what is of little value, and how launches are put.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
EXACT_DATE = r"(?i)^(" + "|".join(MONTHS) + r")\s+(\d{1,2})(?:,\s+(\d{4}))?$"
ANY_DATE = r"(?i)\b(?:" + "|".join(MONTHS) + r")\s+\d{1,2}(?:,\s+\d{4})?\b"
RELEASE = r"(?i)\b(model|models|api|apis|sdk|agent|agents|coding|code|tool|tools|mcp|responses|reasoning|embedding|embeddings|fine[- ]?tuning|batch|structured outputs?|function calling|computer use|code execution|released|available|launched|preview|generally available)\b"
LOW_VALUE = r"(?i)\b(billing|invoice|invoices|typo|documentation typo|docs typo|dashboard filter|dashboard filters|minor bug fixes?|performance improvements and bug fixes|deprecat(?:e|ed|ion)|retire(?:d|ment)?)\b"
SUBJECTS = [
    r"(?i)\b(?:we(?:'ve| have)?|we)\s+(?:launched|released|introduced)\s+([^,;()]+)(?:\s*\([^)]*\))?",
    r"(?i)^(?:released|launched|introduced)\s+([^,;()]+)(?:\s*\([^)]*\))?",
    r"(?i)\b(.+?)\s+(?:is|are)\s+now\s+available\b",
    r"(?i)\b(.+?)\s+(?:is|are)\s+available\b",
]
MOST_BODY, MOST_TITLE, FUTURE_DAYS = 1200, 96, 7
#: Lines that a body holds at most: each has a character or more and a blank before the next.
MOST_LINES = MOST_BODY // 2 + 1


def text_lines(html: Column) -> Column:
    """The lines of a page's text that hold anything."""
    t = F.regexp_replace(html, r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    t = F.regexp_replace(t, r"(?i)</(?:h[1-6]|p|li|div|article|section)>|<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    return F.filter(F.transform(F.split(t, r"\n+"), tx.collapse), lambda x: x != "")


def provider_date(heading: Column, now: Column) -> Column:
    """The date of a heading; without a year it is this year's, and more than a week ahead it is the year before. Days beyond a month's end run on."""
    month = F.array_position(F.array(*(F.lit(m.lower()) for m in MONTHS)), F.lower(F.regexp_extract(heading, EXACT_DATE, 1))).cast("int")
    day = F.regexp_extract(heading, EXACT_DATE, 2).try_cast("int")
    year = F.coalesce(F.regexp_extract(heading, EXACT_DATE, 3).try_cast("int"), F.year(now))
    ok = heading.rlike(EXACT_DATE) & day.between(1, 31)
    of = lambda y: F.date_add(F.make_date(y, month, F.lit(1)), day - 1)
    return F.when(ok, F.when(of(year) > F.date_add(F.to_date(now), FUTURE_DAYS), of(year - 1)).otherwise(of(year)))


def entries(pages: DataFrame, keys: Sequence[str], html: str = "html", segment: int | None = None) -> DataFrame:
    """``keys, n, heading, body``: the dated entries of pages, by the number of the line that opens each. ``keys`` tell pages apart.

    ``segment`` has no effect any more: pages were once cut into segments of so many lines.
    """

    def body(lines: Column) -> Column:
        # A line belongs to the body unless what is there before it, joined by blanks, is too long already.
        longer = lambda t, line: F.when(F.length(t) > MOST_BODY, t).when(t == "", line).otherwise(F.concat(t, F.lit(" "), line))
        return F.aggregate(lines, F.lit(""), longer)

    def found(lines: Column, opens: Column) -> Column:
        # Where the entries start, counted from one; an entry ends before the next one, the last with the page.
        upto = lambda i: F.coalesce(F.get(opens, i + 1), F.size(lines) + 1)
        own = lambda o, i: F.slice(lines, o + 1, F.least(upto(i) - o - 1, F.lit(MOST_LINES)))
        entry = lambda o, i: F.struct((o - 1).alias("n"), F.get(lines, o - 1).alias("heading"), body(own(o, i)).alias("body"))
        return F.transform(opens, entry)

    def opens(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.when(x.rlike(EXACT_DATE), i + 1))
        return F.array_compact(numbered)

    every = tx.once(text_lines(F.col(html)), lambda lines: tx.once(opens(lines), lambda o: found(lines, o)))
    return pages.select(*keys, F.inline(every)).where("body <> ''")


def clean_body(body: Column, heading: Column) -> Column:
    """A body without its heading said again, dates and badges."""
    quoted = F.regexp_replace(heading, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    # Values that are named several times are computed once: else each step would repeat all before it.
    t = F.regexp_replace(body, F.concat(F.lit("(?i)^(?:"), quoted, F.lit(r"\s*)+")), F.lit(""))
    # Only the first date goes; the rest of the body follows it whole.
    part = lambda t, k: F.regexp_extract(t, rf"(?s)^(.*?)({ANY_DATE})(.*)$", k)
    t = tx.once(t, lambda t: F.when(t.rlike(ANY_DATE), F.concat(part(t, 1), F.lit(" "), part(t, 3))).otherwise(t))
    t = F.regexp_replace(t, r"(?<=[a-z])(?=(Released|Added|Launched|Introduced)\b)", " ")
    t = F.regexp_replace(t, r"\b(Update|Feature|MODEL RELEASED|API UPDATED|New)\b", " $1 ")
    t = tx.collapse(F.regexp_replace(t, r"\s+([,.;:])", "$1"))

    def from_action(t: Column) -> Column:
        # What stands before an action, of eight words at most, goes; words are taken whole, so that no text takes long.
        action = F.regexp_extract(t, r"(?i)^(?:[a-z0-9_/-]++\s++){0,9}(Released|Added|Launched|Introduced)\b", 1)
        return tx.once(action, lambda a: F.when(a != "", F.substring(t, F.instr(t, a), F.length(t))).otherwise(t))

    def last(t: Column) -> Column:
        plain = F.regexp_replace(t, r"(?i)^(?:Update|Feature|New)\s+(?:v\d+/[a-z0-9_/-]++\s*+)+", "")
        return F.trim(tx.once(plain, lambda p: F.when(p != t, p).otherwise(from_action(t))))

    return tx.once(t, last)


def item_title(provider: Column, body: Column) -> Column:
    """What a body's first sentence about a release launches, or the sentence; 96 characters at most, with the provider."""
    tail = r"(?i)\s+(is|are)\s+now\s+available\b.*$", r"(?i)\s+(is|are)\s+available\b.*$", r"(?i)\s+launched\b.*$"

    def headline(sentence: Column) -> Column:
        subjects = [F.nullif(F.trim(F.regexp_replace(tx.collapse(F.regexp_extract(sentence, p, 1)), r"\.$", "")), F.lit("")) for p in SUBJECTS]
        h = F.coalesce(F.when(sentence.rlike(RELEASE), F.coalesce(*subjects)), sentence)
        for t in tail:
            h = F.regexp_replace(h, t, "")
        return F.trim(F.regexp_replace(tx.collapse(h), r"\.$", ""))

    cut = lambda h: F.when(F.length(h) > MOST_TITLE, F.concat(F.trim(F.substring(h, 1, MOST_TITLE - 3)), F.lit("..."))).otherwise(h)
    told = lambda short: F.when(F.contains(F.lower(short), F.lower(provider)), short).otherwise(F.concat(provider, F.lit(": "), short))
    first = lambda text: F.coalesce(F.get(F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s.rlike(RELEASE)), F.lit(0)), text)
    sentence = tx.once(tx.collapse(body), first)
    return tx.once(tx.once(tx.once(sentence, headline), cut), told)


def release_items(pages: DataFrame, keys: Sequence[str], now: str, hours: int = 72) -> DataFrame:
    """``keys, n, title, published_at, summary``: the useful entries of the window, each title once a provider. ``pages`` has ``provider`` among its keys."""
    at = F.lit(now).cast("timestamp_ntz")
    # Entries outside the window can neither be items nor stand for others, as equal ones are of one date; bodies are cleaned for the rest.
    dated = entries(pages, keys).withColumn("published_at", provider_date(F.col("heading"), at).cast("timestamp_ntz"))
    dated = dated.where(F.col("published_at") > at - F.make_dt_interval(hours=F.lit(hours)))
    real = dated.withColumn("body", clean_body(F.col("body"), F.col("heading"))).where("body <> ''").withColumn("begin", F.substring("body", 1, 120))
    first = lambda df, by: df.groupBy(*by).agg(F.min_by(F.struct(*(c for c in df.columns if c not in by)), "n").alias("r")).select(*by, "r.*")
    once = first(real, [*keys, "published_at", "begin"])
    useful = once.where(F.col("body").rlike(RELEASE) & ~F.col("body").rlike(LOW_VALUE))
    titled = useful.withColumn("title", item_title(F.col("provider"), F.col("body"))).withColumn("low", F.lower("title"))
    return first(titled, [*keys, "low"]).select(*keys, "n", "title", "published_at", F.substring("body", 1, 500).alias("summary"))
