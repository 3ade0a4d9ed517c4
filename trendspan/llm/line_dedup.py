"""Repeated runs of lines, found with a suffix array over line ids, and their later copies deleted.

Every line gets a 128-bit id, and each place in each document is a suffix: the sequence of ids from there to the
document's end. A line that occurs once can't be in a repeated run, so it only ends the suffixes before it.
Suffixes are ranked by their first line, then by prefix doubling: the rank by 2h lines is that of the pair of
the ranks by h lines here and h lines on. A rank is the number of suffixes before its class, so it needs only
the classes' sizes, and a class of suffixes with equal ranks is an interval of the array whose longest common
prefix has at least that many lines. Doubling goes on until no class of two or more is left, so the depth at which
a suffix leaves bounds its longest common prefix with any other from both sides.

A suffix is a later copy to some depth where its interval of that depth holds an earlier place, by doc_id and then by
line; its deepest such interval gives the run that it begins. A line is deleted if it lies in a run of at least
``min_lines`` lines that occurs earlier, or if it has at least ``min_chars`` characters and occurs earlier. Adjacent
deletions are the maximal repeated runs, which ``repeated_runs`` lists with their lengths and first places. Earlier and
later copies may overlap, so of a line repeated many times in a row its first occurrence stays.

Everything is DataFrame operations; no Python runs on the executors. Hot lines: counts and first places are aggregated
before the shuffle; the hottest classes, which cannot
be many, are joined by broadcast (see ``shared.join_counted``), so no task gets all suffixes of one class; and where a class has very many continuations,
these are numbered by ranges.

Edge cases: a null text stays null and a text without a later copy stays as it is; a document that loses all its
lines goes, unless ``keep_emptied``; a null doc_id comes after all others; rows equal in doc_id and text are one
document and get the same result; extra columns are kept; an empty table gives an empty table. ``n_chars``, where
there is such a column, follows the text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.llm.shared import HOT_SHARE, Scratch, join_counted, table

MIN_LINES = 4
MIN_CHARS = 40
#: Ranges of ids or ranks whose sizes are summed on their own, so that no sum over all of them runs in one task.
RANGES = 4096
_LAST = (1 << 63) - 1
_KEY = ["d", "h"]


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.withColumns({"__d": F.coalesce(F.col(key).cast("long"), F.lit(_LAST)), "__h": F.xxhash64(F.col(text))})


def line_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``d, h, n, a, b, size``: the document, the line's number, its id and its characters."""
    lines = _keyed(df.where(F.col(text).isNotNull()), key, text).select(F.col("__d").alias("d"), F.col("__h").alias("h"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("n", "line"))
    return lines.select("d", "h", "n", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"), F.length("line").alias("size"))


def _before(sizes: DataFrame, within: list[str], group: str, order: list[str]) -> DataFrame:
    """Add ``before``: the sum of ``c`` over all earlier rows with equal ``within``, by ``group`` and then by ``order``."""
    groups = sizes.groupBy(*within, group).agg(F.sum("c").alias("c"))
    # A row for each range: few, within whatever.
    earlier = groups.select(*within, group, (F.sum("c").over(Window.partitionBy(*within, F.lit(0)).orderBy(group)) - F.col("c")).alias("earlier"))
    inside = F.sum("c").over(Window.partitionBy(*within, group).orderBy(*order)) - F.col("c")
    held = sizes.withColumn("inside", inside)
    earlier = earlier if within else F.broadcast(earlier)  # RANGES rows then
    return held.join(earlier, [*within, group]).withColumn("before", F.col("earlier") + F.col("inside")).drop("earlier", "inside", group)


def suffix_array(scratch: Scratch, lines: DataFrame, depth: int = MIN_LINES) -> Iterator[tuple[int, DataFrame, bool]]:
    """The suffixes in intervals of two or more, by the least length of the interval's common prefix.

    The lengths are 1, its doubles below ``depth``, and ``depth`` and its doubles. With each comes a table of
    ``d, h, n, rank, c``, ``c`` being the interval's size, the first one with ``size`` as well; and whether it has hot
    intervals. A table is dropped when the next one is asked for.
    """
    total = max(lines.count(), 1)
    repeated = lines.groupBy("a", "b").agg(F.count("*").alias("c")).where("c > 1")
    # Ids are hashes, so ranges of them are even; a hot line is one row here.
    spread = repeated.withColumn("g", F.shiftright("a", 64 - RANGES.bit_length() + 1))
    ranked = _before(spread, [], "g", ["a", "b"]).select("a", "b", "c", F.col("before").alias("rank"))
    now, known = scratch.write(join_counted(lines, ranked, ["a", "b"], total).select("d", "h", "n", "size", "rank", "c"), "by-line"), 1
    while True:
        rows, most = now.agg(F.count("*"), F.max("c")).first()
        if not rows:
            scratch.drop(now)
            return
        hot = most > total // HOT_SHARE
        yield known, now, hot
        # Up to ``depth`` the last two windows may overlap, so that together they have ``depth`` lines.
        step = min(known, depth - known) if known < depth else known
        ahead = F.max("rank").over(Window.partitionBy(*_KEY).orderBy("n").rangeBetween(step, step))
        pairs = now.select("d", "h", "n", "rank").withColumn("next", ahead)
        # What ends within the next lines, or goes on as no other does, comes first in its interval.
        classes = pairs.groupBy("rank", F.coalesce("next", F.lit(-1).cast("long")).alias("next")).agg(F.count("*").alias("c"))
        if hot:  # then one interval may have very many continuations
            named = _before(classes.withColumn("g", F.floor(F.col("next") * RANGES / total).cast("long")), ["rank"], "g", ["next"])
        else:
            named = classes.withColumn("before", F.sum("c").over(Window.partitionBy("rank").orderBy("next")) - F.col("c"))
        named = named.where("next >= 0 and c > 1").select("rank", "next", "c", (F.col("rank") + F.col("before")).alias("finer"))
        pairs = pairs.where("next is not null")
        held = join_counted(pairs, named, ["rank", "next"], total) if hot else pairs.join(named, ["rank", "next"])
        after = scratch.write(held.select("d", "h", "n", F.col("finer").alias("rank"), "c"), "deeper")
        scratch.drop(now)
        now, known = after, known + step


def later_copies(suffixes: DataFrame, hot: bool, total: int) -> DataFrame:
    """The suffixes of each interval but its earliest, with that place as ``least``."""
    place = F.struct("d", "h", "n")
    earliest = suffixes.groupBy("rank").agg(F.min(place).alias("least"), F.count("*").alias("c")).where("c > 1")
    rows = suffixes.drop("c")
    both = join_counted(rows, earliest, ["rank"], total) if hot else rows.join(earliest, "rank")
    return both.where(place > F.col("least")).drop("c")


def later_runs(scratch: Scratch, lines: DataFrame, min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``d, h, n, depth, least``: each place that begins an earlier run, and the depth of its deepest interval."""
    total = max(lines.count(), 1)
    path, schema = scratch.path("later"), "d long, h long, n int, depth int, least struct<d: long, h: long, n: int>"
    found = lines.sparkSession.createDataFrame([], schema)  # where no line repeats
    for depth, suffixes, hot in suffix_array(scratch, lines, min_lines):
        if depth == 1:
            suffixes = suffixes.where(F.col("size") >= min_chars)
        if depth == 1 or depth >= min_lines:
            later = later_copies(suffixes, hot, total).select("d", "h", "n", F.lit(depth).alias("depth"), "least")
            later.write.mode("append").parquet(path)
            found = lines.sparkSession.read.schema(schema).parquet(path)
    return found.groupBy("d", "h", "n").agg(F.max("depth").alias("depth"), F.max_by("least", "depth").alias("least"))


def deleted_lines(runs: DataFrame) -> DataFrame:
    """``d, h, dead``: the numbers of each document's lines that go, in order."""
    lines = runs.select("d", "h", F.explode(F.sequence("n", F.col("n") + F.col("depth") - 1)).alias("n"))
    return lines.groupBy(*_KEY).agg(F.array_sort(F.collect_set("n")).alias("dead"))


def repeated_runs(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, line, n_lines, first_doc_id, first_line`` of the maximal runs of deleted lines.

    The first place is that of the run's first line at its deepest interval; a run may go on with lines of other places.
    """
    scratch = Scratch(spark, "runs")
    runs = scratch.write(later_runs(scratch, scratch.write(line_table(df, key, text).distinct(), "lines"), min_lines, min_chars), "found")
    by_doc = Window.partitionBy(*_KEY).orderBy("n")
    reach = F.max(F.col("n") + F.col("depth")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("n") > reach, F.lit(True)).cast("int")
    grouped = runs.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by_doc)).groupBy(*_KEY, "run")
    out = grouped.agg(F.min("n").alias("line"), F.max(F.col("n") + F.col("depth")).alias("end"), F.min_by("least", "n").alias("least"))
    real = lambda c: F.when(c != _LAST, c)
    return out.select(real(F.col("d")).alias("doc_id"), "line", (F.col("end") - F.col("line")).alias("n_lines"), real(F.col("least.d")).alias("first_doc_id"), F.col("least.n").alias("first_line"))


def _without(lines: Column, dead: Column) -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dead)
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def dedup_lines(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = MIN_LINES, min_chars: int = MIN_CHARS, keep_emptied: bool = False, removed: str | None = None) -> DataFrame:
    """``df`` without the later copies of repeated runs of lines; ``removed`` names a column to count them in."""
    scratch = Scratch(spark, "lines")
    lines = scratch.write(line_table(df, key, text), "lines")
    dead = scratch.write(deleted_lines(later_runs(scratch, lines, min_lines, min_chars)), "dead")
    scratch.drop(lines)
    scratch.release()
    columns = df.columns
    # The lines cross the join as an array, so that each text is split once.
    split = _keyed(df, key, text).withColumn("__lines", F.split(F.col(text), "\n", -1)).drop(text)
    marks = dead.select(F.col("d").alias("__d"), F.col("h").alias("__h"), F.col("dead").alias("__dead"))
    # A null text has no lines, so its hash finds none.
    marked = split.join(marks, ["__d", "__h"], "left")
    lines_, dead_ = F.col("__lines"), F.col("__dead")
    cleaned = marked.withColumn(text, F.when(lines_.isNull(), None).when(dead_.isNull(), F.array_join(lines_, "\n")).otherwise(_without(lines_, dead_)))
    if not keep_emptied:
        cleaned = cleaned.where(dead_.isNull() | (F.size(dead_) < F.size(lines_)))
    out = {c: F.col(c) for c in columns}
    if "n_chars" in out:
        out["n_chars"] = F.when(dead_.isNull(), F.col("n_chars")).otherwise(F.length(text).cast(df.schema["n_chars"].dataType))
    if removed:
        out[removed] = F.when(dead_.isNull(), 0).otherwise(F.size(dead_))
    return cleaned.select(*(c.alias(n) for n, c in out.items()))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents"), removed="removed_lines").select("doc_id", "text", "removed_lines")


#: The same decision by windows over all lines, without a suffix array.
OP3_SQL = f"""
WITH lines AS (
  SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS n, unnest(string_split(text, chr(10))) AS line FROM documents
), windows AS (
  SELECT *, CASE WHEN lead(line, {MIN_LINES - 1}) OVER w IS NULL THEN NULL
    ELSE md5(line) || {" || ".join(f"md5(lead(line, {i}) OVER w)" for i in range(1, MIN_LINES))} END AS win
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY n)
), firsts AS (
  SELECT doc_id, text, n, line,
    length(line) >= {MIN_CHARS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS single,
    win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, n) > 1 AS later
  FROM windows
), marked AS (
  SELECT doc_id, n, line, single OR bool_or(later) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN {MIN_LINES - 1} PRECEDING AND CURRENT ROW) AS dead
  FROM firsts
)
SELECT doc_id, string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT dead) AS text, CAST(count(*) FILTER (WHERE dead) AS INTEGER) AS removed_lines
FROM marked GROUP BY doc_id HAVING count(*) FILTER (WHERE NOT dead) > 0
"""
