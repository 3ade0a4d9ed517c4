"""Conversations from reply trees, formatted with a loss mask.

A message replies to at most one other, so the messages of a conversation form trees. Every leaf ends one
root-to-leaf path. Paths are enumerated by self-joins that double their reach: first each message's ancestor 2^k
replies up, for rising k, then for falling k every message found so far finds the one 2^k above it. So a path of
n messages takes about log2(n) joins, and the rows are those of the paths themselves. A branch's score is the sum
of its messages' scores; branches of a conversation are ranked by score, then by leaf.

A path is written as pieces, one for each turn, in order; the conversation is the pieces end to end, and a piece
stays small however long the conversation is. The template is

    <|turn|>role\\n text <|end|>\\n        (without the blanks)

Inside roles and texts a backslash and, behind its first character, every control string gets a backslash, so that
neither the template's marks nor those of other templates can occur, and dropping one backslash before each escaped
character gives the text back. A line feed inside a role is escaped likewise. The loss mask is the span of the
assistant's escaped text in its piece.

Edge cases: null texts and roles are empty; a null conv_id is a conversation of its own; in linear conversations
rows go by turn (null first), then by role and text, so repeated rows are turns of their own; a reply to a message
that isn't there starts a tree; messages that reply to each other in a ring have no root or leaf and are left out;
extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.llm.shared import Scratch, table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of common templates: the first character, and what makes it one.
CONTROL = r"([<\[])(?=\||/?s>|/?INST\]|<SYS>>|</SYS>>)"
NO_CONVERSATION = -(1 << 63)


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    # A line feed is the only escape that a letter n can follow: no control string has one second.
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def linear_tree(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` as messages ``tree, id, parent, role, text, score``: each replies to the one before."""
    order = Window.partitionBy("tree").orderBy("turn", "role", "text")
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONVERSATION)).alias("tree"), "turn", "role", "text")
    numbered = rows.withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.select("tree", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(scratch: Scratch, messages: DataFrame) -> DataFrame:
    """``tree, leaf, id, up``: every message of every root-to-leaf path, and how many replies it is above the leaf."""
    nodes = messages.select("tree", "id", "parent")
    present = nodes.select("tree", F.col("id").alias("parent"))
    jump = scratch.write(nodes.where("parent is not null").join(present, ["tree", "parent"], "left_semi").select("tree", "id", F.col("parent").alias("above")), "jump")
    leaves = nodes.join(jump.select("tree", F.col("above").alias("id")), ["tree", "id"], "left_anti")
    jumps = []
    while not jump.isEmpty():
        jumps.append(jump)
        if len(jumps) > 62:  # only rings of replies go on for ever, and no leaf reaches them
            break
        far = jump.select("tree", F.col("id").alias("above"), F.col("above").alias("further"))
        jump = scratch.write(jump.join(far, ["tree", "above"]).select("tree", "id", F.col("further").alias("above")), "jump")
    found = [scratch.write(leaves.select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")), "found")]
    for k in range(len(jumps) - 1, -1, -1):
        so_far = found[0]
        for f in found[1:]:
            so_far = so_far.unionByName(f)
        more = so_far.join(jumps[k], ["tree", "id"]).select("tree", "leaf", F.col("above").alias("id"), (F.col("up") + (1 << k)).alias("up"))
        found.append(scratch.write(more, "found"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def branches(scratch: Scratch, messages: DataFrame, best: int | None = None) -> DataFrame:
    """``tree, branch, turn, role, text``: the turns of every path, branches ranked from 1; ``best`` keeps that many."""
    steps = paths(scratch, messages).join(messages.select("tree", "id", "role", "text", "score"), ["tree", "id"])
    steps = scratch.write(steps, "steps")
    scores = steps.groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.max("up").alias("top"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc_nulls_last("total"), "leaf"))
    ranked = scores.withColumn("branch", rank).drop("total")
    if best is not None:
        ranked = ranked.where(F.col("branch") <= best)
    return steps.join(ranked, ["tree", "leaf"]).select("tree", "branch", (F.col("top") - F.col("up")).alias("turn"), "role", "text")


def format_turns(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """``tree, branch, turn, piece, loss_from, loss_to``; the mask's ends are null where there is nothing to learn."""
    head = F.concat(F.lit(TURN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    text = escape(F.coalesce("text", F.lit("")))
    learnt = F.col("role") == learn_from
    start = F.when(learnt, F.length("head"))
    return turns.select("tree", "branch", "turn", head.alias("head"), text.alias("body"), "role").select(
        "tree", "branch", "turn", F.concat("head", "body", F.lit(END + "\n")).alias("piece"), start.alias("loss_from"), (start + F.length("body")).alias("loss_to")
    )


def read_turns(pieces: DataFrame) -> DataFrame:
    """Add ``role``, ``text`` and ``learnt`` (the unescaped text under the mask, or null), parsed from the pieces."""
    body = F.col("piece").substr(F.lit(len(TURN) + 1), F.length("piece") - (len(TURN) + len(END) + 1))
    at = F.instr("body", "\n")
    masked = F.when(F.col("loss_from").isNotNull(), unescape(F.col("piece").substr(F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from"))))
    return (
        pieces.withColumn("body", body)
        .withColumn("role", unescape_role(F.col("body").substr(F.lit(1), at - 1)))
        .withColumn("text", unescape(F.col("body").substr(at + 1, F.length("body"))))
        .withColumn("learnt", masked)
        .drop("body")
    )


DIGESTS = "conv_id long, branch int, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(read: DataFrame) -> DataFrame:
    """A row for each path, over its turns in order; they stream through, so no conversation is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, turns, loss, loss_chars, chars = None, 0, None, None, 0, 0
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["conv_id", "branch", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for tree, branch, role, text, learnt, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tree, branch) != now:
                    if now is not None:
                        rows.append((*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, n, turns, loss, loss_chars, chars = (tree, branch), 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                n, chars = n + 1, chars + size
                turns.update(f"{role}\n{text}\n".encode())
                if learnt is not None:
                    loss.update(learnt.encode())
                    loss_chars += len(learnt)
            if len(rows) > 1000:
                yield flush()
                rows = []
        if now is not None:
            rows.append((*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            yield flush()

    dealt = read.repartition("tree", "branch").sortWithinPartitions("tree", "branch", "turn")
    out = dealt.select("tree", "branch", "role", "text", "learnt", F.length("piece").alias("size")).mapInArrow(run, DIGESTS)
    return out.withColumn("conv_id", F.when(F.col("conv_id") != NO_CONVERSATION, F.col("conv_id")))


def format_conversations(scratch: Scratch, messages: DataFrame, best: int | None = None) -> DataFrame:
    """The written and reread pieces of every chosen path of the reply trees."""
    return scratch.write(format_turns(branches(scratch, messages, best)), "formatted")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "chat")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    messages = scratch.write(linear_tree(rows), "messages")
    return digests(read_turns(format_conversations(scratch, messages))).drop("branch")


_TURNS = """
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
"""
OP6_SQL = (
    _TURNS
    + r"""e AS (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS t,
    length(regexp_replace(replace(coalesce(text, ''), '\', '\\'), '<\||</?s>|\[/?INST\]|<<SYS>>|<</SYS>>', '\0\\', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + n + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
)
