"""Matching of a catalogue of keywords, of any size, against texts in one pass over the texts for each block of keywords.

A keyword's terms are itself, its aliases, and what is left of those with Hangul once that is off. A term asks for needles: one of
up to two letters for itself as a whole word, one with a single significant word for itself anywhere, another one for each of
its significant words anywhere. All needles of a block of keywords make one Aho-Corasick automaton, so a text is read once however many
keywords there are. A term is looked up by the needle that fewest terms of the block ask for, and holds if its other needles
were found in the same text.

Keywords are dealt into blocks by a hash of their id, of a bounded number of letters each; only one block at a time passes
through the driver on its way to the executors. Blocks add scans, not memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspan.functions import text as tx

#: Letters of a block's needles.
BLOCK_LETTERS = 1_000_000
#: Matches of a batch that goes back to Spark.
BATCH_MATCHES = 50_000


def terms(keyword: Column, aliases: Column) -> Column:
    """An array of ``whole, needles``: what each term of a keyword asks for. Empty terms ask for nothing and are left out."""
    named = F.filter(F.concat(F.array(keyword), F.coalesce(aliases, F.array().cast("array<string>"))), lambda t: t.isNotNull() & (t != ""))
    # A variant of Hangul only is null or too short.
    every = F.concat(named, F.filter(F.transform(named, tx.ascii_variant), lambda t: t.isNotNull()))

    def asked(term: Column) -> Column:
        words = tx.significant_words(F.trim(F.regexp_replace(term, r"\s+", " ")))
        whole = F.length(term) <= 2
        return F.struct(whole.alias("whole"), F.when(whole | (F.size(words) <= 1), F.array(F.lower(term))).otherwise(F.array_distinct(words)).alias("needles"))

    return F.array_distinct(F.transform(every, asked))


class Block:
    """A block's automaton, built in a Python worker from its keywords' terms."""

    def __init__(self, catalogue: list[list[tuple[bool, list[str]]]]):
        import ahocorasick

        asked = Counter((whole, n) for ts in catalogue for whole, needles in ts for n in needles)
        number = {key: k for k, key in enumerate(asked)}
        self.by_needle: list[list[tuple[int, frozenset[int]]]] = [[] for _ in number]
        for k, ts in enumerate(catalogue):
            for whole, needles in ts:
                seed = min(needles, key=lambda n: asked[whole, n])
                self.by_needle[number[whole, seed]].append((k, frozenset(number[whole, n] for n in needles if n != seed)))
        self.words, self.anywhere = ahocorasick.Automaton(), ahocorasick.Automaton()
        for (whole, needle), k in number.items():
            (self.words if whole else self.anywhere).add_word(needle, (k, len(needle)) if whole else k)
        for a in (self.words, self.anywhere):
            if len(a):
                a.make_automaton()

    def matches(self, text: str) -> list[int]:
        """The places in the catalogue of the keywords that a text in lower case holds."""
        found = {k for _, k in self.anywhere.iter(text)} if len(self.anywhere) else set()
        if len(self.words):
            found |= {k for end, (k, n) in self.words.iter(text) if k not in found and _bounded(text, end + 1 - n, end + 1)}
        return list({k for n in found for k, rest in self.by_needle[n] if rest <= found})


def _letter(text: str, at: int) -> bool:
    return 0 <= at < len(text) and text[at].isascii() and (text[at].isalnum() or text[at] == "_")


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether a word's bound is on either side: a word character on one side only."""
    return _letter(text, start - 1) != _letter(text, start) and _letter(text, end - 1) != _letter(text, end)


#: The worker's automaton of the block that it worked on last.
_LAST: dict[str, object] = {"of": None, "block": None}


def _block(name: str, held: Broadcast) -> Block:
    if _LAST["of"] != name:
        _LAST.update(of=name, block=Block(held.value))
    return _LAST["block"]


def match(items: DataFrame, keywords: DataFrame, body: str = "body", carried: Sequence[str] = (), letters: int = BLOCK_LETTERS) -> DataFrame:
    """``keyword_id`` and the ``carried`` columns of ``items`` for every keyword that an item's body holds.

    ``keywords`` has ``keyword_id, keyword, aliases``; of rows that share an id each matches by itself, and their matches are
    distinct. Null bodies match nothing.
    """
    import uuid

    spark = items.sparkSession
    catalogue = keywords.select("keyword_id", terms(F.col("keyword"), F.col("aliases")).alias("terms")).where(F.size("terms") > 0)
    catalogue = catalogue.groupBy("keyword_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    size = F.aggregate("terms", F.lit(0).cast("long"), lambda n, t: n + F.aggregate(t.needles, F.lit(0).cast("long"), lambda m, x: m + F.length(x)))
    total = catalogue.agg(F.sum(size)).first()[0] or 0
    blocks = max(1, -(-total // letters))
    columns = list(carried)
    fields = [T.StructField("keyword_id", keywords.schema["keyword_id"].dataType), *(items.schema[c] for c in columns)]
    rows = items.select(F.lower(body).alias("__body"), *columns)

    def block_matches(b: int) -> DataFrame:
        some = catalogue.where(F.pmod(F.xxhash64("keyword_id"), F.lit(blocks)) == b).collect()
        name = uuid.uuid4().hex
        ids = [r.keyword_id for r in some]
        held = spark.sparkContext.broadcast([[(t.whole, list(t.needles)) for t in r.terms] for r in some])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _block(name, held)
            for batch in batches:
                at, hits = [], []
                for i, text in enumerate(batch.column(0)):
                    found = block.matches(text.as_py() or "")
                    at += [i] * len(found)
                    hits += found
                    if len(hits) >= BATCH_MATCHES:
                        yield filled(batch, at, hits)
                        at, hits = [], []
                yield filled(batch, at, hits)

        def filled(batch: pa.RecordBatch, at: list[int], hits: list[int]) -> pa.RecordBatch:
            rows = pa.array(at, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in hits], id_type), *(batch.column(1 + c).take(rows) for c in range(len(columns)))], ["keyword_id", *columns])

        return rows.mapInArrow(run, T.StructType(fields))

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(fields[0].dataType)
    out = block_matches(0)
    for b in range(1, blocks):
        out = out.unionByName(block_matches(b))
    return out
