"""Passages that repeat across documents: paragraph MinHash, banding, exact verification, components.

A paragraph is a line, cut after each sentence that has at least ``CLOSING_WORDS`` words; shorter sentences belong to
the next one. What goes on for more than ``LONG_SENTENCE`` words without an end, as lists or unpunctuated text do, is cut by
its content, between words whose hashes say so. So a passage falls into the same paragraphs wherever it is embedded, but for its ends. Every paragraph of at least ``MIN_WORDS`` words gets a MinHash signature over its 5-word shingles. With ``BANDS`` bands of ``ROWS``
values, two paragraphs of similarity s share a bucket with probability 1 - (1 - s^ROWS)^BANDS: 0.98 at s = 0.8, 0.999
at 0.9, and always where they are equal. So few short bands sort out the paragraphs that nothing is like. The rest, a few
hundredths, are banded again with many long bands, ``FINE_BANDS`` of ``FINE_ROWS``: 0.99 at s = 0.8, but 0.003 for the
many edited copies of one sentence that are alike by a third only, which short bands would all throw together.
Paragraphs that share a fine bucket are compared by the exact Jaccard similarity of their shingle sets, and the
components of the links found are the classes.

Of a class the paragraph first by doc_id and place stays. The others are to be removed where they are part of a stretch
of repeated paragraphs of at least ``MIN_SPAN`` words, in which one changed paragraph may stand between two repeated
ones; a shorter repeat, such as a common short sentence, is no passage.

Equal paragraphs are one member of every bucket, so copies add no pairs; see ``links`` for hot buckets.

Edge cases: null and empty texts have no paragraphs; a null doc_id comes last; rows with one doc_id, or none, are
documents of their own, ordered by a hash of their texts, and rows equal in both too (which of these stays is open, as
they cannot be told apart); texts are taken whole, whatever their length; extra columns do not matter; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.llm.links import set_components
from trendspan.llm.pieces import slices
from trendspan.llm.shared import BROADCAST_IDS, Scratch, growing, join_counted, table

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 4, 2
FINE_BANDS, FINE_ROWS = 24, 8
CLOSING_WORDS = 8
#: Sentences of more words than this are cut by their content, once in ``CUT`` pairs of words.
LONG_SENTENCE, CUT = 40, 8
MIN_WORDS = 8
MIN_SPAN = 30

_WORD = re.compile(r"\w+")
_LAST = (1 << 63) - 1

_FACTORS = np.random.default_rng(7).integers(1 << 62, 1 << 63, size=(BANDS * ROWS + FINE_BANDS * FINE_ROWS, 2), dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(8).integers(1 << 62, 1 << 63, size=max(SHINGLE, FINE_ROWS), dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) > 200_000:
            self.clear()
        self[word] = h
        return h


def paragraphs(text: str, hashes: _WordHashes | None = None) -> Iterator[tuple[int, int, list[str]]]:
    """First and last character and words of each paragraph of at least ``MIN_WORDS`` words."""
    hashes = _WordHashes() if hashes is None else hashes
    line_start = 0
    for line in text.split("\n"):
        start, words = line_start, []
        at = 0
        while at < len(line):
            stop = _sentence_end(line, at)
            found = _WORD.findall(line[at:stop].lower())
            since = 0  # words of this sentence that are in paragraphs already
            if len(found) > LONG_SENTENCE:
                for n, end in _cuts(line[at:stop], found, len(words), hashes):
                    words += found[since:n]
                    if len(words) >= MIN_WORDS:
                        yield start, line_start + at + end, words
                    start, words, since = line_start + at + end, [], n
            words += found[since:]
            if len(found) - since >= CLOSING_WORDS or stop == len(line):
                if len(words) >= MIN_WORDS:
                    yield start, line_start + stop, words
                start, words = line_start + stop, []
            at = stop
        line_start += len(line) + 1


def _cuts(sentence: str, found: list[str], before: int, hashes: _WordHashes) -> list[tuple[int, int]]:
    """Where a sentence is cut by its content: after how many of its words, and at which character.

    A cut needs ``CLOSING_WORDS`` words before it and is where the hashes of two words say so.
    """
    places = []
    last, held = 0, before
    for n, h in enumerate(map(hashes.__getitem__, found[:-1]), 1):
        held += 1
        if held >= CLOSING_WORDS and n > 1 and (last + 3 * h) % CUT == 0:
            places.append(n)
            held = 0
        last = h
    if not places:
        return []
    ends = [m.end() for m in _WORD.finditer(sentence)]
    # In rare scripts lower case has other words than the text; such a sentence stays whole.
    return [(n, ends[n - 1]) for n in places] if len(ends) == len(found) else []


_END = re.compile(r"[.!?](?=[ \t])")


def _sentence_end(line: str, at: int) -> int:
    m = _END.search(line, at)
    return m.end() if m else len(line)


def shingle_hashes(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of paragraphs, given all their words' hashes; and where each paragraph's begin.

    A paragraph shorter than a shingle is one shingle.
    """
    ends = np.cumsum(sizes)
    n = np.maximum(sizes - SHINGLE + 1, 1)
    first = np.cumsum(n) - n
    at = np.repeat(ends - sizes - first, n) + np.arange(int(n.sum()))
    last = np.repeat(ends, n)
    out = np.zeros(len(at), dtype=np.uint64)
    padded = np.concatenate([hashes, np.zeros(SHINGLE, dtype=np.uint64)])
    for k in range(SHINGLE):
        out += np.where(at + k < last, padded[at + k], np.uint64(0)) * _PLACES[k]
        out ^= out >> np.uint64(31)
    return out * _PLACES[0], first


def band_keys(shingles: np.ndarray, first: np.ndarray, bands: int = BANDS, rows: int = ROWS, skipped: int = 0) -> np.ndarray:
    """A row of bucket keys for each paragraph; ``skipped`` hash functions are left to another banding."""
    keys = np.empty((len(first), bands), dtype=np.uint64)
    for band in range(bands):
        key = np.full(len(first), band + 1, dtype=np.uint64)
        for r in range(rows):
            a, b = _FACTORS[skipped + band * rows + r]
            mixed = (shingles ^ b) * a
            mixed ^= mixed >> np.uint64(32)
            key = (key ^ np.minimum.reduceat(mixed * b, first)) * _PLACES[r]
            key ^= key >> np.uint64(29)
        keys[:, band] = key
    return keys.view(np.int64)


_PIECE = "doc_id long, h long, row long, n int, first int, last int, words int, uid long, keys array<long>"


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``doc_id, h, text``: rows are told apart by their text as well, so that rows without an id, or with one id, are."""
    return docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("text"))


def paragraph_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each paragraph: its row and place, its id (a hash of its words) and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for at, some in slices(batch.column(3)):
                place, n, first, last, uid, sizes, hashes = [], [], [], [], [], [], []
                for d, t in enumerate(some, at):
                    for k, (a, b, words) in enumerate(paragraphs(t.as_py() or "", cache)):
                        place.append(d)
                        n.append(k)
                        first.append(a)
                        last.append(b)
                        uid.append(xxhash.xxh64_intdigest(" ".join(words)))
                        sizes.append(len(words))
                        hashes.extend(map(cache.__getitem__, words))
                if not place:
                    continue
                counts = np.array(sizes, dtype=np.int64)
                keys = band_keys(*shingle_hashes(np.array(hashes, dtype=np.uint64), counts))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.reshape(-1)))
                of_row = [batch.column(c).take(pa.array(place)) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [*of_row, pa.array(n, pa.int32()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(sizes, pa.int32()), pa.array(np.array(uid, dtype=np.uint64).view(np.int64)), lists],
                    ["doc_id", "h", "row", "n", "first", "last", "words", "uid", "keys"],
                )

    # Rows are numbered so that those equal in id and text stay apart. The numbers hold once the table is written.
    rows = _keyed(docs, key, text).select("doc_id", "h", F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, _PIECE)


def shingle_sets(scratch: Scratch, docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """``id, shingles, fine`` of the paragraphs at ``wanted`` (``doc_id, h, first, last, uid``): their sets and fine bucket keys."""
    places = scratch.write(wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("first", "last", "uid")).alias("at")), "places")
    rows = _keyed(docs, key, text)
    ids = places.select("doc_id", "h")
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:  # then only those texts are moved
        rows = rows.join(F.broadcast(ids), ["doc_id", "h"], "left_semi")
    rows = rows.join(places, ["doc_id", "h"]).select("text", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                uids, sets = [], []
                for t, spans in zip(batch.column(0).slice(at, 500), batch.column(1).slice(at, 500), strict=True):
                    t = t.as_py() or ""
                    for span in spans.as_py():
                        words = _WORD.findall(t[span["first"] : span["last"]].lower())
                        # Of texts with one hash only the right one has these words here.
                        if not words or xxhash.xxh64_intdigest(" ".join(words)) != span["uid"] & (2**64 - 1):
                            continue
                        h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
                        uids.append(span["uid"])
                        sets.append(np.unique(shingle_hashes(h, np.array([len(h)]))[0]))
                if uids:
                    sizes = np.array([len(x) for x in sets])
                    flat = np.concatenate(sets)
                    fine = band_keys(flat, np.cumsum(sizes) - sizes, FINE_BANDS, FINE_ROWS, BANDS * ROWS)
                    bounds = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(uids, pa.int64()), pa.ListArray.from_arrays(bounds, pa.array(flat.view(np.int64))), pa.array(list(fine), pa.list_(pa.int64()))],
                        ["id", "shingles", "fine"],
                    )

    return scratch.write(rows.mapInArrow(run, "id long, shingles array<long>, fine array<long>").dropDuplicates(["id"]), "shingles")


def classes(scratch: Scratch, docs: DataFrame, pieces: DataFrame, distinct: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``uid, class``: the classes of all paragraphs that are linked to a different one."""
    members = pieces.select(F.explode("keys").alias("key"), "uid")
    shared = members.groupBy("key").agg(F.min("uid").alias("least"), F.max("uid").alias("most")).where("least <> most").select("key")
    candidates = scratch.write(members.join(growing(shared), "key").select("uid").distinct(), "candidates")
    places = distinct.join(candidates, "uid").select("uid", "place.doc_id", "place.h", "place.first", "last")
    sets = shingle_sets(scratch, docs, places, key, text)
    fine = sets.select(F.explode("fine").alias("key"), "id")
    found = set_components(scratch, fine, ["key"], sets.select("id", "shingles"), SIMILARITY)
    return found.select(F.col("node").alias("uid"), F.col("component").alias("class"))


def repeated_passages(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, paragraph, first_char, last_char, n_words, class_id, first_doc_id, removed`` of repeated passages' paragraphs."""
    scratch = Scratch(spark, "passages")
    pieces = scratch.write(paragraph_table(docs, key, text), "paragraphs")
    place = F.struct("doc_id", "h", "row", "first")
    # Counts and first places of equal paragraphs, so that a common one is a single row in what follows.
    distinct = scratch.write(pieces.groupBy("uid").agg(F.min(place).alias("place"), F.min_by("last", place).alias("last"), F.count("*").alias("c")), "distinct")
    linked = scratch.write(classes(scratch, docs, pieces, distinct, key, text), "linked")
    # Equal paragraphs repeat without a link.
    repeated = distinct.join(linked, "uid", "left").where("c > 1 or class is not null").select("uid", "c", "place", F.coalesce("class", "uid").alias("class"))
    least = repeated.groupBy("class").agg(F.min("place").alias("least"))
    repeated = scratch.write(repeated.join(least, "class").select("uid", "c", "class", "least"), "classes")
    rows = join_counted(pieces.drop("keys"), repeated, ["uid"], max(pieces.count(), 1)).drop("c")
    # Repeated paragraphs of a row that follow each other, with one changed one between them at most, are one stretch.
    by_row = Window.partitionBy("doc_id", "h", "row").orderBy("n")
    begins = F.coalesce(F.col("n") - F.lag("n").over(by_row) > 2, F.lit(False)).cast("int")
    rows = rows.withColumn("begins", begins).withColumn("stretch", F.sum("begins").over(by_row))
    rows = rows.withColumn("span", F.sum("words").over(Window.partitionBy("doc_id", "h", "row", "stretch"))).where(F.col("span") >= MIN_SPAN)
    return rows.select(
        F.when(F.col("doc_id") != _LAST, F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("paragraph"),
        F.col("first").alias("first_char"),
        F.col("last").alias("last_char"),
        F.col("words").alias("n_words"),
        F.col("class").alias("class_id"),
        F.when(F.col("least.doc_id") != _LAST, F.col("least.doc_id")).alias("first_doc_id"),
        (place > F.col("least")).alias("removed"),
    )


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark, table(spark, sf_dir, "documents"))
