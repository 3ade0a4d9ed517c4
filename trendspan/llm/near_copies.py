"""Near copies of documents: SimHash by covering tables, with an exact check: Jaccard similarity of 5-word shingles; components.

``op7_simhash`` has fixed parameters and links by fingerprints only; this is for a stage that has to find documents
alike by ``SIMILARITY`` or more, and to link no others. Words and fingerprints are as in ``simhash``. Documents of equal
words are one member. Every member is in a bucket of each covering table, so members whose fingerprints differ in at most
``RADIUS`` bits share one. Fingerprints alone pass many copies alike by 0.8 to 0.95; for these a member is in the buckets of
``FINE_BANDS`` MinHash bands of ``FINE_ROWS`` values as well (see ``passages``): two documents share one of these
with probability 0.988 at similarity 0.8, 0.999 at 0.85 and 1 - 1e-6 at 0.9. Pairs that share a bucket are compared by their
exact similarity, and the components of the links found are the groups; see ``links`` for hot buckets.

Edge cases: null, empty and blank texts are equal to each other; texts of fewer than five words are alike only if equal;
a null id keeps its row and never names a group unless it stands alone (then null); repeated rows each give a row;
extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm.links import set_components
from trendspan.llm.passages import BANDS, FINE_BANDS, FINE_ROWS, ROWS, SIMILARITY, _WordHashes, band_keys, shingle_hashes
from trendspan.llm.pieces import slices
from trendspan.llm.shared import BROADCAST_IDS, Scratch, growing
from trendspan.llm.simhash import RADIUS, covering_masks, fingerprint


def _shingles(cache: _WordHashes, text: str | None) -> tuple[int, np.ndarray]:
    """A text's id, a hash of its words, and its set of shingles."""
    words = (text or "").encode().lower().split()
    uid = xxhash.xxh64_intdigest(b" ".join(words))
    hashes = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))
    return uid, np.unique(shingle_hashes(hashes, np.array([len(hashes)]))[0])


#: The covering tables' masks; tables are told apart by what is added to their keys.
MASKS = np.array(covering_masks(RADIUS), dtype=np.int64).view(np.uint64)
TABLES = np.arange(1, len(MASKS) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def table_keys(prints: np.ndarray) -> np.ndarray:
    """The bucket keys of signed fingerprints, a row each: one for each covering table."""
    keys = ((prints.view(np.uint64)[:, None] & MASKS) ^ TABLES) * np.uint64(0xD6E8FEB86659FD93)
    return (keys ^ (keys >> np.uint64(32))).view(np.int64)


def signatures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, uid, keys`` for each row: the id of its words and its bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for at, some in slices(batch.column(1)):
                uids, sets = zip(*(_shingles(cache, t.as_py()) for t in some), strict=True)
                sizes = np.array([len(s) for s in sets])
                bands = band_keys(np.concatenate(sets), np.cumsum(sizes) - sizes, FINE_BANDS, FINE_ROWS, BANDS * ROWS)
                tables = table_keys(np.array([fingerprint(t.as_py()) for t in some], dtype=np.int64))
                keys = np.concatenate([tables, bands.reshape(len(some), FINE_BANDS).view(np.int64)], axis=1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), pa.array(np.array(uids, dtype=np.uint64).view(np.int64)), lists], ["doc_id", "uid", "keys"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text")).mapInArrow(run, "doc_id long, uid long, keys array<long>")


def shingle_sets(scratch: Scratch, df: DataFrame, wanted: DataFrame, prints: DataFrame, key: str, text: str) -> DataFrame:
    """``uid, shingles`` of the distinct ids of words ``wanted``."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    ids = scratch.write(prints.join(wanted, "uid").groupBy("uid").agg(F.min("doc_id").alias("doc_id")).where("doc_id is not null").select("doc_id").distinct(), "ids")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS  # then only those texts are moved
    nameless = rows.where("doc_id is null")
    rows = rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").unionByName(nameless)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _WordHashes()
        for batch in batches:
            for _, some in slices(batch.column(0)):
                uids, sets = zip(*(_shingles(cache, t.as_py()) for t in some), strict=True)
                bounds = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(uids, dtype=np.uint64).view(np.int64)), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(sets).view(np.int64)))], ["uid", "shingles"])

    sets = rows.select("text").mapInArrow(run, "uid long, shingles array<long>").join(wanted, "uid", "left_semi")
    return scratch.write(sets.dropDuplicates(["uid"]), "shingles")


def near_copies(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id`` for each row of ``df``: the smallest doc_id of its group."""
    scratch = Scratch(spark, "near-copies")
    prints = scratch.write(signatures(df, key, text), "prints")
    distinct = prints.groupBy("uid").agg(F.min("doc_id").alias("least_doc"), F.first("keys").alias("keys"))
    members = distinct.select(F.explode("keys").alias("key"), F.col("uid").alias("id"))
    shared = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key")
    members = scratch.write(members.join(growing(shared), "key"), "members")
    scratch.release()
    sets = shingle_sets(scratch, df, members.select(F.col("id").alias("uid")).distinct(), prints, key, text)
    found = set_components(scratch, members, ["key"], sets.withColumnRenamed("uid", "id"), SIMILARITY)
    least = prints.groupBy("uid").agg(F.min("doc_id").alias("least_doc"))
    classes = least.join(found.withColumnRenamed("node", "uid"), "uid", "left").withColumn("class", F.coalesce("component", "uid"))
    names = classes.groupBy("class").agg(F.min("least_doc").alias("component_id"))
    named = scratch.write(classes.join(names, "class").select("uid", "component_id"), "classes")
    return prints.join(named, "uid").select("doc_id", "component_id")
