"""SimHash fingerprints and near-duplicate documents by covering locality-sensitive hashing.

Each of the 64 bits gets a nonzero vector of r + 1 bits. For every nonzero vector v there is a table whose mask
keeps the bits with an odd inner product with v. The vectors of r differing bits span a space of at most r
dimensions, so some v is orthogonal to all of them: two fingerprints within distance r agree on the whole key
of at least one of the 2^(r+1) - 1 tables (Pagh, 2016). No pair within the radius is ever missed.

Edge cases: a null, empty or blank text has the fingerprint zero, linked like any other; equal fingerprints are
linked; a null id keeps its row and never names a component unless it stands alone (then null); repeated rows
each give a row; extra columns do not matter; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm.links import bucket_components
from trendspan.llm.shared import Scratch, growing, table

WIDTH = 4
RADIUS = 4
SEED = 42


def fingerprint(text: str | None, width: int = WIDTH) -> int:
    """The majority of each bit over the shingles' hashes, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    if len(words) > width:
        starts, ends = starts[: 1 - width], ends[width - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    hashes = np.fromiter((digest(view[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), dtype=np.uint64, count=len(starts))
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.ascontiguousarray(hashes[at : at + (1 << 16)].astype(">u8"))
        votes += np.unpackbits(some.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes)).view(">i8")[0])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``doc_id, fp`` for each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of all tables, as signed longs."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(bits)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def simhash_components(scratch: Scratch, prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Add ``component_id``, the smallest doc_id reachable over links of at most ``radius`` differing bits."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least_doc"))
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.lit(m).alias("mask")) for i, m in enumerate(covering_masks(radius))))
    members = distinct.select(F.col("fp").alias("id"), F.explode(tables).alias("m")).select("m.t", F.col("id").bitwiseAND(F.col("m.mask")).alias("key"), "id")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    found = bucket_components(scratch, members, ["t", "key"], lambda pairs: pairs.where(near), similar=near)
    classes = distinct.join(growing(found.withColumnRenamed("node", "fp")), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    names = classes.groupBy("class").agg(F.min("least_doc").alias("component_id"))
    named = scratch.write(classes.join(growing(names), "class").select("fp", "component_id"), "classes")
    return prints.join(growing(named), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(spark: SparkSession, df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``df``."""
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(df, key, text, width), "prints")
    return simhash_components(scratch, prints, radius)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
