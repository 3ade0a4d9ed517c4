"""Approximate nearest neighbours with shifted space-filling curves.

Equal vectors are one member with their smallest ids, so a vector that a third of all rows share is no hot spot, and ties
among its copies are settled exactly. Members are normalised and projected onto a few random orthogonal directions, once
for each curve; the projections are shifted, spread evenly over a grid, and the grid cells are numbered along a Hilbert
curve. Spark range-partitions the members of each curve by that number, ties by id, and gives each its exact rank. Blocks
of consecutive members are a quarter of a window long. A query meets the blocks around its own in every curve; there it is
scored by vectors rounded to a byte a component, which are a quarter of the data or less. The best of all curves merge, and
their exact cosine in double precision ranks them, each pair once.

How wide the windows have to be depends on the data. Vectors without structure, as the given ones, have neighbours hardly
nearer than chance in any few projections; then only a fixed share of all members (``window_share``) in each curve holds
the recall as tables grow, and many narrow windows hold more than a few wide ones. ``WINDOW_ROWS`` is only a floor for
tables of a few thousand. Queries of a block are split into chunks, so a task's rows are bounded.

Edge cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors are compared with
those of their own dimension only; a query with fewer candidates gets all of them; equal scores go by the smaller id;
a query finds rows equal to it, but not itself; of rows with one id each takes part and the nearest counts; a null id takes
no part; extra columns do not matter; there are no texts here, and a vector of any length is one row; an empty table gives
an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendspan.llm.shared import Scratch, table

CURVES = 24
DIRECTIONS = 8
GRID_BITS = 2
#: The share of all members in a query's window on each curve, and the least members of one.
WINDOW_SHARE = 0.04
WINDOW_ROWS = 128
#: Members of a block at most, whatever the window.
BLOCK_ROWS = 8192
CHUNK = 32_768
#: Of a query's finds by rounded vectors, this many for each neighbour asked for are scored exactly.
SPARE = 4
K = 5


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places along a Hilbert curve of grid cells, one row each (Skilling, 2004)."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(unit: np.ndarray, curve: int, directions: int = DIRECTIONS, bits: int = GRID_BITS) -> np.ndarray:
    """The curve's keys of unit vectors; the directions and shifts follow from the curve's number."""
    dim = unit.shape[1]
    rng = np.random.default_rng(1000 + curve)
    m = min(directions, dim)
    axes = np.linalg.qr(rng.standard_normal((dim, m)))[0]
    # A coordinate of a random unit vector is about normal; the logistic function spreads it over (0, 1).
    spread = 1 / (1 + np.exp(-1.702 * math.sqrt(dim) * (unit @ axes)))
    shifted = (spread + rng.random(m)) / 2
    return hilbert(np.minimum((shifted * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    component = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, component) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of equally long lists as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _by_dimension(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    sizes = np.array([len(x) for x in batch.column(at)])
    for size in np.unique(sizes):
        yield batch.take(pa.array(np.flatnonzero(sizes == size)))


def distinct_vectors(scratch: Scratch, vectors: DataFrame, k: int) -> DataFrame:
    """``id, v, ids``: the different vectors, each under its smallest id and with its ``k + 1`` smallest ids."""
    rows = vectors.where(F.col("id").isNotNull() & usable(F.col("v"))).select("id", "v").distinct()
    # The limit on the rank is applied before the shuffle too, so of a vector with many rows only a few move.
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = first.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return scratch.write(members.select(F.get("ids", F.lit(0)).alias("id"), "v", "ids"), "members")


def ordered(scratch: Scratch, vectors: DataFrame, curves: int = CURVES) -> DataFrame:
    """``curve, dim, rank, total, id, asked, code``: every member's rank among those of its dimension along every curve.

    ``code`` is the vector rounded to a byte a component.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for same in _by_dimension(batch, 2):
                m = _matrix(same.column(2))
                # A scale that keeps squares of very large and very small components finite.
                m = m / np.abs(m).max(axis=1, keepdims=True)
                unit = m / np.linalg.norm(m, axis=1, keepdims=True)
                n, dim = m.shape
                rounded = np.rint(m * 127).astype(np.int8).tobytes()
                codes = pa.array([rounded[i * dim : (i + 1) * dim] for i in range(n)], pa.binary())
                for c in range(curves):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, c, dtype=np.int32)), pa.array(np.full(n, dim, dtype=np.int32)), pa.array(curve_keys(unit, c)), same.column(0), same.column(1), codes],
                        ["curve", "dim", "key", "id", "asked", "code"],
                    )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(n, part, dtype=np.int32)), pa.array(np.arange(at, at + n, dtype=np.int64))],
                [*batch.schema.names, "part", "at"],
            )
            at += n

    order = ["curve", "dim", "key", "id"]
    keyed = vectors.select("id", "asked", "v").mapInArrow(keys, "curve int, dim int, key long, id long, asked boolean, code binary")
    placed = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    sorted_ = scratch.write(placed.mapInArrow(number, "curve int, dim int, id long, asked boolean, code binary, part int, at long"), "sorted")
    # A row for each part of each curve: as many as there are tasks.
    parts = sorted_.groupBy("curve", "dim", "part").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    w = Window.partitionBy("curve", "dim").orderBy("part")
    offsets = parts.select("curve", "dim", "part", (F.sum("n").over(w) - F.col("n") - F.col("least")).alias("offset"), F.sum("n").over(Window.partitionBy("curve", "dim")).alias("total"))
    return sorted_.join(F.broadcast(offsets), ["curve", "dim", "part"]).select("curve", "dim", (F.col("offset") + F.col("at")).alias("rank"), "total", "id", "asked", "code")


def nearest(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = K, curves: int = CURVES, window_rows: int = WINDOW_ROWS, window_share: float = WINDOW_SHARE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows where ``is_query``; ``vectors`` has ``id long, v array<double>``."""
    scratch = Scratch(spark, "curves")
    members = distinct_vectors(scratch, vectors, k)
    asking = vectors.where(F.col("id").isNotNull() & usable(F.col("v")) & is_query).select(F.col("id").alias("query_id"), "v").distinct()
    asking = scratch.write(asking.join(members.select("v", F.col("id").alias("q")), "v").select("query_id", "q"), "asking")
    asked = asking.select(F.col("q").alias("id")).distinct().withColumn("asked", F.lit(True))
    ranked = ordered(scratch, members.join(asked, "id", "left").select("id", F.coalesce("asked", F.lit(False)).alias("asked"), "v"), curves)

    half = F.ceil(F.greatest(F.lit(float(window_rows)), F.col("total") * window_share) / 2).cast("long")
    size = F.least(F.lit(block_rows), F.ceil(half / 2)).cast("long")
    blocks = ranked.withColumns({"half": half, "size": size}).withColumn("block", F.floor(F.col("rank") / F.col("size")).cast("long"))
    reach = F.ceil(F.col("half") / F.col("size")).cast("long")
    last = F.floor((F.col("total") - 1) / F.col("size")).cast("long")
    # A window that would end beyond the curve's end is moved back, so that all are of one width.
    start = F.greatest(F.lit(0), F.least(F.col("block") - reach, last - 2 * reach))
    chunks = F.greatest(F.lit(1), F.ceil((2 * reach + 1) * F.col("size") / CHUNK).cast("long"))
    queries = blocks.where("asked").select("curve", "dim", F.explode(F.sequence(start, F.least(last, start + 2 * reach))).alias("block"), F.pmod(F.xxhash64("id"), chunks).alias("chunk"), "id", "code", "asked")
    # A block of rows goes to each chunk of the queries that look at it.
    rows = blocks.select("curve", "dim", "block", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "id", "code", F.lit(False).alias("asked"))
    kept = (k + 1) * SPARE

    def best(group: pa.Table) -> pa.Table:
        asked = group.column("asked").to_numpy()
        ids = group.column("id").to_numpy()
        codes = group.column("code").combine_chunks()
        m = np.frombuffer(b"".join(codes.to_pylist()), dtype=np.int8).reshape(len(ids), -1).astype(np.float32)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        order = np.argsort(ids[~asked], kind="stable")
        q, qid, d, did = m[asked], ids[asked], m[~asked][order], ids[~asked][order]
        out_q, out_d, out_s = [], [], []
        for at in range(0, len(q) if len(d) else 0, 256):
            s = q[at : at + 256] @ d.T
            n = min(kept, s.shape[1])
            c = np.argpartition(-s, n - 1, axis=1)[:, :n]
            out_q.append(np.repeat(qid[at : at + 256], n))
            out_d.append(did[c].reshape(-1))
            out_s.append(np.take_along_axis(s, c, axis=1).reshape(-1))
        none = np.empty(0, dtype=np.int64)
        return pa.table({"q": np.concatenate(out_q or [none]), "d": np.concatenate(out_d or [none]), "near": np.concatenate(out_s or [none]).astype(np.float32)})

    met = rows.unionByName(queries).groupBy("curve", "dim", "block", "chunk").applyInArrow(best, "q long, d long, near float")
    # A pair that met in several curves has one score but for rounding, and is one pair from here on.
    once = met.groupBy("q", "d").agg(F.max("near").alias("near"))
    w = Window.partitionBy("q").orderBy(F.desc("near"), "d")
    few = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= kept).select("q", "d")
    # A query's own vector stands for its copies.
    pairs = few.unionByName(asked.select(F.col("id").alias("q"), F.col("id").alias("d"))).distinct()
    return rerank(pairs, members, asking, k)


def rerank(pairs: DataFrame, members: DataFrame, asking: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each query among its candidates by the cosine in double precision."""
    a = members.select(F.col("id").alias("q"), F.col("v").alias("a"))
    b = members.select(F.col("id").alias("d"), F.col("v").alias("b"), "ids")
    scored = pairs.join(a, "q").join(b, "d").where("size(a) = size(b)").select("q", "ids", cosine(F.col("a"), F.col("b")).alias("score"))
    rows = asking.join(scored, "q").select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    best = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def cosine(a: Column, b: Column) -> Column:
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    return dot / (norm(a) * norm(b))


def op9_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return nearest(spark, vectors, F.col("id") % 50 == 0)
