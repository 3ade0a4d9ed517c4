"""Packing of documents into sequences of a fixed number of tokens by the sum-of-squares rule.

A document is its token ids and an end id. One that is longer than a sequence is cut into full pieces, of which the first
may be shorter. Full pieces are sequences by themselves. The others are packed: of the open bins that have room, and a new
one, a piece goes where the squared numbers of open bins of each gap then add up to least, so that gaps of many kinds stay
open. The rule needs only the number of bins of each gap, of which there are as many as a sequence has tokens.

Spark encodes the documents in one pass into a table of pieces, numbers its rows and deals them by hash into groups of a bounded
size, each packed by a task; so no key and no length can make a group large. In a group the larger pieces are packed as they
come; the smaller ones follow from the largest to the smallest, and open a bin only if none has room. Several bounds between
large and small are tried, up to the first that needs no more bins than the tokens do. Bins that are not full hold a rest, which
matters in none of a few groups but in many: the emptiest bins of each group, with an eighth of its pieces at most, are dissolved
and their pieces are packed again, in groups of other groups' rests, until one group takes all.

Edge cases: a null or empty text is one end id; null and repeated ids are kept, each row for itself; equal rows are separate
pieces; of equally good places the one that leaves the smallest gap is taken; extra columns are passed over; an empty table gives an
empty result. A sequence is named by the number of the row of its first piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm.pieces import slices
from trendspan.llm.shared import Scratch, table
from trendspan.llm.token_stream import library

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END_ID = 1024, 2
#: Pieces of a group.
GROUP = 32_768
#: A piece is large that has more than so many eighths of a sequence.
LARGE = (2, 3, 4)
#: Of a group's pieces one in so many is packed again at most.
AGAIN = 8

_NO_PLACE = np.iinfo(np.int64).max

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """The pieces of all documents: place in the document, size, checksum, and the ids as little-endian unsigned 16-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = library(tokenizer_path).table
        for batch in batches:
            for at, some in slices(batch.column(1)):
                ids, counts = coder.texts(some)
                counts = counts + 1
                ends = np.cumsum(counts)
                stream = np.full(int(ends[-1]), end_id, dtype="<u2")
                keep = np.ones(len(stream), dtype=bool)
                keep[ends - 1] = False
                stream[keep] = ids
                pieces = -(-counts // length)
                doc = np.repeat(np.arange(len(counts)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = counts - (pieces - 1) * length
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * length)
                size = np.where(piece == 0, head[doc], length)
                begin = (ends - counts)[doc] + start
                wide, narrow = memoryview(stream.astype("<u4").tobytes()), memoryview(stream.tobytes())
                bounds = list(zip(begin.tolist(), (begin + size).tolist(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(some)).take(pa.array(doc)),
                        pa.array(piece.astype(np.int32)),
                        pa.array(start),
                        pa.array(size),
                        pa.array([zlib.crc32(wide[4 * a : 4 * b]) for a, b in bounds], pa.int64()),
                        pa.array([bytes(narrow[2 * a : 2 * b]) for a, b in bounds], pa.binary()) if keep_ids else pa.nulls(len(doc), pa.binary()),
                    ],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "ids"],
                )

    pieces = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)
    return pieces if keep_ids else pieces.drop("ids")


class Bins:
    """Open bins by the gap that is left in them."""

    def __init__(self, length: int):
        self.length, self.count = length, 0
        self.open = np.zeros(length + 1, dtype=np.int64)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def place(self, size: int, reluctant: bool) -> tuple[int, int]:
        """Bin and offset of a piece; a reluctant one opens a bin only if none has room."""
        # By how much the sum of squares changes, for each gap that is left afterwards.
        room = self.open[size:]
        change = 2 * (self.open[: self.length - size + 1] - room) + 2
        change[0] = 1 - 2 * room[0]
        change[room == 0] = _NO_PLACE
        if not reluctant or not room.any():
            change[-1] = 2 * self.open[self.length - size] + 1 if size < self.length else 0
        left = int(change.argmin())
        gap = left + size
        if gap == self.length:
            found, self.count = self.count, self.count + 1
        else:
            found = self.bins[gap].pop()
            self.open[gap] -= 1
        if left:
            self.bins[left].append(found)
            self.open[left] += 1
        return found, self.length - gap


def pack(sizes: np.ndarray, length: int = LENGTH, large: tuple[int, ...] = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece."""
    least = -(-int(sizes.sum()) // length)
    best = None
    for eighths in large:
        bound = eighths * length // 8
        first = np.flatnonzero(sizes > bound)
        rest = np.flatnonzero(sizes <= bound)
        rest = rest[np.argsort(-sizes[rest], kind="stable")]
        bins = Bins(length)
        where, offset = np.empty(len(sizes), dtype=np.int64), np.empty(len(sizes), dtype=np.int64)
        for some, reluctant in ((first, False), (rest, True)):
            for i, size in zip(some.tolist(), sizes[some].tolist(), strict=True):
                where[i], offset[i] = bins.place(size, reluctant)
        if best is None or bins.count < best[0]:
            best = bins.count, where, offset
        if best[0] == least:
            break
    return best[1], best[2]


def emptiest(where: np.ndarray, sizes: np.ndarray, length: int, again: int = AGAIN) -> np.ndarray:
    """Which pieces are in the emptiest bins, of those that are not full; one piece in ``again`` at most."""
    filled, held = np.bincount(where, sizes).astype(np.int64), np.bincount(where)
    order = np.argsort(filled, kind="stable")
    some = (np.cumsum(held[order]) <= len(sizes) // again) & (filled[order] < length)
    gone = np.zeros(len(filled), dtype=bool)
    gone[order[some]] = True
    return gone[where]


def _packer(length: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs a group's pieces; unless it is the last group, those of its emptiest bins are marked."""

    def run(t: pa.Table) -> pa.Table:
        t = t.drop_columns("__group").sort_by("__no")
        no, sizes = t["__no"].to_numpy(), t["length"].to_numpy()
        where, offset = pack(sizes, length)
        first = np.empty(int(where.max()) + 1, dtype=np.int64)
        first[where[offset == 0]] = no[offset == 0]
        again = np.zeros(len(no), dtype=bool) if last else emptiest(where, sizes, length)
        return t.append_column("sequence_id", pa.array(first[where])).append_column("offset", pa.array(offset)).append_column("__again", pa.array(again))

    return run


def pack_pieces(spark: SparkSession, pieces: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``pieces``, which have a ``length``, with the sequence that each is in and its offset there."""
    scratch = Scratch(spark, "packing")
    rows = scratch.write(pieces.withColumn("__no", F.monotonically_increasing_id()), "pieces")
    named = rows.where(F.col("length") >= length).withColumns({"sequence_id": F.col("__no"), "offset": F.lit(0).cast("long")})
    done = [named]
    left = rows.where(F.col("length") < length)
    for turn in range(64):
        n = left.count()
        if not n:
            break
        groups = -(-n // group)
        last = groups == 1
        schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, sequence_id long, offset long, __again boolean"

        dealt = left.withColumn("__group", F.pmod(F.xxhash64("__no", F.lit(turn)), F.lit(groups)))
        packed = scratch.write(dealt.groupBy("__group").applyInArrow(_packer(length, last), schema), f"packed-{turn}")
        done.append(packed.where(~F.col("__again")).drop("__again"))
        left = packed.where("__again").drop("__again", "sequence_id", "offset")
        if last:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("__no")


def pack_documents(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    return pack_pieces(df.sparkSession, token_pieces(df, tokenizer_path, key, text, length, end_id, keep_ids), length)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the ids of each sequence in one binary value, of which a task holds one sequence at a time."""
    joined = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    ids = F.aggregate(joined, F.lit(b"").cast("binary"), lambda all_ids, p: F.concat(all_ids, p.ids))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), ids.alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places; ids stay in the encoder's tasks, which give their checksums."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), keep_ids=False)
