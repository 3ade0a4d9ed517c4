"""Token ids as compressed files: a context-mixing range coder in independently reset, checksummed blocks.

A stream of ids, each document's followed by the end id, is cut into blocks of ``BLOCK`` ids. Every block starts
from the same state, so any block can be decoded alone with the file's header. For each id an order-2 and an order-1
context, hashed into tables of the block, predict the id seen there last; an order-0 table of the file, in its header,
gives every id a part. The three are mixed into one distribution: the two predicted ids get shares, which adapt to how
often they were right at their confidences, and the order-0 table gets the rest. So each id is coded in one step, by the
sum of its parts in all three. The range coder has 64 bits and writes 32-bit words. All arithmetic is on integers, or on
quotients of doubles that are corrected by integers, so every machine decodes what another wrote. The blocks of a file
run side by side, as the lanes of arrays.

A file is one binary value, and files are rows of Parquet that Spark writes and reads, so that any store will do:

    magic "TSC2", then little-endian 32-bit: documents, ids of a block, blocks, bytes of the order-0 table; 64-bit: all ids
    per document: 64-bit id (smallest value: null), 64-bit number of ids with the end id
    per block: 32-bit number of coded words, 32-bit CRC-32 of its ids as 32-bit little-endian integers
    the order-0 table: 32-bit parts of the ids 0 to 65535 of 2^19, deflated
    the coded 32-bit words of all blocks; 32-bit CRC-32 of everything before

Edge cases: a null text is empty and has the end id alone; a null doc_id sorts first; equal doc_ids keep one
place each, in the order of their texts; texts are encoded whole, whatever their length, and a file ends after the
document that fills it; extra columns do not matter; an empty table has no files. A document with the smallest possible
id reads back as one with a null id.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trendspan.llm.pieces import PieceTable, gathered, slices
from trendspan.llm.shared import Scratch, table

MAGIC = b"TSC2"
BLOCK = 2048
#: Ids after which a file is closed at the end of a document.
FILE_IDS = 4_000_000
END_ID = 0
NULL_ID = -(1 << 63)

#: Slots of a context table, bits of the shares and of the order-0 parts.
_TABLE_BITS, _SHARE_BITS, _PART_BITS = 10, 11, 19
_SLOT = (1 << _TABLE_BITS) - 1
_TOTAL_BITS = _SHARE_BITS + _PART_BITS
#: What a share of 16 bits moves to where its prediction was right; the rest is always left to order 0.
_MOST = np.int32(64_000)
#: Shares of the order-1 and order-2 predictions to start with, by both confidences.
_FIRST1 = np.tile([1000, 9000, 16000, 24000], 4)
_FIRST2 = np.repeat([1000, 16000, 28000, 38000], 4)

U = np.uint64
_WORD = U(32)

#: Pieces that a worker's table holds, 60 bytes each; the library's ids cost most where a piece isn't there.
ENTRIES = 1_500_000
#: Pieces that are encoded as one text; the library is slower on longer texts.
JOINED = 256
#: First bytes of visible characters; some characters outside ASCII that begin with those left out are white space.
_VISIBLE = np.array([b > 32 and b not in b"\xc2\xe1\xe2\xe3" for b in range(256)])


class LibraryPieces:
    """The tokenizers library's ids of pieces of text."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The same words and merges without the search for special tokens, for pieces that can't hold one.
        self.words = self.tokenizer
        if self.tokenizer.normalizer is None and self.tokenizer.post_processor is None:
            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = self.tokenizer.pre_tokenizer
        specials = self.tokenizer.get_added_tokens_decoder()
        size = self.tokenizer.get_vocab_size()
        # A token's bytes: as many as the characters that byte-level vocabularies write for them.
        self.width = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], dtype=np.int64)
        self.table = PieceTable(self.encode_pieces, [t.content.encode() for t in specials.values()], self.encode_run, True, ENTRIES)

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_run(np.frombuffer(b"".join(pieces), dtype=np.uint8), np.array([len(p) for p in pieces], dtype=np.int64))

    def encode_run(self, run: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a blank before a visible character are encoded as one text, which is faster.

        No word crosses their bounds, so the ids fall to the pieces by their numbers of bytes. A character outside ASCII
        that might be white space does not count as visible.
        """
        ends = np.cumsum(lengths)
        starts = ends - lengths
        plain = lengths > 1
        at = starts[plain]
        plain[plain] = (run[at] == 32) & _VISIBLE[run[at + 1]] & (run[ends[plain] - 1] > 32)
        marked = np.flatnonzero((run[:-1] == 60) & (run[1:] == 124))
        plain[np.searchsorted(ends, marked, side="right")] = False
        joined, apart = np.flatnonzero(plain), np.flatnonzero(~plain)
        upto = np.cumsum(lengths[joined])
        raw = gathered(run, starts[joined], lengths[joined]).tobytes()
        edges = [0, *upto[JOINED - 1 :: JOINED].tolist(), len(raw)]
        found = self.words.encode_batch_fast([raw[a:b].decode() for a, b in zip(edges, edges[1:], strict=False) if a < b], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, dtype=np.uint16), *(np.array(e.ids, dtype=np.uint16) for e in found)])
        cuts = np.searchsorted(np.cumsum(self.width[ids]), upto) + 1
        raw = run.tobytes()
        others = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(starts[apart].tolist(), ends[apart].tolist(), strict=True)], add_special_tokens=False)]
        counts = np.zeros(len(lengths), dtype=np.int64)
        counts[joined] = np.diff(cuts, prepend=0)
        counts[apart] = [len(o) for o in others]
        # All ids stand in the order joined, apart; each piece's are gathered from there.
        flat = np.concatenate([ids, np.array([i for o in others for i in o], dtype=np.uint16)])
        begin = np.zeros(len(lengths), dtype=np.int64)
        begin[joined] = cuts - counts[joined]
        begin[apart] = len(ids) + np.cumsum(counts[apart]) - counts[apart]
        return gathered(flat, begin, counts), counts


_LIBRARY: dict[str, LibraryPieces] = {}


def library(path: str) -> LibraryPieces:
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryPieces(path)
    return _LIBRARY[path]


class _Order0:
    """The parts of all ids, where each part starts, and whose part each number lies in."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.ids = np.repeat(np.arange(len(sizes), dtype=np.int64), self.sizes)

    @staticmethod
    def of(ids: np.ndarray) -> _Order0:
        """Parts in proportion to the ids' counts; every id that occurs has one."""
        counts = np.bincount(ids, minlength=1 << 16)
        have = counts > 0
        sizes = have + counts * ((1 << _PART_BITS) - int(have.sum())) // max(len(ids), 1)
        sizes[int(counts.argmax())] += (1 << _PART_BITS) - int(sizes.sum())
        return _Order0(sizes)


class _Lanes:
    """The models of all blocks, one lane a block; coder and decoder move them alike. Rows: order 1, order 2."""

    def __init__(self, lanes: int, order0: _Order0):
        self.order0 = order0
        rows = np.arange(2 * lanes, dtype=np.int64).reshape(2, lanes)
        self.base, self.state = rows << _TABLE_BITS, rows << 4
        #: The id that followed a context last, and above how often in a row it did, up to three.
        self.entries = np.zeros((2 * lanes) << _TABLE_BITS, dtype=np.int32)
        self.shares = np.concatenate([np.tile(_FIRST1, lanes), np.tile(_FIRST2, lanes)]).astype(np.int32)
        self.last, self.hash = np.zeros(lanes, dtype=np.int64), np.zeros(lanes, dtype=np.int64)
        self.at = np.empty((2, lanes), dtype=np.int64)

    def predict(self) -> None:
        mixed = self.last * 40503
        self.at[0] = mixed
        self.at[1] = mixed + self.hash
        self.at >>= 5
        self.at &= _SLOT
        self.at += self.base
        self.hash = self.last * 30341
        entry = self.entries.take(self.at)
        self.confidence, self.guess = entry & 3, entry >> 2
        self.slot = self.state + (self.confidence[1] * 4 + self.confidence[0])
        self.share = self.shares.take(self.slot)
        mass = (self.share >> (16 - _SHARE_BITS)).astype(np.int64)
        self.rest = (1 << _SHARE_BITS) - mass[0] - mass[1]
        self.mass = np.left_shift(mass, _PART_BITS, out=mass)

    def span(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids' parts of the mixture start, and their sizes: a guess's mass lies before its order-0 part."""
        narrow = ids.astype(np.int32)
        self.right = self.guess == narrow
        before, own = self.mass * (self.guess < narrow), self.mass * self.right
        start, size = self.rest * self.order0.starts.take(ids), self.rest * self.order0.sizes.take(ids)
        start += before[0]
        start += before[1]
        size += own[0]
        size += own[1]
        return start, size

    def ids(self, v: np.ndarray) -> np.ndarray:
        """The ids in whose parts the numbers lie."""
        # Where the guesses' masses lie: order 1's first where both are the same.
        begin = self.rest * self.order0.starts.take(self.guess)
        before = self.guess[1] < self.guess[0]
        begin[0] += self.mass[1] * before
        begin[1] += self.mass[0] * ~before
        into = v - begin
        past = into >= 0
        inside = into < self.mass
        inside &= past
        gone = self.mass * past
        # Both are below 2^30, so the whole part of the quotient of doubles is right. Where a guess is right it isn't used.
        part = ((v - gone[0] - gone[1]) / self.rest).astype(np.int64)
        out = self.order0.ids.take(part, mode="clip")
        np.copyto(out, self.guess[0], where=inside[0])
        np.copyto(out, self.guess[1], where=inside[1])
        return out

    def update(self, ids: np.ndarray) -> None:
        # Order 1 has to be right where order 2 isn't, so that both shares together stay below one.
        goal = self.right * _MOST
        goal[0] *= ~self.right[1]
        goal -= self.share
        goal >>= 5
        goal += self.share
        self.shares[self.slot] = goal
        # One more where the prediction held, up to three; else none.
        entry = np.minimum(self.confidence + 1, 3)
        entry *= self.right
        entry += (ids << 2).astype(np.int32)
        self.entries[self.at] = entry
        self.last = ids


class _Encoder:
    """Notes of every step what a lane would write, whether it does, and whether a carry goes to what it wrote before."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, dtype=U), np.full(lanes, (1 << 64) - 1, dtype=U)
        self.tops, self.full, self.carry = np.empty((steps, lanes), dtype=np.uint32), np.empty((steps, lanes), dtype=bool), np.empty((steps, lanes), dtype=bool)

    def put(self, t: int, start: np.ndarray, size: np.ndarray) -> None:
        unit = self.range >> U(_TOTAL_BITS)
        step = start.view(U) * unit
        self.low += step
        unit *= size.view(U)
        np.less(self.low, step, out=self.carry[t])
        full = np.less(unit, U(1 << 32), out=self.full[t])
        np.right_shift(self.low, _WORD, out=self.tops[t], casting="unsafe")
        # At least 2^2 parts of each step are left, so one word at a time is enough.
        by = full.astype(U)
        by <<= U(5)
        self.low <<= by
        unit <<= by
        self.range = unit

    def finish(self) -> list[bytes]:
        full = self.full.T
        n = full.sum(axis=1)
        size = n + 2
        begin = np.cumsum(size) - size
        words = np.zeros(int(size.sum()), dtype=U)
        lane = np.nonzero(full)[0]
        words[np.arange(len(lane)) + 2 * lane] = self.tops.T[full]
        words[begin + n], words[begin + n + 1] = self.low >> _WORD, self.low & U(0xFFFFFFFF)
        lane, t = np.nonzero(self.carry.T)
        written = np.cumsum(full, axis=1, dtype=np.int32)[lane, t] - full[lane, t]
        np.add.at(words, begin[lane] + written - 1, U(1))
        while len(over := np.flatnonzero(words >> _WORD)):  # a carry goes up through words that are full
            words[over] &= U(0xFFFFFFFF)
            np.add.at(words, over - 1, U(1))
        coded = words.astype("<u4")
        return [coded[b : b + k].tobytes() for b, k in zip(begin.tolist(), size.tolist(), strict=True)]


class _Decoder:
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.at = words.astype(U), starts + 2
        self.code = (self.words[starts] << _WORD) | self.words[starts + 1]
        self.range = np.full(len(starts), (1 << 64) - 1, dtype=U)

    def value(self) -> np.ndarray:
        self.unit = self.range >> U(_TOTAL_BITS)
        # The quotient of doubles may be out by one where it is nearly whole.
        v = (self.code / self.unit).astype(U)
        v -= v * self.unit > self.code
        v += (v + U(1)) * self.unit <= self.code
        return np.minimum(v, U((1 << _TOTAL_BITS) - 1)).view(np.int64)

    def take(self, start: np.ndarray, size: np.ndarray) -> None:
        self.code -= start.view(U) * self.unit
        self.unit *= size.view(U)
        self.range = self.unit
        out = np.flatnonzero(self.range < U(1 << 32))
        at = self.at[out]
        self.code[out] = (self.code[out] << _WORD) | self.words[at]
        self.at[out] = at + 1
        self.range[out] <<= _WORD


def encode_blocks(ids: np.ndarray, order0: _Order0, block: int = BLOCK) -> list[bytes]:
    """The coded words of each block of ``block`` ids; the last block is filled up with an id of its own."""
    lanes = -(-len(ids) // block)
    filled = np.full(lanes * block, ids[-1] if len(ids) else 0, dtype=np.int64)
    filled[: len(ids)] = ids
    steps = np.ascontiguousarray(filled.reshape(lanes, block).T)
    model, coder = _Lanes(lanes, order0), _Encoder(lanes, block)
    for t in range(block):
        model.predict()
        coder.put(t, *model.span(steps[t]))
        model.update(steps[t])
    return coder.finish()


def decode_blocks(words: np.ndarray, starts: np.ndarray, order0: _Order0, block: int) -> np.ndarray:
    """The ids of all blocks, fill included, from their words and where each block's begin."""
    model, coder = _Lanes(len(starts), order0), _Decoder(words, starts)
    steps = np.empty((block, len(starts)), dtype=np.int64)
    for t in range(block):
        model.predict()
        steps[t] = model.ids(coder.value())
        coder.take(*model.span(steps[t]))
        model.update(steps[t])
    return np.ascontiguousarray(steps.T).reshape(-1)


def pack(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A file of the documents' ids."""
    order0 = _Order0.of(ids)
    coded = encode_blocks(ids, order0, block)
    parts = zlib.compress(order0.sizes.astype("<u4").tobytes())
    check = [zlib.crc32(ids[at : at + block].astype("<u4").tobytes()) for at in range(0, len(ids), block)]
    body = b"".join(
        [
            MAGIC,
            struct.pack("<IIIIQ", len(doc_ids), block, len(coded), len(parts), len(ids)),
            doc_ids.astype("<i8").tobytes(),
            counts.astype("<i8").tobytes(),
            np.array([[len(c) // 4 for c in coded], check], dtype="<u4").tobytes(),
            parts,
            *coded,
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, counts and ids of a file; raises ValueError where a checksum doesn't hold."""
    if data[:4] != MAGIC or struct.unpack("<I", data[-4:])[0] != zlib.crc32(data[:-4]):
        raise ValueError("not a whole file of token ids")
    docs, block, blocks, held, total = struct.unpack("<IIIIQ", data[4:28])
    at = 28
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    counts = np.frombuffer(data, "<i8", docs, at + 8 * docs)
    at += 16 * docs
    sizes, check = np.frombuffer(data, "<u4", 2 * blocks, at).reshape(2, -1).astype(np.int64)
    at += 8 * blocks
    order0 = _Order0(np.frombuffer(zlib.decompress(data[at : at + held]), "<u4"))
    words = np.frombuffer(data, "<u4", int(sizes.sum()), at + held)
    # A decoder looks at most a word beyond its block.
    ids = decode_blocks(np.concatenate([words, np.zeros(2, dtype=words.dtype)]), np.cumsum(sizes) - sizes, order0, block)[:total].astype("<u4")
    for i in range(blocks):
        if zlib.crc32(ids[i * block : (i + 1) * block].tobytes()) != check[i]:
            raise ValueError(f"block {i} is damaged")
    return doc_ids, counts, ids


FILES = "part int, seq int, n_docs long, n_ids long, file binary"


def write_token_files(df: DataFrame, tokenizer_path: str, path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID, file_ids: int = FILE_IDS) -> None:
    """Encode whole texts with the tokenizers library and write their ids, in ascending order of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        coder = library(tokenizer_path).table
        docs, sizes, parts, held = [], [], [], 0
        for batch in batches:
            for at, some in slices(batch.column(1)):
                ids, counts = coder.texts(some)
                docs.append(batch.column(0).slice(at, len(some)).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
                sizes.append(counts + 1)
                ends = np.cumsum(counts + 1)
                stream = np.full(int(ends[-1]), end_id, dtype=np.uint16)
                keep = np.ones(len(stream), dtype=bool)
                keep[ends - 1] = False
                stream[keep] = ids
                parts.append(stream)
                held += len(stream)
                if held >= file_ids:
                    yield file(part, seq, docs, sizes, parts)
                    docs, sizes, parts, held, seq = [], [], [], 0, seq + 1
        if docs:
            yield file(part, seq, docs, sizes, parts)

    def file(part, seq, docs, sizes, parts):
        data = pack(np.concatenate(docs), np.concatenate(sizes), np.concatenate(parts))
        n = [sum(map(len, docs)), sum(map(len, parts))]
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array(n[:1]), pa.array(n[1:]), pa.array([data], pa.binary())],
            ["part", "seq", "n_docs", "n_ids", "file"],
        )

    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(run, FILES).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start`` counts the ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                doc_ids, counts, ids = unpack(batch.column(2)[i].as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, batch.column(0)[i].as_py(), dtype=np.int32)),
                        pa.array(np.full(n, batch.column(1)[i].as_py(), dtype=np.int32)),
                        pa.array(doc_ids, mask=doc_ids == NULL_ID),
                        pa.array(ends - counts),
                        pa.array(counts),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    files = spark.read.schema(FILES).parquet(path)
    docs = files.select("part", "seq", "file").mapInArrow(run, "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Where each file starts: within its part, and after the parts before, of which there is one a task.
    sizes = files.groupBy("part", "seq").agg(F.sum("n_ids").alias("n"))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.select("part", "seq", (F.sum("n").over(Window.partitionBy("part").orderBy("seq")) - F.col("n")).alias("earlier"))
    starts = inside.join(parts, "part")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("before") + F.col("earlier") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path("files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return read_token_files(spark, path)
