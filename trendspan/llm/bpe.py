"""Byte-level BPE over a contiguous rank array, and its decoding.

A word is held as an array of parts next to an array of the ranks of its adjacent pairs. The smallest rank is
found by a scan, the boundary between its two parts is deleted, and only the ranks beside it are looked up
again. Words of one length are handled side by side as the rows of one matrix. Words over ``SHORT`` bytes, for
which scans would be quadratic, take the same merges from a heap.

Edge cases: a null text counts as the empty text, which has no ids; an extra column keeps its values; rows are
independent, so ties and repeated rows need no rule; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspan.llm.pieces import PieceTable, Strings, slices
from trendspan.llm.shared import table

PATTERN = public_tokenizers.PATTERN
SHORT = 64
NONE = np.int32(2**31 - 1)
#: Signs that are a word of their own between a letter and a space.
ENDS = ".,;:!?|"

def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars, extra = {b: chr(b) for b in kept}, 256
    for b in range(256):
        if b not in chars:
            chars[b] = chr(extra)
            extra += 1
    return [chars[b] for b in range(256)]


class Codec:
    """The ids of a byte-level BPE vocabulary file, by this module's own merging."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, chars = spec["model"]["vocab"], byte_chars()
        byte_of = {c: b for b, c in enumerate(chars)}
        self.base = np.array([vocab[c] for c in chars], dtype=np.uint32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("a pair of ids has to fit into 32 bits")
        left = np.array([vocab[a] for a, _ in merges], dtype=np.uint32)
        right = np.array([vocab[b] for _, b in merges], dtype=np.uint32)
        keys = (left << np.uint32(16)) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank_of = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.uint32)
        self.pair_rank = dict(zip(keys.tolist(), range(len(merges)), strict=True))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*vocab.values(), *self.special.values()]) + 1
        token_bytes = [b""] * size
        for token, i in vocab.items():
            token_bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            token_bytes[i] = token.encode()
        self.bytes_of, self.decimal = Strings(token_bytes), Strings([b"%d," % i for i in range(size)])
        longest_first = sorted(self.special, key=len, reverse=True)
        self.split_special = re.compile("|".join(map(re.escape, longest_first))) if self.special else None
        self.words = regex.compile(PATTERN).findall
        self.table = PieceTable(self.encode_pieces, [s.encode() for s in self.special])

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each adjacent pair; NONE where the vocabulary has no such merge."""
        key = (left << np.uint32(16)) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NONE)

    def merge_same_length(self, words: list[bytes]) -> list[tuple[int, ...]]:
        width = len(words[0])
        parts = self.base[np.frombuffer(b"".join(words), dtype=np.uint8).reshape(-1, width)]
        out: list[tuple[int, ...]] = [()] * len(words)
        where = np.arange(len(words))
        rank = self.ranks(parts[:, :-1], parts[:, 1:])
        while len(where):
            if parts.shape[1] == 1:
                for i, row in zip(where.tolist(), parts.tolist(), strict=True):
                    out[i] = tuple(row)
                break
            at = rank.argmin(axis=1)
            rows = np.arange(len(at))
            best = rank[rows, at]
            done = best == NONE
            if done.any():
                for i, row in zip(where[done].tolist(), parts[done].tolist(), strict=True):
                    out[i] = tuple(row)
                live = ~done
                parts, rank, at, best, where = parts[live], rank[live], at[live], best[live], where[live]
                rows = np.arange(len(at))
                if not len(at):
                    break
            # Every row that goes on loses one part, so all rows keep one width.
            count = parts.shape[1]
            keep = np.ones(parts.shape, dtype=bool)
            keep[rows, at + 1] = False
            parts[rows, at] = self.merged[best]
            parts = parts[keep].reshape(len(rows), count - 1)
            keep = keep[:, 1:]
            rank = rank[keep].reshape(len(rows), count - 2)
            before = at > 0
            r, a = rows[before], at[before]
            rank[r, a - 1] = self.ranks(parts[r, a - 1], parts[r, a])
            after = at < count - 2
            r, a = rows[after], at[after]
            rank[r, a] = self.ranks(parts[r, a], parts[r, a + 1])
        return out

    def merge_long(self, word: bytes) -> tuple[int, ...]:
        parts = self.base[np.frombuffer(word, dtype=np.uint8)].tolist()
        n = len(parts)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        get = self.pair_rank.get
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << 16 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else -1
            if j < 0 or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.merged[r]), -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := get(parts[i] << 16 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := get(parts[h] << 16 | parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return tuple(p for p in parts if p >= 0)

    def merge_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        by_length: dict[int, list[tuple[str, bytes]]] = {}
        out: dict[str, tuple[int, ...]] = {}
        for w in words:
            b = w.encode()
            if len(b) > SHORT:
                out[w] = self.merge_long(b)
            else:
                by_length.setdefault(len(b), []).append((w, b))
        for same in by_length.values():
            out.update(zip((w for w, _ in same), self.merge_same_length([b for _, b in same]), strict=True))
        return out

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces, each a stretch of text, in one array; and the number of ids of each piece."""
        texts = [p.decode() for p in pieces]
        words: set[str] = set()
        split: list[list[str]] = []
        for t in texts:
            body = t[1:] if t[:1] == " " else t
            if body.isalpha():  # one run of letters
                split.append([t])
            elif body[-1:] in ENDS and body[:-1].isalpha():  # and one sign after it
                split.append([t[:-1], t[-1]])
            elif self.split_special is not None and self.split_special.search(t):
                split.append(self.words_and_specials(t))
            else:
                split.append(self.words(t))
            words.update(split[-1])
        ids = self.merge_words(words.difference(self.special)) | {s: (i,) for s, i in self.special.items()}
        found = [ids[w[0]] if len(w) == 1 else tuple(chain.from_iterable(map(ids.__getitem__, w))) for w in split]
        counts = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return np.fromiter(chain.from_iterable(found), dtype=np.uint16, count=int(counts.sum())), counts

    def words_and_specials(self, text: str) -> list[str]:
        out, at = [], 0
        for m in self.split_special.finditer(text):
            out += [*self.words(text[at : m.start()]), m[0]]
            at = m.end()
        return out + self.words(text[at:])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts (null: empty) in one array, and the number of ids of each text."""
        return self.table.texts(column)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        run, ends = self.bytes_of.joined(ids)
        last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        raw = run.tobytes()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(last, last[1:], strict=False)]

    def digests(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """SHA-256 of the decimal ids of each text, joined by commas."""
        run, ends = self.decimal.joined(ids)
        last = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        raw = memoryview(run.tobytes())
        return [hashlib.sha256(raw[a : max(a, b - 1)]).hexdigest() for a, b in zip(last, last[1:], strict=False)]


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The worker's codec for a vocabulary file; it outlives the task."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def bpe_encode(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """Add the ids of each whole text as an array; a column of that name is replaced."""
    columns = [c for c in df.columns if c != out]
    df = df.select(*columns)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_path)
        for batch in batches:
            for at, some in slices(batch.column(columns.index(text))):
                ids, counts = coder.encode(some)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(some)) for c in batch.columns), lists], [*columns, out])

    return df.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the text of each array of ids (null: empty); a column of that name is replaced."""
    columns = [c for c in df.columns if c != out]
    df = df.select(*columns)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_path)
        for batch in batches:
            lists = batch.column(columns.index(ids)).to_pylist()
            counts = np.array([len(x or ()) for x in lists], dtype=np.int64)
            flat = np.fromiter(chain.from_iterable(x or () for x in lists), dtype=np.int64, count=int(counts.sum()))
            texts = coder.decode(flat, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string())], [*columns, out])

    return df.mapInArrow(run, schema)


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_round_trip(df: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the number of ids, a digest of the ids, and a digest of what they decode to.

    One pass does both ways, so that no id leaves the Python worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(tokenizer_path)
        for batch in batches:
            for at, some in slices(batch.column(1)):
                ids, counts = coder.encode(some)
                decoded = [hashlib.sha256(t.encode()).hexdigest() for t in coder.decode(ids, counts)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(some)), pa.array(counts), pa.array(coder.digests(ids, counts), pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, DIGESTS)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
