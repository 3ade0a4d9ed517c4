"""Pairs of titles that are alike: all pairs of blocks as matrix products, and what can be alike compared exactly.

By characters no rare part has to be shared, so an index finds most pairs of one language as candidates. Every cell, a pair of blocks
of titles, is a task's group of bounded size instead, and goes through four filters that lose nothing: the characters two titles have
in common (a product of count vectors), the adjacent characters they have in common (bits), their longest common subsequence, and
the similarity itself. The first one sees all pairs, so its vectors are short; it leaves about one pair of a hundred of one language.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendspan.functions import keywords as kw
from trendspan.operators.ranking import checkpoint_dir

#: Titles in a block: fewer while tables are small, so that there are cells for every core.
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 256, 16384, 16
#: Counters of a title's characters, of which the most frequent ones have ``OWN`` for themselves; bits of adjacent characters;
#: symbols, and classes of symbols in common subsequences. Sharing one only adds candidates.
WIDTH, OWN, BITS, SYMBOLS, CLASSES = 128, 96, 1024, 8192, 128
#: Pairs, and rows of a cell, that are looked at together.
SOME_PAIRS, SOME_ROWS = 1 << 14, 128
WORD = 64


def _symbols(keys: list[str]) -> np.ndarray:
    """All titles' characters one after another, as numbers from the most frequent one on."""
    codes = np.frombuffer("".join(keys).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    counts = np.bincount(codes)
    place = np.empty(len(counts), dtype=np.int64)
    place[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
    return place[codes] % SYMBOLS


def _numbered(title: np.ndarray, what: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``title, what, k`` in order: the k-th of equal ones in a title is an element of its own, so that common elements are common ones with their repeats."""
    both = np.sort(title * kinds + what)
    at = np.arange(len(both))
    new = np.ones(len(both), dtype=bool)
    new[1:] = both[1:] != both[:-1]
    return both // kinds, both % kinds, at - np.maximum.accumulate(np.where(new, at, 0))


def _counts(title: np.ndarray, symbols: np.ndarray, n: int) -> np.ndarray:
    """A row of counts for each title; a product of two is at least the number of characters in common."""
    title, symbol, k = _numbered(title, symbols, SYMBOLS)
    element = symbol * WORD + np.minimum(k, WORD - 1)
    often = np.bincount(element, minlength=1)
    place = np.empty(len(often), dtype=np.int64)
    place[np.argsort(-often, kind="stable")] = np.arange(len(often))
    column = np.where(place < OWN, place, OWN + place % (WIDTH - OWN))[element]
    return np.bincount(title * WIDTH + column, minlength=n * WIDTH).astype(np.float32).reshape(n, WIDTH)


def _bits(title: np.ndarray, symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each title's pairs of adjacent characters, and how many of these pairs have no bit of their own."""
    inside = np.flatnonzero(title[1:] == title[:-1])
    title, gram, k = _numbered(title[inside], symbols[inside] * SYMBOLS + symbols[inside + 1], SYMBOLS * SYMBOLS)
    mixed = (gram.astype(np.uint64) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    set_ = np.zeros((n, BITS), dtype=bool)
    set_[title, (mixed >> np.uint64(40)).astype(np.int64) % BITS] = True
    bits = np.packbits(set_, axis=1).view(np.uint64)
    return bits, np.bincount(title, minlength=n) - set_.sum(axis=1)


def _classes(title: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes of each title's first ``most`` characters, a row each, ``CLASSES`` behind its end; and for each class the mask of its places among the first 64."""
    at = np.arange(len(title)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.full((len(sizes), min(most, int(sizes.max(initial=0)))), CLASSES, dtype=np.int16)
    fits = at < out.shape[1]
    out[title[fits], at[fits]] = symbols[fits] % CLASSES
    masks = np.zeros((len(sizes), CLASSES + 1), dtype=np.uint64)
    row = np.arange(len(sizes))
    for i in range(min(WORD, out.shape[1])):
        masks[row, out[:, i]] |= np.uint64(1 << i)
    masks[:, CLASSES] = 0
    return out, masks


def common_subsequences(masks: np.ndarray, short: np.ndarray, long: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The lengths of the longest common subsequences of titles ``short``, rows of masks and of no more than 64 characters, and rows of classes (Hyyrö, 2004)."""
    flat, base = masks.reshape(-1), short * masks.shape[1]
    v = np.full(len(short), ~np.uint64(0))
    for column in np.ascontiguousarray(long.T):
        u = v & flat[base + column]
        v = (v + u) | (v - u)
    return np.bitwise_count(~v & (~np.uint64(0) >> (WORD - sizes).astype(np.uint64))).astype(np.int64)


def _common(a: str, b: str) -> int:
    """The same for two titles of any length."""
    masks: dict[str, int] = {}
    for at, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << at
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike_in_cell(keys: list[str], positions: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The positions, smaller ones first, of the pairs of one title of ``first`` and one of ``second`` (equal: of each pair once) that are alike, in parts."""
    n = len(keys)
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    title, symbols = np.repeat(np.arange(n), sizes), _symbols(keys)
    counts = _counts(title, symbols, n)
    bits, lost = _bits(title, symbols, n)
    # Titles longer than this are alike none of 64 characters.
    classes, masks = _classes(title, symbols, sizes, int(WORD * (2 / threshold - 1)) + 1)
    # Two more columns take the least number in common off the product.
    least = (-threshold / 2 * sizes).astype(np.float32)[:, None]
    ones = np.ones((n, 1), dtype=np.float32)
    rows = np.concatenate([counts, ones, least], axis=1)
    columns = np.ascontiguousarray(np.concatenate([counts, least, ones], axis=1)[second].T)
    slack = np.float32(0.01 + 1e-5 * sizes.max(initial=0))
    same = first is second
    for at in range(0, len(first), SOME_ROWS):
        some = first[at : at + SOME_ROWS]
        found = np.flatnonzero(rows[some] @ columns >= -slack)
        i, j = some[found // len(second)], second[found % len(second)]
        if same:
            i, j = i[i < j], j[i < j]
        for p in range(0, len(i), SOME_PAIRS):
            a, b = i[p : p + SOME_PAIRS], j[p : p + SOME_PAIRS]
            total = sizes[a] + sizes[b]
            common = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(lost[a], lost[b])
            left = (common >= (1.5 * threshold - 1) * total - 1 - 1e-6) & (np.minimum(sizes[a], sizes[b]) * 2 >= threshold * total - 1e-6)
            a, b = a[left], b[left]
            shorter = sizes[a] <= sizes[b]
            a, b = np.where(shorter, a, b), np.where(shorter, b, a)
            most = np.zeros(len(a), dtype=np.int64)
            fits = sizes[a] <= WORD
            if fits.any():
                most[fits] = common_subsequences(masks, a[fits], classes[b[fits], : int(sizes[b[fits]].max())], sizes[a[fits]])
            most[~fits] = list(starmap(_common, ((keys[u], keys[v]) for u, v in zip(a[~fits], b[~fits], strict=True))))
            left = 2 * most >= threshold * (sizes[a] + sizes[b]) - 1e-6
            a, b = a[left], b[left]
            earlier = positions[a] < positions[b]
            a, b = np.where(earlier, a, b), np.where(earlier, b, a)
            good = np.array([kw.similarity(keys[u], keys[v]) >= threshold for u, v in zip(a, b, strict=True)], dtype=bool)
            if good.any():
                yield positions[a[good]], positions[b[good]]


def alike_titles(titles: DataFrame, threshold: float) -> DataFrame:
    """``x, y`` of titles ``position`` (a unique long), ``key`` alike by ``threshold`` or more: twice the matching characters over all.

    Matching characters lie in blocks, and between two of these there is a character without a match. So titles of n and m
    characters have a common subsequence, and so characters in common, of at least threshold / 2 * (n + m), and at least
    (1.5 * threshold - 1) * (n + m) - 1 adjacent pairs of characters in common. Every pair that is alike is found.
    """
    checkpoint_dir(titles.sparkSession)
    rows = titles.select(F.col("position").cast("long").alias("position"), "key").where("key <> ''").checkpoint()
    n = rows.count()
    blocks = max(1, -(-n // min(MOST_BLOCK, max(LEAST_BLOCK, n // BLOCKS))))
    own = F.pmod(F.xxhash64("position"), F.lit(blocks)).cast("int")
    dealt = rows.select("position", "key", own.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o"))
    dealt = dealt.select(F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "position", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell = pa.Table.from_batches(batches)
        b = cell["b"].to_numpy()
        i, j = cell["i"][0].as_py(), cell["j"][0].as_py()
        first = np.flatnonzero(b == i)
        second = first if i == j else np.flatnonzero(b == j)
        for x, y in alike_in_cell(cell["key"].to_pylist(), cell["position"].to_numpy(), first, second, threshold):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["x", "y"])

    # The number is given, as cells are small in bytes but not in work.
    return dealt.repartition(min(blocks * (blocks + 1) // 2, 4096), "i", "j").groupBy("i", "j").applyInArrow(compare, "x long, y long")
