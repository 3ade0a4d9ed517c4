"""Periodic runs of words: recompression into a run-length grammar, whose extension queries make candidates exact.

A run is a stretch of consecutive words whose smallest period ``q`` (words ``q`` apart are identical) repeats at least
``repeats`` times, which is at least ``least`` words long, and which no neighbouring word extends keeping period ``q``.

Spark deals out the documents; a task works on a slice of whole texts as one sequence of word ids, in which separators
that occur once part the documents, the longest first.

1. *Harmonic grid.* For every period ``q`` the words at multiples of ``q`` are compared. A run of four periods covers four
   multiples of ``q``, so equal words at four of them in a row are a candidate. That is ``n / q`` comparisons for ``q``, and
   ``n log n`` in all; documents too short for a period are left out of its comparisons.
2. *Recompression.* The documents that have candidates are compressed by turns: maximal blocks of one symbol become a
   symbol each, then pairs of a symbol of one class and a symbol of the other one. A symbol stands for the same words
   wherever it occurs, and equal stretches are parsed alike but for a symbol at either end of each level.
3. *Extension.* How far two places agree, to the right and to the left, is read off the grammar: up level by level while
   both places begin a symbol of the next level, and down again where symbols differ, with one step a level at most. All
   candidates climb together, as arrays. A candidate's two extensions give its maximal stretch; stretches that are long
   enough are runs, each with the smallest period that found it.

No suffix array is built, and no comparison depends on a hash: symbols are numbered by what they stand for.

Edge cases: a null or empty text has no words and no runs, and its kept text is empty; null ids are kept as they are; each
row counts by itself, also where ids or rows repeat; extra columns are passed over. A text of any length is worked on whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm.pieces import slices
from trendspan.llm.shared import table

#: Fewest words of a run, and how often its period has to fit.
LEAST, REPEATS = 6, 4
#: Bytes of text that a task works on together.
SLICE = 4_000_000
#: Candidates that climb together.
TOGETHER = 500_000
#: Compression ends where a sequence has no more symbols than this beyond one for each document and separator.
REST = 64

_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Level:
    """A sequence of symbols. ``parent`` leads to the next level's symbols, whose children here are ``first`` to ``last``."""

    symbols: np.ndarray
    blocks: bool = False
    parent: np.ndarray | None = None
    first: np.ndarray | None = None
    last: np.ndarray | None = None


class Grammar:
    """The run-length grammar of a sequence of word ids, none negative; negative symbols occur once each and are never merged.

    The sequence begins and ends with a negative symbol.
    """

    def __init__(self, symbols: np.ndarray):
        self.levels = [Level(symbols)]
        bound = int((symbols < 0).sum()) * 2 + REST
        names = int(symbols.max(initial=0)) + 1
        turn = 0
        while len(self.levels[-1].symbols) > bound:
            level = self.levels[-1]
            level.blocks = turn % 2 == 0
            if level.blocks:
                starts, symbols, names = self._blocks(level.symbols, names)
            else:
                starts, symbols, names = self._pairs(level.symbols, names, turn)
            turn += 1
            if len(starts) == len(level.symbols):
                continue
            level.first = starts
            level.last = np.append(starts[1:], len(level.symbols)) - 1
            level.parent = np.repeat(np.arange(len(starts)), level.last - starts + 1)
            self.levels.append(Level(symbols))

    @staticmethod
    def _named(merged: np.ndarray, keys: np.ndarray, symbols: np.ndarray, names: int) -> tuple[np.ndarray, int]:
        """Number the symbols that are merged by their keys; others keep theirs."""
        different, which = np.unique(keys, return_inverse=True)
        symbols[merged] = names + which
        return symbols, names + len(different)

    @classmethod
    def _blocks(cls, s: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, int]:
        starts = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
        size = np.diff(np.append(starts, len(s)))
        merged = np.flatnonzero(size > 1)
        out = s[starts]
        symbols, names = cls._named(merged, out[merged] * (len(s) + 1) + size[merged], out, names)
        return starts, symbols, names

    @classmethod
    def _pairs(cls, s: np.ndarray, names: int, turn: int) -> tuple[np.ndarray, np.ndarray, int]:
        """A symbol's class is a bit of its hash, another one each turn; of the two ways to pair the classes the one that pairs more."""
        bit = ((s.astype(np.uint64) + np.uint64(turn)) * _ODD ^ (_ODD << np.uint64(turn % 32))) * _ODD >> np.uint64(63)
        left, right = bit == 1, bit == 0
        left[s < 0] = right[s < 0] = False
        one, other = left[:-1] & right[1:], right[:-1] & left[1:]
        pair = np.flatnonzero(one if one.sum() >= other.sum() else other)
        begins = np.ones(len(s), dtype=bool)
        begins[pair + 1] = False
        starts = np.flatnonzero(begins)
        out = s[starts]
        symbols, names = cls._named(np.searchsorted(starts, pair), s[pair] * names + s[pair + 1], out, names)
        return starts, symbols, names

    def agree(self, i: np.ndarray, j: np.ndarray, step: int) -> np.ndarray:
        """For different places ``i`` and ``j``: how many symbols agree from there on (``step`` 1) or from there back (-1)."""
        a, b = i.copy(), j.copy()
        top = np.zeros(len(a), dtype=np.int64)
        climbing = np.arange(len(a))
        for k, level in enumerate(self.levels[:-1]):
            edge = level.first if step > 0 else level.last
            x, y = a[climbing], b[climbing]
            p, q = level.parent[x], level.parent[y]
            off = (edge[p] != x) | (edge[q] != y)
            move = np.flatnonzero(off & (level.symbols[x] == level.symbols[y]))
            n = self._steps(level, x[move], y[move], step)
            x[move] += step * n
            y[move] += step * n
            a[climbing], b[climbing] = x, y
            p, q = level.parent[x], level.parent[y]
            up = (edge[p] == x) & (edge[q] == y)
            top[climbing[~up]] = k
            climbing, p, q = climbing[up], p[up], q[up]
            a[climbing], b[climbing] = p, q
        k = len(self.levels) - 1
        top[climbing] = k
        last = self.levels[k].symbols
        while len(climbing):
            climbing = climbing[last[a[climbing]] == last[b[climbing]]]
            a[climbing] += step
            b[climbing] += step
        for k in range(len(self.levels) - 2, -1, -1):
            level = self.levels[k]
            edge = level.first if step > 0 else level.last
            down = np.flatnonzero(top > k)
            x, y = edge[a[down]], edge[b[down]]
            move = np.flatnonzero(level.symbols[x] == level.symbols[y])
            n = self._steps(level, x[move], y[move], step)
            x[move] += step * n
            y[move] += step * n
            a[down], b[down] = x, y
        return (a - i) * step

    @staticmethod
    def _steps(level: Level, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray | int:
        """How many equal symbols to pass: one, or what is left of the shorter of two blocks."""
        if not level.blocks:
            return 1
        if step > 0:
            return np.minimum(level.last[level.parent[x]] - x, level.last[level.parent[y]] - y) + 1
        return np.minimum(x - level.first[level.parent[x]], y - level.first[level.parent[y]]) + 1


def grid_candidates(s: np.ndarray, sizes: np.ndarray, repeats: int = REPEATS) -> Iterator[tuple[int, np.ndarray]]:
    """For each period the multiples of it from which on ``repeats`` multiples hold one word.

    ``s`` holds documents of ``sizes`` words, the longest first, each after a separator.
    """
    ends = np.cumsum(sizes + 1)
    for q in range(1, int(sizes[0]) // repeats + 1 if len(sizes) else 0):
        long_enough = int(np.searchsorted(-sizes, -(repeats * q), side="right"))
        grid = s[: ends[long_enough - 1] : q]
        same = grid[1:] == grid[:-1]
        if len(same) < repeats - 1:
            continue
        row = same[: len(same) - repeats + 2].copy()
        for k in range(1, repeats - 1):
            row &= same[k : len(same) - repeats + 2 + k]
        found = np.flatnonzero(row)
        if len(found):
            yield q, found * q


def find_runs(docs: list[np.ndarray], least: int = LEAST, repeats: int = REPEATS) -> list[np.ndarray]:
    """For each sequence of word ids its runs, as rows ``start, length, period`` by start and period."""
    none = np.empty((0, 3), dtype=np.int64)
    order = sorted(range(len(docs)), key=lambda k: -len(docs[k]))
    order = [k for k in order if len(docs[k]) >= max(least, repeats)]
    out = [none] * len(docs)
    if not order:
        return out
    sizes = np.array([len(docs[k]) for k in order], dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes
    s = np.full(int(sizes.sum()) + len(order) + 1, -1, dtype=np.int64)
    s[np.append(begins - 1, len(s) - 1)] = -1 - np.arange(len(order) + 1)
    for k, at in zip(order, begins.tolist(), strict=True):
        s[at : at + len(docs[k])] = docs[k]
    places = list(grid_candidates(s, sizes, repeats))
    if not places:
        return out
    period = np.repeat([q for q, _ in places], [len(x) for _, x in places])
    at = np.concatenate([x for _, x in places])
    doc = np.searchsorted(begins, at, side="right") - 1
    inside = at + (repeats - 1) * period < (begins + sizes)[doc]
    period, at, doc = period[inside], at[inside], doc[inside]
    if not len(at):
        return out
    # Only documents that have candidates are compressed.
    used = np.zeros(len(order), dtype=bool)
    used[doc] = True
    kept = np.append(np.repeat(used, sizes + 1), True)
    moved = np.cumsum(kept) - 1
    grammar, at = Grammar(s[kept]), moved[at]
    found = _runs(grammar, at, period, least, repeats)
    starts = moved[begins]
    doc = np.flatnonzero(used)[np.searchsorted(starts[used], found[:, 0], side="right") - 1] if len(found) else np.empty(0, dtype=np.int64)
    for d in np.unique(doc).tolist():
        rows = found[doc == d]
        rows[:, 0] -= starts[d]
        out[order[d]] = rows
    return out


def _runs(grammar: Grammar, at: np.ndarray, period: np.ndarray, least: int, repeats: int) -> np.ndarray:
    """The maximal stretches around candidates, in ascending order of start and period."""
    size = len(grammar.levels[0].symbols)
    # A place's last known run; a candidate of a multiple of its period that lies inside would find the same stretch.
    run_end, run_period = np.zeros(size, dtype=np.int64), np.ones(size, dtype=np.int64)
    found = []
    low = 0
    while low < len(at):
        # Periods of one binary order together, so that shorter ones are known before their multiples are looked at.
        high = int(np.searchsorted(period, 1 << int(period[low]).bit_length(), side="left"))
        high = min(high, low + TOGETHER)
        x, q = at[low:high], period[low:high]
        low = high
        new = (run_end[x] < x + q + 1) | (q % run_period[x] != 0)
        x, q = x[new], q[new]
        if not len(x):
            continue
        right = grammar.agree(x, x + q, 1)
        left = grammar.agree(x - 1, x + q - 1, -1)
        start, length = x - left, left + right + q
        some = length >= np.maximum(least, repeats * q)
        rows = np.unique(np.stack([start[some], length[some], q[some]], axis=1), axis=0)
        for a, n, p in rows.tolist():
            run_end[a : a + n], run_period[a : a + n] = a + n, p
        found.append(rows)
    rows = np.unique(np.concatenate([np.empty((0, 3), dtype=np.int64), *found]), axis=0)
    # A stretch that several periods found has the smallest one.
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[first]
    return rows[np.lexsort([rows[:, 2], rows[:, 0]])]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words stay where of each run only its first period stays."""
    edges = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) == 0


#: Gives, for a document's id and number of words, the order in which to take the words; ``None`` for the given one.
Rewrite = Callable[[int | None, int], np.ndarray | None]

RUNS = "doc_id long, n_words long, starts array<long>, lengths array<long>, periods array<long>, collapsed string"


def _found(ids: list[int | None], texts: list[bytes], rewrite: Rewrite | None, least: int, repeats: int):
    """For each document its id, words, runs and the words that stay."""
    split = [t.split() for t in texts]
    names: dict[bytes, int] = {}
    flat = np.fromiter(map(names.setdefault, chain.from_iterable(split), count()), dtype=np.int64, count=sum(map(len, split)))
    docs = np.split(flat, np.cumsum([len(w) for w in split])[:-1])
    for k, doc_id in enumerate(ids):
        order = rewrite(doc_id, len(docs[k])) if rewrite else None
        if order is not None:
            docs[k] = docs[k][order]
            split[k] = [split[k][i] for i in order.tolist()]
    for doc_id, words, runs in zip(ids, split, find_runs(docs, least, repeats), strict=True):
        yield doc_id, words, runs, list(compress(words, kept_words(len(words), runs).tolist())) if len(runs) else words


def _over_slices(key: pa.Array, text: pa.Array):
    for at, some in slices(text, SLICE):
        yield key.slice(at, len(some)).to_pylist(), [(t or "").encode() for t in some.to_pylist()]


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, repeats: int = REPEATS, rewrite: Rewrite | None = None) -> DataFrame:
    """Per row: its number of words, the start, length and period of every run, and the text of the words that stay, joined by blanks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _over_slices(batch.column(0), batch.column(1)):
                rows = [(d, len(w), *(runs[:, k].tolist() for k in range(3)), b" ".join(kept).decode()) for d, w, runs, kept in _found(ids, texts, rewrite, least, repeats)]
                yield pa.RecordBatch.from_pydict(dict(zip(("doc_id", "n_words", "starts", "lengths", "periods", "collapsed"), map(list, zip(*rows, strict=True)), strict=True)), schema=schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", longs), ("lengths", longs), ("periods", longs), ("collapsed", pa.string())])
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, RUNS)


def planted_period(doc_id: int | None, n: int) -> np.ndarray | None:
    """The contract's rewriting: the words of every tenth document, by a checksum of its id, repeat from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + np.arange(n - a) % p
    return order


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, rewritten as the contract has it, and digests of the runs and of what stays."""
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_period)
    runs = F.arrays_zip("starts", "lengths", "periods")
    # The longest run; of equally long ones the first, and then the one of the shortest period.
    ranked = F.transform(runs, lambda r: F.struct((-r.lengths).alias("n"), r.starts.alias("start"), r.periods.alias("period")))
    rows = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r.starts.cast("string"), r.lengths.cast("string"), r.periods.cast("string")), F.lit("\n")))
    return found.withColumn("best", F.array_min(ranked)).select(
        "doc_id",
        F.size("starts").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.n")).alias("length"),
        F.col("best.period").alias("period"),
        F.floor(1000 * -F.col("best.n") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.concat_ws("", rows), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
