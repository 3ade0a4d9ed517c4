"""Benchmark passages in training documents: a word count that no copy can fail, then Smith-Waterman alignment.

An alignment scores 2 for each word that matches and -1 for each other column, so one that reaches the threshold (half
of the item's best score) matches at least half of the item's words, within a span of at most twice the item's length.
Texts are cut into windows that overlap by such a span. Every window that holds that many of an item's words, in
whatever order, is aligned with it, so no copy of that score is missed, however its edits lie and however often it or
its item is in the corpus: nothing depends on counts over documents.

To find these windows, each item lists its words by how few items have them, rarest first, up to ``MORE`` words beyond
what a copy may lack; of these at least ``MORE`` are in any copy. Windows with as many of them have all the item's words
looked up. Local alignment over words then finds exact, edited and paraphrased copies. The score is the alignment's
score over the most that the item could reach, so 1 means that the whole item is there unchanged.

The items are broadcast while their text has at most ``BLOCK_BYTES`` bytes; a larger benchmark is worked off in
blocks of items of that size, each over all documents, so what is broadcast is bounded.

Words are runs of word characters in lower case. Items with fewer than ``SHORT_ITEM`` words have to be there whole;
items without words are never found. Edge cases: null and empty texts are never contaminated; equal items are found
each; of a null doc_id the row is kept with that id; rows equal in doc_id give their best alignment together; texts
are searched whole, whatever their length, and windows of like width are aligned together, so a long one doesn't widen
the others' tables; equal scores are one row each, as every item found is listed; empty tables give an empty table;
extra columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trendspan.llm.shared import table

#: Rare words of an item that a window has to have at least before all are looked up.
MORE = 4
MATCH, MISMATCH, GAP = 2, -1, -1
#: A document is contaminated by an item from this score on.
THRESHOLD = 0.5
#: Items with fewer words than this have to be there whole.
SHORT_ITEM = 8
BLOCK_BYTES = 16_000_000
#: Alignments made side by side, and the most cells that a row of their tables has together.
BATCH, CELLS = 256, 1_000_000
#: Words of texts, and entries of word lists, that are held at once.
TEXT_WORDS, ENTRIES = 50_000, 2_000_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Items:
    """A block of test items as arrays of word numbers, and the windows of texts that may hold copies of them."""

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD):
        rows = [(i, w) for i, t in rows if (w := words(t))]
        self.ids = [i for i, _ in rows]
        self.vocabulary = {w: n for n, w in enumerate(sorted({w for _, t in rows for w in t}))}
        self.base = len(self.vocabulary)
        self.words = [np.array([self.vocabulary[w] for w in t], dtype=np.int64) for _, t in rows]
        size = np.array([len(w) for w in self.words], dtype=np.int64)
        #: The least score of each item, of 1.
        self.least = np.where(size < SHORT_ITEM, 1.0, threshold)
        # With M matches and X other columns, 2M - X is at least 2 * least * size: so M is at least this, and M + X at most that.
        self.need = np.maximum(np.ceil(self.least * size - 1e-9).astype(np.int64), 1)
        reach = np.ceil((3 - 2 * self.least) * size).astype(np.int64)
        distinct = [np.unique(w, return_counts=True) for w in self.words]
        #: Each item's different words and how often it has them; an item's begin at ``first``.
        self.parts = np.concatenate([w for w, _ in distinct]) if distinct else np.empty(0, dtype=np.int64)
        self.times = np.concatenate([n for _, n in distinct]) if distinct else np.empty(0, dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum([len(w) for w, _ in distinct])]).astype(np.int64)
        of_items = np.bincount(self.parts, minlength=self.base)
        lists: dict[int, list[tuple[int, int, int]]] = {}
        for k, (w, n) in enumerate(distinct):
            order = np.lexsort((w, of_items[w]))
            listed = min(size[k], size[k] - self.need[k] + MORE)
            some = order[: int(np.searchsorted(np.cumsum(n[order]), listed)) + 1]
            block = 1 << int(reach[k] - 1).bit_length()
            lists.setdefault(block, []).extend((w, k, n) for w, n in zip(w[some].tolist(), n[some].tolist(), strict=True))
        #: By length of blocks: where each word's entries begin; the entries' items; how often these have the word.
        self.lists = {}
        for block, entries in sorted(lists.items()):
            word, item, n = np.array(sorted(entries), dtype=np.int64).T
            self.lists[block] = (np.searchsorted(word, np.arange(self.base + 1)), item, n)

    def numbers(self, text: str | None) -> np.ndarray:
        """The numbers of a text's words; -1 for words that no item has."""
        found = words(text)
        get = self.vocabulary.get
        return np.fromiter((get(w, -1) for w in found), dtype=np.int64, count=len(found))

    def candidates(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """Text, item, first and last word of each window with enough of the item's words."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        numbers = np.concatenate(texts)
        at = np.flatnonzero(numbers >= 0)
        text = np.repeat(np.arange(len(texts)), sizes)[at]
        for block, lists in self.lists.items():
            # Window j of a text has its blocks j - 1 and j, so a span of one block's length is whole in some window.
            count = sizes // block + 2
            offset = np.cumsum(count) - count
            held = (offset[text] + (at - starts[text]) // block) * self.base + numbers[at]
            held = np.unique(np.concatenate([held, held + self.base]))
            for window, item in self._windows(held, lists):
                t = np.searchsorted(offset, window, side="right") - 1
                a = (window - offset[t] - 1) * block
                yield from zip(t.tolist(), item.tolist(), np.maximum(a, 0).tolist(), np.minimum(a + 2 * block, sizes[t]).tolist(), strict=True)

    def _windows(self, held: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows and items with enough words in common; ``held`` has the windows' different words in order."""
        begin, items, times = lists
        window, word = np.divmod(held, self.base)
        n = begin[word + 1] - begin[word]
        # Whole windows, with about as many entries at once as may be held.
        new = np.flatnonzero(np.diff(window, prepend=-1))
        part = (np.cumsum(n) - n)[new] // ENTRIES
        cuts = [*new[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(held)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            entry = _ranges(begin[word[a:b]], n[a:b])
            pair = np.repeat(window[a:b], n[a:b]) * len(self.ids) + items[entry]
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            if not len(first):
                continue
            pair, total = pair[first], np.add.reduceat(times[entry][order], first)
            pair = pair[total >= np.minimum(MORE, self.need[pair % len(self.ids)])]
            for c in range(0, len(pair), BATCH * BATCH):
                w, k = np.divmod(pair[c : c + BATCH * BATCH], len(self.ids))
                m = self.first[k + 1] - self.first[k]
                place = _ranges(self.first[k], m)
                wanted = np.repeat(w, m) * self.base + self.parts[place]
                near = np.minimum(np.searchsorted(held, wanted), len(held) - 1)
                shared = np.add.reduceat(np.where(held[near] == wanted, self.times[place], 0), np.cumsum(m) - m)
                keep = shared >= self.need[k]
                yield w[keep], k[keep]


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from each of ``first`` on, ``n`` of them, one range behind the other."""
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def align(queries: list[np.ndarray], targets: list[np.ndarray]) -> np.ndarray:
    """The Smith-Waterman scores of pairs of word sequences, with linear gaps, side by side.

    A row of the matrix is one array operation for all pairs: gaps along the target are a running maximum.
    """
    rows, width = max(map(len, queries)), max(map(len, targets))
    # The narrowest numbers that hold every value of the table.
    kind = np.int16 if MATCH * rows + width < 1 << 15 else np.int32
    q = np.full((len(queries), rows), -2, dtype=np.int32)
    t = np.full((len(targets), width), -3, dtype=np.int32)
    for i, (a, b) in enumerate(zip(queries, targets, strict=True)):
        q[i, : len(a)] = a
        t[i, : len(b)] = np.where(b < 0, -3, b)
    slope = (np.arange(width) * -GAP).astype(kind)
    above = np.zeros((len(queries), width), dtype=kind)
    best = np.zeros(len(queries), dtype=kind)
    for r in range(rows):
        score = np.where(t == q[:, r : r + 1], kind(MATCH), kind(MISMATCH))
        now = score.copy()
        now[:, 1:] += above[:, :-1]
        np.maximum(now, above + kind(GAP), out=now)
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        best = np.maximum(best, now.max(axis=1))
        above = now
    return best


def batches_of(pairs: list) -> Iterator[list]:
    """Consecutive pairs, of which the widest times their number is bounded unless one alone is wider."""
    at = 0
    while at < len(pairs):
        widest, upto = len(pairs[at][2]), at + 1
        while upto < min(len(pairs), at + BATCH) and max(widest, len(pairs[upto][2])) * (upto + 1 - at) <= CELLS:
            widest = max(widest, len(pairs[upto][2]))
            upto += 1
        yield pairs[at:upto]
        at = upto


SCORES = "doc_id long, item_id long, score double"


def item_blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of at most ``limit`` bytes of text, or one item."""
    block, size = [], 0
    for row in benchmark.select(F.col(item).cast("long"), F.col(text)).toLocalIterator():
        n = len((row[1] or "").encode())
        if block and size + n > limit:
            yield block
            block, size = [], 0
        block.append((row[0], row[1]))
        size += n
    if block:
        yield block


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, score``: the documents and the items whose copies they hold."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = docs.sparkSession.createDataFrame([], SCORES)
    for block in item_blocks(benchmark, item, item_text, block_bytes):
        found = found.unionByName(_scores(rows, Items(block, threshold)))
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _scores(rows: DataFrame, items: Items) -> DataFrame:
    def scored(pairs: list) -> Iterator[pa.RecordBatch]:
        # Windows of like length side by side.
        pairs.sort(key=lambda p: (len(items.words[p[1]]), len(p[2])))
        for some in batches_of(pairs):
            scores = align([items.words[k] for _, k, _ in some], [w for *_, w in some])
            most = np.array([MATCH * len(items.words[k]) for _, k, _ in some])
            needed = np.array([items.least[k] for _, k, _ in some])
            keep = np.flatnonzero(scores >= needed * most - 1e-6)
            yield pa.RecordBatch.from_arrays(
                [pa.array([some[i][0] for i in keep], pa.int64()), pa.array([items.ids[some[i][1]] for i in keep], pa.int64()), pa.array((scores / most)[keep])],
                ["doc_id", "item_id", "score"],
            )

    def found(docs: list, texts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs, cells = [], 0
        for t, k, a, b in items.candidates(texts):
            pairs.append((docs[t], k, texts[t][a:b]))
            cells += b - a
            if cells > CELLS:
                yield from scored(pairs)
                pairs, cells = [], 0
        yield from scored(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, texts, held = [], [], 0
        for batch in batches:
            for doc, t in zip(batch.column(0), batch.column(1), strict=True):
                docs.append(doc.as_py())
                texts.append(items.numbers(t.as_py()))
                held += len(texts[-1])
                if held > TEXT_WORDS or len(docs) > TEXT_WORDS:
                    yield from found(docs, texts)
                    docs, texts, held = [], [], 0
        if docs:
            yield from found(docs, texts)

    return rows.mapInArrow(run, SCORES)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
