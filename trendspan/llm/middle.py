"""Fill-in-middle: documents cut into prefix, middle and suffix at unit bounds, and put in another order behind marks.

A text is cut where a number of its units ends: lines, or single code points. Counts of units and code points are kept
for blocks of a fixed number of bytes in a Fenwick tree. A cut goes down the tree by binary lifting to the block that
holds its unit's end, and only that block is read to find the place; the code points before it come off the same descent.

Edge cases: a null or empty text is plain and stays empty; null ids are drawn for as the text ``null``; each row counts by
itself, also where ids or rows repeat; a text that holds one of the marks is plain, since it could not be rebuilt; extra
columns are kept, and a column of a result's name is replaced. Texts of any length are cut whole. Cuts may fall together,
so that prefix, middle or suffix are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspan.llm.shared import table

#: Bytes of a block.
BLOCK = 4096
#: Code points in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class BlockCounts:
    """A Fenwick tree over a text's blocks: each node has the units' ends and the code points of the blocks that it spans."""

    def __init__(self, units: np.ndarray, points: np.ndarray):
        self.n = len(units)
        at = np.arange(1, self.n + 1)
        below = at - (at & -at)
        self.units, self.points = (np.append(0, (c := np.append(0, np.cumsum(counts)))[at] - c[below]) for counts in (units, points))

    def add(self, block: int, units: int, points: int) -> None:
        """Change the counts of a block, as an edit of its text does."""
        at = block + 1
        while at <= self.n:
            self.units[at] += units
            self.points[at] += points
            at += at & -at

    def descend(self, k: int) -> tuple[int, int, int]:
        """The block that holds the end of the ``k``-th unit (from 1), and the units and code points in the blocks before it."""
        at, units, points = 0, 0, 0
        step = 1 << self.n.bit_length()
        while step := step >> 1:
            if at + step <= self.n and units + self.units[at + step] < k:
                at += step
                units += int(self.units[at])
                points += int(self.points[at])
        return at, units, points


class Cutter:
    """A text with the counts of its blocks. ``unit`` is ``line`` (a run that a line feed ends, or the rest) or ``char``."""

    def __init__(self, text: str, unit: str = "line", block: int = BLOCK):
        if unit not in ("line", "char"):
            raise ValueError(f"no such unit: {unit}")
        self.raw, self.unit, self.block = text.encode(), unit, block
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        first = np.arange(0, len(self.raw), block)
        points = self._counted(self._begins(self.bytes), first)
        if unit == "char":
            units = points
        else:
            units = self._counted(self.bytes == 10, first)
            if len(self.raw) and self.raw[-1] != 10:  # the rest is a line as well
                units[-1] += 1
        self.counts = BlockCounts(units, points)
        self.n, self.chars = int(units.sum()), int(points.sum())

    @staticmethod
    def _begins(data: np.ndarray) -> np.ndarray:
        return (data & 0xC0) != 0x80

    @staticmethod
    def _counted(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
        return np.add.reduceat(marks, first, dtype=np.int64) if len(first) else np.zeros(0, dtype=np.int64)

    def cut(self, k: int) -> tuple[int, int]:
        """The byte and the code point at which the first ``k`` units end."""
        if k <= 0:
            return 0, 0
        if k >= self.n:
            return len(self.raw), self.chars
        block, units, points = self.counts.descend(k)
        at = block * self.block
        inside = self.bytes[at : at + self.block]
        if self.unit == "line":
            end = at + int(np.flatnonzero(inside == 10)[k - units - 1]) + 1
            return end, points + int(self._begins(inside[: end - at]).sum())
        # A character ends where the next one begins, maybe in a later block.
        end = at + int(np.flatnonzero(self._begins(inside))[k - units - 1]) + 1
        while end < len(self.raw) and not self._begins(self.bytes[end : end + 1])[0]:
            end += 1
        return end, k


@dataclass(frozen=True)
class Draws:
    """Rates in a hundred, and the salt from which a document's draws come."""

    salt: str = "7"
    fim_rate: int = 100
    spm_rate: int = 50

    def of(self, key: object) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.salt}:{'null' if key is None else key}".encode()).hexdigest()
        return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def transform(text: str, draws: tuple[int, int, int, int], rates: Draws, unit: str = "line", block: int = BLOCK) -> tuple[int, str, int | None, int | None, str]:
    """The number of units, the form, the code points of prefix and middle, and the output."""
    cutter = Cutter(text, unit, block)
    n = cutter.n
    h1, h2, h3, h4 = draws
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rates.fim_rate:
        return n, "plain", None, None, text
    (a, before), (b, upto) = (cutter.cut(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (cutter.raw[x:y].decode() for x, y in ((0, a), (a, b), (b, len(cutter.raw))))
    if h4 % 100 < rates.spm_rate:
        return n, "spm", before, upto - before, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", before, upto - before, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output came from."""
    if form == "plain":
        return output
    marks = (SUFFIX, PREFIX, MIDDLE) if form == "spm" else (PREFIX, SUFFIX, MIDDLE)
    rest, parts = output, {}
    if not rest.startswith(marks[0]):
        raise ValueError(f"not of the form {form}")
    rest = rest[len(marks[0]) :]
    parts[marks[0]], rest = rest.split(marks[1], 1)
    parts[marks[1]], parts[marks[2]] = rest.split(marks[2], 1)
    return parts[PREFIX] + parts[MIDDLE] + parts[SUFFIX]


ADDED = [
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
]


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", rates: Draws = Draws(), unit: str = "line", block: int = BLOCK) -> DataFrame:
    """Add the number of units, form, sizes and the output of each row."""
    added = [f.name for f in ADDED]
    columns = [c for c in df.columns if c not in added]
    fields = [*(df.schema[c] for c in columns), *ADDED]
    at_key, at_text = columns.index(key), columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [transform(t.as_py() or "", rates.of(k), rates, unit, block) for k, t in zip(batch.column(at_key).to_pylist(), batch.column(at_text), strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            arrays = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*columns, *added])

    return df.select(*columns).mapInArrow(run, T.StructType(fields))


def restored(df: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """Add the text that each output came from; a column of that name is replaced."""
    columns = [c for c in df.columns if c != out]
    at_output, at_form = columns.index(output), columns.index(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(o.as_py(), f) for o, f in zip(batch.column(at_output), batch.column(at_form).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, out])

    return df.select(*columns).mapInArrow(run, T.StructType([*(df.schema[c] for c in columns), T.StructField(out, T.StringType())]))


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document transformed by lines; digests of the outputs and of the texts rebuilt from them."""
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = fill_in_middle(documents).drop("text")
    return restored(cut).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS parts,
    sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
lines AS (
  SELECT doc_id, t, h, CASE WHEN parts[len(parts)] = '' THEN list_transform(parts[1:len(parts) - 1], lambda x: x || chr(10))
    ELSE list_append(list_transform(parts[1:len(parts) - 1], lambda x: x || chr(10)), parts[len(parts)]) END AS u FROM units),
draws AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM lines),
cuts AS (
  SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
      WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM draws),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
FROM parts
"""
