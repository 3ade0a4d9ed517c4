"""Packing: whole documents, gapless sequences, and hardly more of them than the tokens need."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trendspan.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_places(where, offset, sizes, length):
    for b in set(where.tolist()):
        mine = sorted((o, s) for w, o, s in zip(where.tolist(), offset.tolist(), sizes.tolist(), strict=True) if w == b)
        at = 0
        for o, s in mine:
            assert o == at
            at += s
        assert at <= length


def first_fit_decreasing(sizes):
    gaps = []
    for s in sorted(sizes, reverse=True):
        k = next((k for k, g in enumerate(gaps) if g >= s), None)
        if k is None:
            gaps.append(1024 - s)
        else:
            gaps[k] -= s
    return len(gaps)


@pytest.mark.parametrize("low, high, n", [(1, 1024, 3000), (1, 60, 500), (400, 900, 500), (513, 1023, 50), (1, 1, 5000), (300, 350, 999)])
def test_pack(low, high, n):
    rng = np.random.default_rng(n)
    sizes = rng.integers(low, high + 1, n)
    where, offset = pk.pack(sizes)
    check_places(where, offset, sizes, 1024)
    assert where.max() + 1 <= first_fit_decreasing(sizes.tolist()) * 1.01 + 1


def plain_change(open_bins, size, gap, length):
    before = dict(open_bins)
    if gap < length:
        before[gap] -= 1
    if gap > size:
        before[gap - size] = before.get(gap - size, 0) + 1
    return sum(v * v for v in before.values()) - sum(v * v for v in open_bins.values())


def test_each_place_makes_the_squares_smallest():
    rng = random.Random(2)
    bins = pk.Bins(32)
    for _ in range(400):
        size = rng.randint(1, 32)
        open_bins = {g: int(n) for g, n in enumerate(bins.open) if n}
        choices = {g: plain_change(open_bins, size, g, 32) for g in [*open_bins, 32] if g >= size}
        _, offset = bins.place(size, False)
        assert choices[32 - offset] == min(choices.values())


def test_emptiest_bins():
    where, sizes = np.array([0, 0, 1, 2, 2, 3, 3, 3]), np.array([5, 5, 9, 2, 1, 4, 3, 3])
    assert pk.emptiest(where, sizes, 10, 2).tolist() == [False, False, True, True, True, False, False, False]
    assert not pk.emptiest(where, sizes, 10, 8).any()


def texts():
    rng = random.Random(12)
    words = "one two three four é😀 five\n".split(" ")
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 50, 500, 3000]))) for _ in range(120)]
    return [(k, t, "x") for k, t in enumerate(out)] + [(3, out[3], "x"), (3, out[3], "x"), (None, "no id", "x"), (-5, None, "x"), (500, "", "x"), (501, "a" * 50_000, "x")]


def test_query_holds_every_document(spark, tmp_path):
    rows = texts()
    spark.createDataFrame(rows, "doc_id long, text string, length string").write.parquet(f"{tmp_path}/documents.parquet")
    got = pk.op12_packing(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(PATH)
    want = []
    for doc_id, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids), 1024), len(ids)]
        want += [(doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    names = {s: k for k, s in enumerate({r.sequence_id for r in got})}
    check_places(np.array([names[r.sequence_id] for r in got]), np.array([r.offset for r in got]), np.array([r.length for r in got]), 1024)
    assert len(names) <= first_fit_decreasing([r.length for r in got]) + 1


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame(texts(), "doc_id long, text string, length string")
    packed = pk.pack_documents(df, PATH)
    whole = {r.sequence_id: np.frombuffer(r.ids, dtype="<u2") for r in pk.sequences(packed).collect()}
    for r in packed.collect():
        ids = whole[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(ids.astype("<u4").tobytes()) == r.ids_crc32


def test_rests_of_groups_are_packed_again(spark):
    rng = random.Random(9)
    sizes = [rng.randint(1, 100) for _ in range(6000)] + [100] * 50
    df = spark.createDataFrame([(k, s) for k, s in enumerate(sizes)], "doc_id long, length long")
    got = pk.pack_pieces(spark, df, 100, 300).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(sizes))
    names = {s: k for k, s in enumerate({r.sequence_id for r in got})}
    check_places(np.array([names[r.sequence_id] for r in got]), np.array([r.offset for r in got]), np.array([r.length for r in got]), 100)
    assert len(names) <= -(-sum(sizes) // 100) * 1.03
    assert pk.pack_pieces(spark, df.limit(0), 100).count() == 0


def test_pieces_that_fill_no_sequence(spark):
    df = spark.createDataFrame([(k, 60) for k in range(2000)], "doc_id long, length long")
    assert pk.pack_pieces(spark, df, 100, 100).select("sequence_id").distinct().count() == 2000
