from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trendspan.llm import bpe, token_stream as ts
from trendspan.llm.shared import Scratch

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "  a", "a  ", "a \n b", "\n\n x", "a\x1cb  \x1c c", "a \x85b", "x\xa0 y", "a<|endoftext|>b", "a  <|endoftext|> b", "don't  we're 'll", "é" * 300, "ab" * 5000, "a　b 　 c", "😀😀 x", " " * 50, "\t \t\n x y", "a\0", "b\n", "\nb\nc\n\nd", "x" * 100_000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    letters = "ab 'stl\n\t1.é　<|  \n\n"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(500)]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encode_and_decode_as_the_library(spark, texts, library):
    rows = [(i, t, "extra") for i, t in enumerate(texts)] + [(7, None, None), (7, texts[7], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    encoded = bpe.bpe_encode(df, PATH)
    got = bpe.bpe_decode(encoded, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)


def test_digests(spark, texts, library):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    for r in bpe.bpe_round_trip(df, PATH).collect():
        t = "" if r.doc_id is None else texts[r.doc_id]
        ids = library.encode(t, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_long_words_merge_alike():
    coder = bpe.Codec(PATH)
    rng = random.Random(7)
    for _ in range(50):
        w = "".join(rng.choice("estina") for _ in range(rng.randint(2, 60))).encode()
        assert coder.merge_long(w) == coder.merge_same_length([w])[0]


@pytest.mark.parametrize("n", [1, 2, 2047, 2048, 2049, 20_000])
def test_files_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (np.minimum(rng.zipf(1.3, n), 50256), rng.integers(0, 65536, n), np.zeros(n), np.full(n, 65535)):
        ids = ids.astype(np.uint16)
        docs, counts, back = ts.unpack(ts.pack(np.array([5]), np.array([n]), ids))
        assert docs.tolist() == [5] and counts.tolist() == [n] and (back == ids).all()


def test_damage_is_noticed():
    data = bytearray(ts.pack(np.array([5]), np.array([3000]), np.arange(3000).astype(np.uint16)))
    for at in (0, 30, len(data) // 2, len(data) - 1):
        bad = bytearray(data)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            ts.unpack(bytes(bad))


def test_a_block_decodes_alone():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint16)
    order0 = ts._Order0.of(ids)
    coded = ts.encode_blocks(ids, order0, 1000)
    words = np.concatenate([np.frombuffer(coded[3], "<u4"), np.zeros(2, "<u4")])
    assert (ts.decode_blocks(words, np.array([0]), order0, 1000) == ids[3000:4000]).all()


def plain_mixture(ids, order0):
    """Each id's part of the mixture, by the models written out for one block."""
    tables, shares, out = [{}, {}], {}, []
    last = hashed = 0
    for x in ids.tolist():
        slots = [last * 40503 >> 5 & ts._SLOT, last * 40503 + hashed >> 5 & ts._SLOT]
        hashed = last * 30341
        (g1, c1), (g2, c2) = (tables[k].get(slots[k], (0, 0)) for k in (0, 1))
        w1, w2 = shares.get((c1, c2), (int(ts._FIRST1[c2 * 4 + c1]), int(ts._FIRST2[c2 * 4 + c1])))
        m1, m2 = w1 >> 5, w2 >> 5
        rest = (1 << ts._SHARE_BITS) - m1 - m2
        part = 1 << ts._PART_BITS
        start = rest * int(order0.starts[x]) + (m1 * (g1 < x) + m2 * (g2 < x)) * part
        size = rest * int(order0.sizes[x]) + (m1 * (g1 == x) + m2 * (g2 == x)) * part
        out.append((start, size))
        most = int(ts._MOST)
        shares[(c1, c2)] = (w1 + ((most * (g1 == x and g2 != x) - w1) >> 5), w2 + ((most * (g2 == x) - w2) >> 5))
        tables[0][slots[0]] = (x, min(c1 + 1, 3) * (g1 == x))
        tables[1][slots[1]] = (x, min(c2 + 1, 3) * (g2 == x))
        last = x
    return out


def test_parts_are_those_of_the_three_orders_mixed():
    rng = np.random.default_rng(5)
    phrases = [rng.integers(0, 400, 12) for _ in range(9)]
    ids = np.concatenate([phrases[k] if rng.random() < 0.8 else rng.integers(0, 400, 5) for k in rng.integers(0, 9, 60)])
    order0 = ts._Order0.of(ids)
    lanes = ts._Lanes(1, order0)
    want = plain_mixture(ids, order0)
    total = 1 << ts._TOTAL_BITS
    bits = 0.0
    for x, (start, size) in zip(ids, want, strict=True):
        lanes.predict()
        one = np.array([x])
        a, b = lanes.span(one)
        assert (int(a[0]), int(b[0])) == (start, size) and 0 <= start and start + size <= total
        # Every number of the part leads back to the id.
        for v in (start, start + size // 2, start + size - 1):
            assert lanes.ids(np.array([v]))[0] == x
        lanes.update(one)
        bits -= np.log2(size / total)
    coded = ts.encode_blocks(ids, order0, len(ids))
    assert 8 * len(coded[0]) <= bits + 100
    assert bits < 0.6 * len(ids) * np.log2(400)


def test_library_pieces(texts, library):
    ids, counts = ts.library(PATH).table.texts(pa.array([*texts, None], pa.string()))
    want = [library.encode(t, add_special_tokens=False).ids for t in [*texts, ""]]
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == want


def test_a_word_is_learned_once_whatever_follows_it(library):
    marks = ["", ".", ",", "!?", "...", ")", '"', "-", "_", "##", "'", "'s", "'S", "’s", "»", "\u0301.", "\x7f.", "\n", "\n\n", ".\n", " .", "\xa0."]
    words = [" gerontion", " Züriché", "a×", "a÷", " ß", " x1", " 1x", " Ж", " 漢", " ÿ", " <|", " |>"]
    texts = [w + m + w + m for w in words for m in marks]
    pieces = ts.LibraryPieces(PATH)
    ids, counts = pieces.table.texts(pa.array(texts, pa.string()))
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    fresh = ts.LibraryPieces(PATH)
    fresh.table.texts(pa.array([f" gerontion{m}" for m in [".", ",", "!", "?", ";", ":", ")"]], pa.string()))
    assert fresh.table.count == 8


def test_token_files(spark, texts, library):
    rng = random.Random(8)
    rows = [(i * 3, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 2), (9, None, 3), (9, None, 3)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    path = f"{Scratch(spark, 'test').root}/files"
    ts.write_token_files(df, PATH, path, file_ids=5000)
    got = ts.read_token_files(spark, path).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for doc_id, t, _ in order:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    path = f"{Scratch(spark, 'test').root}/empty"
    ts.write_token_files(df, PATH, path)
    assert ts.read_token_files(spark, path).collect() == []
    assert bpe.bpe_round_trip(df, PATH).collect() == []
