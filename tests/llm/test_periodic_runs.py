"""Periodic runs against every stretch of every period, on texts that repeat and texts that don't."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from trendspan.llm import periodic_runs as pr


def plain_runs(words, least=6, repeats=4):
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, repeats * q):
                found.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences(seed, rounds):
    rng = random.Random(seed)
    for _ in range(rounds):
        kinds, n = rng.choice([1, 2, 2, 3, 5, 50]), rng.choice([0, 3, 5, 6, 7, 20, 100, 300])
        w = [rng.randrange(kinds) for _ in range(n)]
        if rng.random() < 0.5 and n:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(1, 9)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        yield w


def test_runs_of_many_sequences_together():
    docs = list(sequences(3, 600))
    got = pr.find_runs([np.array(d, dtype=np.int64) for d in docs])
    for d, g in zip(docs, got, strict=True):
        assert [tuple(r) for r in g.tolist()] == plain_runs(d)


@pytest.mark.parametrize("least, repeats", [(4, 2), (6, 3), (12, 4)])
def test_other_limits(least, repeats):
    docs = list(sequences(least, 60))
    got = pr.find_runs([np.array(d, dtype=np.int64) for d in docs], least, repeats)
    for d, g in zip(docs, got, strict=True):
        assert [tuple(r) for r in g.tolist()] == plain_runs(d, least, repeats)


def test_overlapping_runs_and_short_ones():
    assert pr.find_runs([np.array([1] * 5)])[0].tolist() == []
    assert pr.find_runs([np.array([1] * 6)])[0].tolist() == [[0, 6, 1]]
    both = [1, 2] * 4 + [2] * 6 + [2, 1] * 4
    assert [tuple(r) for r in pr.find_runs([np.array(both)])[0].tolist()] == plain_runs(both)


def test_extensions_of_the_grammar():
    rng = random.Random(8)
    for kinds in (1, 2, 4):
        w = [rng.randrange(kinds) for _ in range(500)]
        s = np.array([-1, *w, -2], dtype=np.int64)
        grammar = pr.Grammar(s)
        i = np.array([rng.randrange(1, 501) for _ in range(400)])
        j = np.array([1 + (x + rng.randrange(499)) % 500 for x in i.tolist()])
        i, j = i[i != j], j[i != j]
        for step in (1, -1):
            got = grammar.agree(i, j, step).tolist()
            for x, y, n in zip(i.tolist(), j.tolist(), got, strict=True):
                assert all(s[x + step * k] == s[y + step * k] for k in range(n)) and s[x + step * n] != s[y + step * n]


def test_blocks_make_powers_short():
    grammar = pr.Grammar(np.array([-1, *[5] * 100_000, -2]))
    assert len(grammar.levels) == 2
    assert len(pr.Grammar(np.array([-1, *[5, 6, 7] * 30_000, -2])).levels) < 12


def test_a_long_text_of_one_word():
    assert pr.find_runs([np.zeros(300_000, dtype=np.int64)])[0].tolist() == [[0, 300_000, 1]]


def plain_row(doc_id, text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        a, g = (h // 10) % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id,
        len(runs),
        *(best or (None, None, None)),
        1000 * best[1] // best[2] if best else None,
        digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
        digest(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_matches_a_plain_one(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("a b cc d e é 😀".split(" ")) for _ in range(rng.randint(0, 90))) for _ in range(200)]
    rows = [(k, t, "x") for k, t in enumerate(texts)]
    rows += [(3, texts[3], "x"), (3, "again " * 9, "x"), (None, "n " * 8, "x"), (900, None, "x"), (901, "", "x"), (902, " \t\n", "x"), (-7, "a b " * 5, "x")]
    rows += [(10_000 + k, "one two three " * 400 + texts[k], "x") for k in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string, starts string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect()]
    want = [plain_row(d, t) for d, t, _ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 20


def test_real_outputs_and_empty_table(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y")], "doc_id long, text string")
    row = pr.periodic_runs(df).first()
    assert (row.n_words, list(row.starts), list(row.lengths), list(row.periods), row.collapsed) == (10, [1], [8], [2], "x a b y")
    assert pr.periodic_runs(df.limit(0)).count() == 0
