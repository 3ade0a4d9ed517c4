from __future__ import annotations

import random

from trendspan.llm import line_dedup as ld


def slow(rows, min_lines=4, min_chars=40):
    """Windows of lines in order of documents, by brute force."""
    docs = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda d: (d[0] is None, d[0] or 0))
    seen, seen_line, dead = set(), set(), {}
    for d in docs:
        lines = d[1].split("\n")
        gone = set()
        for i, line in enumerate(lines):
            if len(line) >= min_chars and line in seen_line:
                gone.add(i)
            seen_line.add(line)
            w = tuple(lines[i : i + min_lines])
            if len(w) == min_lines:
                if w in seen:
                    gone.update(range(i, i + min_lines))
                seen.add(w)
        dead[d] = gone
    out = []
    for doc_id, text, extra in rows:
        if text is None:
            out.append((doc_id, None, extra))
            continue
        lines = text.split("\n")
        kept = [x for i, x in enumerate(lines) if i not in dead[(doc_id, text)]]
        if kept:
            out.append((doc_id, "\n".join(kept), extra))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    pool = ["short %d" % i for i in range(6)] + ["a long line that says number %d of the pool" % i for i in range(6)]
    rows = []
    for i in range(60):
        lines = [rng.choice(pool) if rng.random() < 0.6 else "unique %d %d" % (i, k) for k in range(rng.randint(1, 25))]
        rows.append((i, "\n".join(lines), "x"))
    block = "\n".join("b%d" % k for k in range(12))
    rows += [(100 + i, "head %d\n" % i + block + "\ntail %d" % i, "y") for i in range(9)]
    rows += [(200, "r\n" * 20 + "r", "z"), (201, "", None), (202, None, "n"), (203, "\n\n\n\n\n", "e"), (None, block, "null id"), (300, rows[0][1], "copy"), (301, "same row", "s"), (301, "same row", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = sorted(map(tuple, ld.dedup_lines(spark, df).select("doc_id", "text", "h").collect()), key=str)
    assert got == slow(rows)


def test_intervals_at_every_depth(spark):
    """Intervals of the array against all pairs of suffixes, until no interval is left."""
    from collections import defaultdict

    from trendspan.llm.shared import Scratch

    rng = random.Random(6)
    texts = ["\n".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(12)] + ["x\n" * 40, "\n".join(str(k) for k in range(50)), "\n".join(str(k) for k in range(50)) + "\nend"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    scratch = Scratch(spark, "t")
    found = ld.suffix_array(scratch, scratch.write(ld.line_table(df), "lines"), 3)
    levels = {depth: rows.collect() for depth, rows, _ in found}
    assert sorted(levels) == [1, 2, 3, 6, 12, 24, 48]
    lines = [t.split("\n") for t in texts]
    for depth, rows in levels.items():
        want = defaultdict(set)
        for d, ls in enumerate(lines):
            for n in range(len(ls) - depth + 1):
                want[tuple(ls[n : n + depth])].add((d, n))
        got = defaultdict(set)
        for r in rows:
            got[r.rank].add((r.d, r.n))
        assert {frozenset(v) for v in got.values()} == {frozenset(v) for v in want.values() if len(v) > 1}
        # A rank is the first place of an interval in the array, so intervals don't overlap.
        ends = 0
        for rank in sorted(got):
            assert rank >= ends
            ends = rank + len(got[rank])


def test_maximal_runs(spark):
    block = "\n".join("b%d" % k for k in range(12))
    df = spark.createDataFrame([(1, block), (2, "own\n" + block + "\nown too"), (None, "b3\nb4\nb5\nb6\nb7\nz"), (4, "b0\nb1\nb2")], "doc_id long, text string")
    got = {tuple(r) for r in ld.repeated_runs(spark, df).collect()}
    assert got == {(2, 1, 12, 1, 0), (None, 0, 5, 1, 3)}
    assert ld.repeated_runs(spark, df.where("false")).collect() == []


def test_a_very_long_document(spark):
    """A line that is half of all suffixes, with thousands of continuations, and long documents that repeat."""
    body = "\n".join(x for k in range(3000) for x in ("common", "line %d" % (k // 2)))
    df = spark.createDataFrame([(1, body), (2, body), (3, "head\n" + body), (4, "common\n" * 5000)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in ld.dedup_lines(spark, df).collect()}
    want = {r[0]: r[1] for r in slow([(1, body, ""), (2, body, ""), (3, "head\n" + body, ""), (4, "common\n" * 5000, "")])}
    assert got == want


def test_keeps_columns_and_emptied_documents(spark):
    long = "this line is long enough to go on its own account"
    df = spark.createDataFrame([(1, long, len(long), "a"), (2, long, len(long), "b"), (3, "x\n" + long, 2 + len(long), "c")], "doc_id long, text string, n_chars long, d string")
    got = {r.doc_id: (r.text, r.n_chars, r.d, r.gone) for r in ld.dedup_lines(spark, df, keep_emptied=True, removed="gone").collect()}
    assert got == {1: (long, len(long), "a", 0), 2: ("", 0, "b", 1), 3: ("x", 1, "c", 1)}


def test_empty_table(spark):
    assert ld.dedup_lines(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []
