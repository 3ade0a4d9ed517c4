"""Fill-in-middle: cuts against regular expressions, exact ways back, the query against its SQL."""

from __future__ import annotations

import re

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trendspan.llm import middle as m

TEXTS = st.text(alphabet="ab\n\r é😀<PSM>\x00 ", max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_cuts_of_lines_and_characters(text, block):
    for unit, pattern in (("line", r"[^\n]*\n|[^\n]+"), ("char", r"(?s).")):
        units = re.findall(pattern, text)
        cutter = m.Cutter(text, unit, block)
        assert (cutter.n, cutter.chars) == (len(units), len(text))
        for k in range(len(units) + 1):
            before = "".join(units[:k])
            assert cutter.cut(k) == (len(before.encode()), len(before))


@settings(max_examples=300, deadline=None)
@given(TEXTS, st.tuples(*[st.integers(0, 2**32 - 1)] * 4), st.sampled_from(["line", "char"]), st.integers(0, 100), st.integers(0, 100))
def test_every_output_leads_back(text, draws, unit, fim, spm):
    n, form, prefix, middle, output = m.transform(text, draws, m.Draws(fim_rate=fim, spm_rate=spm), unit, 5)
    assert m.restore(output, form) == text
    if form == "plain":
        assert output == text and prefix is None and middle is None
    else:
        assert output.endswith(m.MIDDLE + text[prefix : prefix + middle])
        assert {"psm": m.PREFIX, "spm": m.SUFFIX}[form] == output[:3]
        assert len(output) == len(text) + 9


def test_counts_follow_edits():
    rng = np.random.default_rng(4)
    units, points = rng.integers(0, 5, 37), rng.integers(0, 9, 37)
    tree = m.BlockCounts(units.copy(), points.copy())
    for _ in range(30):
        at, u, p = int(rng.integers(37)), int(rng.integers(4)), int(rng.integers(4))
        units[at] += u
        points[at] += p
        tree.add(at, u, p)
    ends = np.cumsum(units)
    for k in range(1, int(ends[-1]) + 1):
        block = int(np.searchsorted(ends, k))
        assert tree.descend(k) == (block, int(units[:block].sum()), int(points[:block].sum()))


def test_a_very_long_text():
    text = "é😀 line\n" * 300_000
    cutter = m.Cutter(text)
    assert cutter.cut(123_456) == (len("é😀 line\n".encode()) * 123_456, 8 * 123_456)


ROWS = [
    (0, "a\nb\nc", "x"), (1, "", "x"), (2, None, "x"), (3, "<P> in it", "x"), (4, "one line", "x"), (5, "\n", "x"), (6, "\n\n\n", "x"),
    (7, "é\n😀\nz\n", "x"), (7, "é\n😀\nz\n", "x"), (7, "another\nof it", "y"), (-8, "neg\native", "x"), (None, "no\nid", "x"), (9, "a\n" * 5000, "x"), (10, "cut <\nS>\n<M", "x"),
]


def test_query_matches_sql(spark, tmp_path):
    rows = ROWS + [(100 + k, f"l{k}\n" * k + "é" * (k % 3), "x") for k in range(60)]
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(rows, "doc_id long, text string, form string").write.parquet(path)
    got = m.op13_middle(spark, str(tmp_path)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256").collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{path}/*.parquet')")
    assert sorted(map(tuple, got), key=str) == sorted(con.execute(m.OP13_SQL).fetchall(), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_real_outputs_keep_extra_columns(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, output string")
    out = m.restored(m.fill_in_middle(df, unit="char")).collect()
    assert len(out) == len(ROWS) and all(r.restored == (r.text or "") for r in out)
    assert m.fill_in_middle(df.limit(0)).count() == 0
