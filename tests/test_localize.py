"""Classes of keywords, titles in calls, answers with gaps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from trendspan.operators import localize as lc

REPLIES = [
    ("1. one\n2) two\n\n3 - kept", ["one", "two", "3 - kept"]),
    ("1. one 2. two 3. three", ["one", "two", "three"]),
    ("only", ["only"]),
    ("  \n ", []),
    (None, []),
    ("1. 2024 in review\nnext", ["1. 2024 in review", "next"]),
]


@pytest.mark.parametrize(("reply", "lines"), REPLIES)
def test_lines_of_answers(spark, reply, lines):
    assert list(spark.createDataFrame([(reply,)], "r string").select(lc.answer_lines(F.col("r"))).first()[0]) == lines


def test_classes(spark):
    keywords = spark.createDataFrame([(1, "OpenAI"), (2, "AI 규제"), (3, "Data  Privacy"), (4, "Data Claude"), (5, None), (6, "")], "keyword_id int, keyword string")
    natural = spark.createDataFrame([("openai", "오픈AI")], "form string, localized string")
    concepts = spark.createDataFrame([("data", "데이터"), ("privacy", "프라이버시")], "word string, localized string")
    got = {r.keyword_id: (r.action, r.localized) for r in lc.classify(keywords, natural, concepts).collect()}
    assert got == {1: ("natural", "오픈AI"), 2: ("keep", "AI 규제"), 3: ("translate", "데이터 프라이버시"), 4: ("keep", "Data Claude"), 5: ("keep", None), 6: ("keep", "")}


def test_calls_hold_all_titles_and_answers_find_them(spark):
    rows = [(b, p, ("제목 " if p % 5 == 0 else "") + "t" * (1 + p * 7 % 30)) for b in range(2) for p in range(40)] + [(0, 99, " "), (3, 1, "alone")]
    calls = lc.title_calls(spark.createDataFrame(rows, "batch int, position int, title string"))
    got = calls.collect()
    assert len(got) == 81 and all(0 <= r.call < 4 for r in got)
    for b, t in {(r.batch, r.target) for r in got if r.batch < 3}:
        mine = [r for r in sorted(got, key=lambda r: r.position) if (r.batch, r.target) == (b, t)]
        assert [r.call for r in mine] == sorted(r.call for r in mine)
        sizes = [sum(len(r.title) for r in mine if r.call == c) for c in range(4)]
        assert max(sizes) <= sum(sizes) / 4 + 35
    replies = lc.prompts(calls).select("batch", "target", "call", F.when(F.col("call") != 1, F.upper("lines")).alias("reply"))
    for r in lc.joined_answers(calls, replies).join(calls.select("batch", "position", "call"), ["batch", "position"]).collect():
        assert r.localized == (r.title if r.call == 1 else r.title.upper())
