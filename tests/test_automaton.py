"""The automaton against each keyword's own containment, over catalogues of many blocks."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from trendspan.functions.text import STOP_WORDS
from trendspan.operators import automaton

SCHEMA = "keyword_id long, keyword string, aliases array<string>"


def holds(text, term):
    low = term.lower()
    if len(term) <= 2:
        return re.search(rf"\b{re.escape(low)}\b", text, re.ASCII) is not None
    words = [w for w in low.split() if len(w) >= 3 and w not in STOP_WORDS]
    return low in text if len(words) <= 1 else all(w in text for w in words)


def made_up(rng, n):
    syllables = "ka to mi re su the new an x 4 모델 ö -".split(" ")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    return " ".join(word() for _ in range(n()))


def test_many_keywords_in_many_blocks(spark):
    rng = random.Random(11)
    keywords = [(k, made_up(rng, lambda: rng.randint(1, 3)), [made_up(rng, lambda: rng.randint(1, 2))] if k % 3 == 0 else None) for k in range(3000)]
    bodies = [(k, made_up(rng, lambda: rng.randint(0, 60)).title()) for k in range(40)] + [(40, None), (41, "")]
    items = spark.createDataFrame(bodies, "item_idx long, body string")
    table = spark.createDataFrame(keywords, SCHEMA)
    # Without Hangul a keyword's terms are itself and its aliases.
    plain = table.where(~F.col("keyword").rlike("[가-힣]") & ~F.coalesce(F.array_join("aliases", " ").rlike("[가-힣]"), F.lit(False)))
    want = {(r.keyword_id, i) for r in plain.collect() for i, b in bodies if b is not None and any(holds(b.lower(), t) for t in [r.keyword, *(r.aliases or [])])}
    assert len(want) > 1000
    for letters in (10**6, 5000):
        got = [(r.keyword_id, r.item_idx) for r in automaton.match(items, plain, carried=["item_idx"], letters=letters).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_a_catalogue_of_twenty_thousand(spark):
    keywords = [(k, f"term{k} word{k % 7}", []) for k in range(20_000)]
    items = spark.createDataFrame([(i, f"word{i % 7} and term{i} term{i + 1}") for i in range(100)], "item_idx long, body string")
    got = {(r.keyword_id, r.item_idx) for r in automaton.match(items, spark.createDataFrame(keywords, SCHEMA), carried=["item_idx"]).collect()}
    want = set()
    for i in range(100):
        for k in range(110):
            if f"word{k % 7}" in f"word{i % 7}" and any(f"term{k}" in t for t in (f"term{i}", f"term{i + 1}")):
                want.add((k, i))
    assert got == want


def test_rows_of_one_id_and_hangul(spark):
    table = spark.createDataFrame([(1, "alpha", []), (1, "beta", ["al"]), (2, "", [None]), (3, None, None), (4, "모델링", []), (5, "모델 gamma-kit", [])], SCHEMA)
    items = spark.createDataFrame([(1, "alpha beta al"), (2, "the gamma-kit"), (3, "새 모델링")], "item_idx long, body string")
    got = sorted((r.keyword_id, r.item_idx) for r in automaton.match(items, table, carried=["item_idx"]).collect())
    assert got == [(1, 1), (4, 3), (5, 2)]
