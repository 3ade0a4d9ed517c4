"""Assignments in rounds against the folds that they equal."""

from __future__ import annotations

import random

import pytest

from trendspan.operators import assignment, consolidation, identity


def fold_first(wants):
    taken, out = set(), {}
    for place in sorted({p for p, _, _ in wants}):
        for _, i in sorted((a, i) for p, a, i in wants if p == place):
            if i not in taken:
                taken.add(i)
                out[place] = i
                break
    return out


def fold_all(claims):
    taken, out = set(), set()
    for place in sorted({p for p, _ in claims}):
        mine = {c for p, c in claims if p == place}
        if not mine & taken:
            taken |= mine
            out.add(place)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_rounds_equal_the_folds(spark, seed):
    rng = random.Random(seed)
    wants = [(p, a, f"i{rng.randrange(12) if seed else 0}") for p in range(30) for a in range(rng.randrange(4))]
    got = assignment.first_free(spark.createDataFrame(wants, "place int, at int, id string")).collect()
    assert {r.place: r.id for r in got} == fold_first(wants)
    claims = [(p, f"c{rng.randrange(20)}") for p in range(30) for _ in range(rng.randint(1, 3))]
    got = assignment.all_free(spark.createDataFrame(claims, "place int, claim string")).collect()
    assert {r.place for r in got} == fold_all(claims)


def test_nothing_to_assign(spark):
    assert assignment.first_free(spark.createDataFrame([], "place int, at int, id string")).count() == 0
    assert assignment.all_free(spark.createDataFrame([], "place int, claim string")).count() == 0


KEYWORDS = "position int, own_id string, keyword string, aliases array<string>"


def test_canonical_ids_are_used_once(spark):
    history = [("Alpha  One", "h1", 1), ("alpha one", "h0", 0), ("beta", "h1", 1), ("ｂｅｔａ２", "h2", 1), ("gamma", "d", 5), ("x", "h9", 1)]
    keywords = [(1, "a", "ALPHA One", None), (2, "b", "Beta", ["beta2"]), (3, "c", "alphaone", ["x"]), (4, "d", "gamma", []), (5, "e", "beta2", [None, "ｇａｍｍａ"]), (6, "f", None, None)]
    got = identity.canonical_ids(spark.createDataFrame(keywords, KEYWORDS), spark.createDataFrame(history, "alias string, canonical_id string, created_at int"))
    assert {r.own_id: r.canonical_id for r in got.collect()} == {"a": "h1", "b": "h2", "c": "c", "d": "d", "e": "e", "f": "f"}


RANKED = "rank int, keyword_id string, keyword string, aliases array<string>, internal double, total double"


def order(spark, ranked, manual):
    got = identity.manual_priority(spark.createDataFrame(ranked, RANKED), spark.createDataFrame(manual, "position int, keyword string"), "realtime").orderBy("place")
    return [(r.keyword_id, r.total, r.is_manual) for r in got.collect()]


def test_manual_rows_come_first(spark):
    ranked = [(1, "a", "Agent Kit", [], 0.5, 5.0), (2, "b", "Claude Code", ["CC"], 0.4, 4.0), (3, "c", "cc", [], 0.3, 3.0)]
    got = order(spark, ranked, [(1, " claude  CODE "), (2, "Brand New"), (3, "claude code")])
    assert got[0] == ("b", 10.0, True)
    assert got[1][0].startswith("manual_realtime_") and got[1][1:] == (16.0, True)
    assert got[2:] == [("a", 5.0, False), ("c", 3.0, False)]


def test_one_row_for_each_manual_key_and_id(spark):
    ranked = [(1, "a", "one", ["two"], 0.5, 5.0), (2, "b", "two", [], 0.4, 4.0), (3, "a", "plain", [], 0.3, 3.0), (4, "d", "three", ["one"], 0.2, 2.0)]
    # Row 1 is the best for both manual keys; rows 2 and 4 collide with it, row 3 shares its id.
    assert order(spark, ranked, [(1, "two"), (2, "one")]) == [("a", 11.0, True)]
    # The best row of "three" is not let in after "one" took its key; "three" itself stays without a row.
    assert order(spark, ranked, [(1, "one"), (2, "three")]) == [("a", 11.0, True), ("b", 4.0, False)]


def test_no_manual_rows(spark):
    assert order(spark, [(2, "b", "x", [], 0.1, 1.0), (1, "a", "y", None, 0.1, 2.0)], []) == [("a", 2.0, False), ("b", 1.0, False)]


def plain_enriched(keywords, bridge, dependent, anchors):
    """The fold over entries, one after the other, as a dictionary of texts to aliases and items."""
    items = {}
    for k, i, *_ in bridge:
        items.setdefault(k, set()).add(i)
    domain, tier = {i: d for _, i, d, _ in bridge}, {i: t for _, i, _, t in bridge}
    of = lambda k: items.get(k, set())
    surface = str.lower
    out = {}

    def put(text, aliases, names):
        entry = out.setdefault(text.lower(), [text, [], set()])
        entry[1] += [a for a in dict.fromkeys(aliases) if a not in entry[1]]
        for n in names:
            entry[2] |= of(n)

    others = [k for k in keywords if not dependent[k[1]]]
    for _, k, text, aliases in others:
        put(text, aliases, [k])
    for _, k, text, aliases in keywords:
        if not dependent[k]:
            continue
        best = None
        for _, c, ctext, caliases in others:
            shared = len(of(k) & of(c))
            if not anchors[c] or ctext == text or shared < max(1, min(2, len(of(k)))):
                continue
            overlap = shared / len(of(k) | of(c))
            if overlap < (0.35 if len(of(k)) <= 2 else 0.45):
                continue
            score = round(overlap * 100 + shared * 8 + min(len({domain[i] for i in of(c)}), 8) * 2 + min(anchors[c], 5) * 3 + 4 * any(tier[i] == "P0_CURATED" for i in of(c)), 9)
            if best is None or score > best[0]:
                best = score, c, ctext, caliases
        if best is None:
            if len(of(k)) >= 4 and len({domain[i] for i in of(k)}) >= 3:
                put(text, aliases, [k])
        elif surface(text) in surface(best[2]):
            put(best[2], [*best[3], text, *aliases], [best[1], k])
        else:
            put(text if surface(best[2]) in surface(text) else f"{best[2]} {text}", [*best[3], *aliases, text], [best[1], k])
    return {text: (aliases, len(found)) for text, aliases, found in out.values()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_context_is_added_as_by_the_fold(spark, seed):
    rng = random.Random(seed)
    heads = ["voice mode", "agents", "Agents", "plugin", "mode"]
    named = ["Claude", "claude voice mode", "Qwen Kit", "kit mode", "Llama one two"]
    keywords = [(p, f"k{p:02}", t, [f"a{p % 4}"]) for p, t in enumerate(rng.sample(heads + named, 10))]
    bridge = [(k, i, f"d{i % 4}", rng.choice(["P0_CURATED", "P2_RAW"]) if i % 3 else "P1_CONTEXT") for _, k, _, _ in keywords for i in rng.sample(range(8), rng.randint(0, 6))]
    tiers = {}
    bridge = [(k, i, d, tiers.setdefault(i, t)) for k, i, d, t in bridge]
    dependent = {k: t in heads for _, k, t, _ in keywords}
    words = lambda t: [w for w in t.lower().split() if w not in ("voice", "mode", "agents", "plugin")]
    anchors = {k: len(words(t)) for _, k, t, _ in keywords}
    b = spark.createDataFrame(bridge, "keyword_id string, item_idx int, domain string, tier string").selectExpr("*", "timestamp_ntz'2024-01-01' as published_at")
    got = consolidation.enrich_context(spark.createDataFrame(keywords, "position int, keyword_id string, keyword string, aliases array<string>"), b).collect()
    assert {r.keyword: (list(r.aliases), r.matches) for r in got} == plain_enriched(keywords, bridge, dependent, anchors)


def test_history_is_as_long_as_the_parts(spark, monkeypatch):
    from trendspan.operators import identity as idt
    from trendspan.plans import identity as plans

    seen = {}
    monkeypatch.setattr(idt, "canonical_ids", lambda today, history: seen.update(today=today, history=history))
    plans.canonical_ids(spark, "/root/testdata/sf0.001")
    assert 0 < seen["history"].count() <= 3 * seen["today"].count()
