from __future__ import annotations

import itertools
import random

import xxhash

from trendspan.llm import simhash
from trendspan.llm.links import connected_components
from trendspan.llm.shared import Scratch


def slow_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    of = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(of[a], of[b])
            if of[a] != low or of[b] != low:
                of[a] = of[b] = low
                changed = True
    return of


def test_covering_masks_cover_every_pair_within_the_radius():
    rng = random.Random(1)
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(4)]
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(diff & m == 0 for m in masks)


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    rows = connected_components(Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in rows} == slow_components({x for l in links for x in l}, links)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(300)]
    texts = []
    for _ in range(25):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(30, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 8)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "X" + rng.choice(vocabulary)
            texts.append("\t".join(copy))
    texts += [None, "", " \n ", "A", "a", "one two", "é É"] + [texts[0]] * 5
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "alone with null", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(spark, df).collect()
    assert len(got) == len(rows)
    prints = {i: slow_print(t) for i, t, _ in rows}
    links = [(a, b) for a, b in itertools.combinations([i for i in prints if i is not None], 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = slow_components([i for i in prints if i is not None], links)
    for r in got:
        assert r.fp & (2**64 - 1) == prints[r.doc_id]
        assert r.component_id == want.get(r.doc_id)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_buckets_lose_no_link_between_components(spark):
    """Links that the smallest member has no part in are found, in buckets of any shape."""
    from pyspark.sql import functions as F

    from trendspan.llm.links import bucket_components

    rng = random.Random(9)
    for density in (0.02, 0.1, 0.4):
        members = {(rng.randrange(6), rng.randrange(80)) for _ in range(160)} | {(99, i) for i in range(40)}
        linked = {(a, b) for a, b in itertools.combinations(range(80), 2) if rng.random() < density}
        want = [(a, b) for a, b in linked if any((k, a) in members and (k, b) in members for k in {m[0] for m in members})]
        table = spark.createDataFrame(sorted(linked) or [(0, 0)], "a long, b long")
        df = spark.createDataFrame(sorted(members) * 2, "bucket long, id long")
        found = bucket_components(Scratch(spark, "t"), df, ["bucket"], lambda pairs: pairs.join(F.broadcast(table), ["a", "b"], "left_semi"))
        assert {r.node: r.component for r in found.collect()} == slow_components({x for p in want for x in p}, want)


def test_near_duplicate_stage_goes_by_the_similarity_of_five_words(spark):
    import corpus_pipeline as cp

    rng = random.Random(5)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(max(1, len(w) - 4))}
    docs, copies, others = [], set(), set()
    for k in range(60):
        words = ["w%d" % rng.randrange(5000) for _ in range(rng.randint(200, 400))]
        docs.append((10 * k, " ".join(words)))
        for j, share in enumerate((0.01, 0.02, 0.06), 1):  # of words changed
            copy = list(words)
            for at in rng.sample(range(len(copy)), int(share * len(copy))):
                copy[at] = "x%d" % rng.randrange(5000)
            docs.append((10 * k + j, " ".join(copy)))
            a, b = shingles(docs[-1 - j][1]), shingles(docs[-1][1])
            (copies if len(a & b) / len(a | b) >= 0.8 else others).add(10 * k + j)
    assert len(copies) > 100 and len(others) > 50
    df = spark.createDataFrame([*docs, (None, docs[0][1]), (9000, ""), (9001, " ")], "doc_id long, text string")
    kept = {r.doc_id for r in cp.drop_near_duplicates(spark, df, "").collect()}
    assert len(kept & copies) <= 0.02 * len(copies)
    assert others <= kept and 9000 in kept and 9001 not in kept and None not in kept
    assert cp.drop_near_duplicates(spark, df.where("false"), "").collect() == []


def test_near_duplicate_stage_has_near_fingerprints_as_candidates(spark):
    from trendspan.llm import near_copies as nc
    from trendspan.llm.simhash import RADIUS, fingerprint

    rng = random.Random(9)
    docs = []
    for k in range(40):
        words = ["w%d" % rng.randrange(4000) for _ in range(300)]
        docs.append((3 * k, " ".join(words)))
        for j in (1, 2):
            words[rng.randrange(300)] = "x"
            docs.append((3 * k + j, " ".join(words)))
    keys = {r.doc_id: r["keys"] for r in nc.signatures(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = {i: fingerprint(t) for i, t in docs}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if bin((prints[a] ^ prints[b]) & (1 << 64) - 1).count("1") <= RADIUS]
    assert len(near) > 40
    tables = len(nc.MASKS)
    assert all(any(x == y for x, y in zip(keys[a][:tables], keys[b][:tables], strict=True)) for a, b in near)
    assert all(len(k) == tables + nc.FINE_BANDS for k in keys.values())


def test_no_exploded_side_is_broadcast(spark, monkeypatch):
    """Spark sizes the members of op7's 31 tables as if each fingerprint had one, so it broadcast all of them."""
    from trendspan.llm import near_copies, passages

    plans = {}
    write = Scratch.write
    monkeypatch.setattr(Scratch, "write", lambda self, df, name: plans.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString()) or write(self, df, name))
    words = " ".join("w%d" % i for i in range(60))
    df = spark.createDataFrame([(i, f"{words} w{60 + i % 3}") for i in range(12)], "doc_id long, text string")
    for query in (simhash.near_duplicates, near_copies.near_copies, passages.repeated_passages):
        assert query(spark, df).count()
    assert len(plans["members"]) >= 3 and len(plans["candidates"]) == 1
    for name in ("members", "candidates"):
        assert all("SortMergeJoin" in p and "BroadcastExchange" not in p for p in plans[name])
