"""Passages and links of sets against all pairs."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

from trendspan.llm import passages as ps
from trendspan.llm.links import set_components
from trendspan.llm.shared import Scratch

WORDS = ["w%d" % i for i in range(3000)]


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


def alike(x, y):
    return len(x & y) >= 0.8 * len(x | y)


def test_sets_are_linked_as_by_all_pairs(spark):
    """One bucket holds everything, so the components are those of all pairs, however few are linked to the first."""
    rng = random.Random(3)
    sets = []
    for _ in range(12):
        base = rng.sample(range(10**6), rng.choice([4, 9, 11, 20, 45]))
        for _ in range(25):
            edited = set(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                if rng.random() < 0.5 and len(edited) > 2:
                    edited.discard(rng.choice(sorted(edited)))
                else:
                    edited.add(rng.choice([rng.randrange(10**6), 77, 78]))
            sets.append(frozenset(edited))
    sets = list(dict.fromkeys(sets))
    linked = [(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if alike(sets[a], sets[b])]
    want = slow_components({n for l in linked for n in l}, linked)
    assert len(set(want.values())) >= 12
    df = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "id long, shingles array<long>")
    members = spark.createDataFrame([(0, i) for i in range(len(sets))] * 2, "bucket long, id long")
    got = set_components(Scratch(spark, "t"), members, ["bucket"], df, 0.8)
    assert {r.node: r.component for r in got.collect()} == want


def slow_passages(rows):
    """``(doc_id, paragraph, first, last, removed)`` and the classes' members, by all pairs of paragraphs."""
    pieces = []
    for r, (d, t, *_) in enumerate(rows):
        for n, (a, b, words) in enumerate(ps.paragraphs(t or "")):
            pieces.append((r, n, a, b, tuple(words)))
    sets = {w: frozenset(w[i : i + 5] for i in range(max(1, len(w) - 4))) for *_, w in pieces}
    keys = sorted(sets)
    linked = [(a, b) for a, b in itertools.combinations(keys, 2) if alike(sets[a], sets[b])]
    of = slow_components(keys, linked)
    size = Counter(of[p[4]] for p in pieces)
    by_row = defaultdict(list)
    for p in pieces:
        if size[of[p[4]]] > 1:
            by_row[p[0]].append(p)
    out = []
    for r, some in by_row.items():
        stretches = [[some[0]]]
        for p in some[1:]:
            if p[1] - stretches[-1][-1][1] > 2:
                stretches.append([])
            stretches[-1].append(p)
        out += [p for s in stretches if sum(len(p[4]) for p in s) >= ps.MIN_SPAN for p in s]
    return [(rows[r][0], n, a, b) for r, n, a, b, _ in out], [(of[w], rows[r][0], n) for r, n, _, _, w in out], size


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def test_passages_match_all_pairs(spark):
    rng = random.Random(8)
    long = [sentence(rng, rng.randint(30, 70)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 6))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(long).split(" ")
            for _ in range(rng.choice([0, 0, 1, 2])):
                p[rng.randrange(len(p) - 1)] = rng.choice(WORDS)
            parts.insert(rng.randint(0, len(parts)), " ".join(p))
        rows.append((rng.choice([i, i, i, None, 7]), rng.choice([" ", "\n"]).join(parts), "clash"))
    short = sentence(rng, 13)  # alone too short for a passage
    rows += [(1, short, ""), (2, short, ""), (None, short, ""), (None, short, ""), (7, short, ""), (7, short, "")]
    rows += [rows[3]] * 3 + [(None, None, ""), (900, "", "")]
    got = ps.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, keys string")).collect()
    want, members, size = slow_passages(rows)
    assert Counter((r.doc_id, r.paragraph, r.first_char, r.last_char) for r in got) == Counter(want)
    # The classes group the same paragraphs, whatever their names; and of each all stay out of the removal but one at most.
    as_sets = lambda triples: Counter(frozenset(Counter(x[1:] for x in g).items()) for _, g in itertools.groupby(sorted(triples, key=lambda x: x[0]), key=lambda x: x[0]))
    assert as_sets((str(r.class_id), r.doc_id, r.paragraph) for r in got) == as_sets((str(c), d, n) for c, d, n in members)
    stays = Counter(r.class_id for r in got if not r.removed)
    assert max(stays.values()) == 1 and sum(r.removed for r in got) > 50


def test_short_repeats_of_rows_without_ids_are_no_passage(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen."
    for ids in ([1, 2, 3], [None] * 3, [4] * 3):
        assert ps.repeated_passages(spark, spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")).collect() == []


def test_exact_copies_with_one_id_keep_one(spark):
    rng = random.Random(4)
    text = " ".join(sentence(rng, 12) for _ in range(5))
    n = len(list(ps.paragraphs(text)))
    for ids in ([1, 2, 3], [None] * 3, [4] * 3):
        got = ps.repeated_passages(spark, spark.createDataFrame([(i, text) for i in ids], "doc_id long, text string")).collect()
        assert len(got) == 3 * n and sum(not r.removed for r in got) == n


def test_passages_without_sentences_are_found(spark):
    """Passages in running words, between other words of the same line: no stop tells where they begin."""
    rng = random.Random(9)
    passages = [" ".join(rng.choice(WORDS) for _ in range(60)) for _ in range(12)]
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(i, f"{words(rng.randint(0, 40))} {passages[i % 12]} {words(rng.randint(0, 40))}") for i in range(48)] + [(100 + i, words(150)) for i in range(48)]
    got = {r.doc_id for r in ps.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got & set(range(48))) >= 45 and not got & set(range(100, 148))


def test_cuts_go_with_the_content():
    rng = random.Random(10)
    passage = " ".join(rng.choice(WORDS) for _ in range(80))
    held = []
    for _ in range(20):
        text = f"{' '.join(rng.choice(WORDS) for _ in range(rng.randint(5, 30)))} {passage} end."
        held.append({tuple(w) for a, b, w in ps.paragraphs(text)})
        for a, b, w in ps.paragraphs(text):
            assert ps._WORD.findall(text[a:b].lower()) == w
    shared = set.intersection(*held)
    assert sum(map(len, shared)) >= 40


def test_a_very_long_text(spark):
    rng = random.Random(5)
    passage = " ".join(sentence(rng, 12) for _ in range(5))
    long = " ".join(sentence(rng, 12) for _ in range(20_000))
    rows = [(1, long + " " + passage), (2, passage), (3, "w1 " * 400_000), (4, "no repeat in here at all, just a few words.")]
    got = ps.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.removed} == {2} and {r.doc_id for r in got} == {1, 2}
