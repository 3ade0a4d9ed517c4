from __future__ import annotations

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trendspan.llm import chat, curves, decontamination as dc, html_text as ht, passages as ps, toxicity as tox
from trendspan.llm.shared import Scratch

WORDS = ["w%d" % i for i in range(2000)]


# --- toxicity ---------------------------------------------------------------------------------------------------------


def corpus(rng, n):
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS[:400]) for _ in range(rng.randint(5, 120))]
        bad = rng.random() < 0.3
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(["vile", "nastyish", "nastyest"]))
        rows.append((i, " ".join(words), int(len(words) > 30), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 900)
    docs = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], r[3]) for r in rows[:600]] + [(1, None, 1), (None, 1, 1), (99999, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.p_toxic for r in tox.classify(docs, tox.train(docs, labels)).collect()}
    right = [(got[r[0]] >= 0.5) == bool(r[3]) for r in rows[600:]]
    assert sum(right) >= 0.97 * len(right)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "some words", "z"), (2, "", "y")], "doc_id long, text string, p_toxic string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.p_toxic for r in tox.classify(docs, tox.train(docs, none)).collect()] == [0.0] * 4
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0 < r.p_toxic < 0.5 < r.p_quality for r in tox.classify(docs, tox.train(docs, one)).collect())
    assert tox.classify(docs.where("false"), []).collect() == []


def test_later_models_use_earlier_probabilities_out_of_fold():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, 8)).astype(np.int32) for _ in range(400)]
    first = np.array([float(3 in s) for s in sets])
    y = np.column_stack([first, first])
    chain = tox.fit_chain(sets, y, np.arange(400) % tox.FOLDS)
    assert len(chain) == 2 and len(chain[1].earlier) == 1 and chain[1].earlier[0] > 0


# --- decontamination --------------------------------------------------------------------------------------------------


def slow_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        s = dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH
        h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + dc.GAP, h[i, j - 1] + dc.GAP)
    return h.max()


def test_alignment_matches_the_table():
    rng = np.random.default_rng(3)
    q = [rng.integers(0, 5, rng.integers(1, 12)) for _ in range(60)]
    t = [rng.integers(0, 5, rng.integers(1, 25)) for _ in range(60)]
    assert dc.align(q, t).tolist() == [slow_align(a, b) for a, b in zip(q, t, strict=True)]


def test_copies_are_found_and_others_are_not(spark):
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(12, 50)))) for i in range(30)]
    docs, leaks = [], set()
    for i in range(300):
        body = [rng.choice(WORDS) for _ in range(rng.randint(20, 200))]
        if i % 3 == 0:  # one item in a third of all documents, others now and then
            k = 0 if i % 2 else rng.randrange(30)
            copy = items[k][1].split()
            for _ in range(len(copy) // 10):
                e = rng.randrange(len(copy))
                copy[e : e + 1] = rng.choice([[], ["edit"], ["an", "edit"]])
            at = rng.randrange(len(body))
            body[at:at] = copy
            leaks.add((i, k))
        docs.append((i, " ".join(body), "clash"))
    extra = [(None, items[3][1], ""), (998, None, ""), (999, "", ""), (1000, items[5][1].upper(), ""), (1000, items[5][1], "")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, items[9][1])], "item_id long, text string")
    for limit in (dc.BLOCK_BYTES, 600):  # in one block, and in many
        got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bench, block_bytes=limit).collect()}
        twin = {(d, 79) for d, k in leaks if k == 9}
        assert got == leaks | twin | {(None, 3), (1000, 5)}
    assert dc.contaminated(df.where("false"), bench).collect() == []
    assert dc.contaminated(df, bench.where("false")).collect() == []


def test_edited_and_half_copies_match_all_pairs(spark):
    rng = random.Random(14)
    common = ["the", "of", "and", "in", "to"]
    word = lambda: rng.choice(common) if rng.random() < 0.3 else rng.choice(WORDS)
    items = [(i, " ".join(word() for _ in range(rng.choice([9, 16, 30, 57])))) for i in range(40)]
    docs = []
    for i in range(400):
        body = [word() for _ in range(rng.randint(0, 250))]
        copy = items[i % 40][1].split()
        if i % 4 == 3:  # half of the item
            at = rng.randint(0, len(copy) // 2)
            copy = copy[at : at + (len(copy) + 1) // 2]
        elif i % 4 == 2:  # every third word
            copy = [w if j % 3 else "edit" for j, w in enumerate(copy)]
        else:
            copy = [word() if rng.random() < (0.2, 0.3)[i % 2] else w for w in copy]
        at = rng.randint(0, len(body))
        body[at:at] = copy
        docs.append((i, " ".join(body)))
    docs += [(400 + i, t) for i, t in items] * 3  # verbatim copies elsewhere
    numbers = {w: n for n, w in enumerate(sorted({w for _, t in docs + items for w in t.split()}))}
    as_array = lambda t: np.array([numbers[w] for w in t.split()])
    pairs = [(d, k) for d in docs for k in items]
    want = {}
    for at in range(0, len(pairs), 256):
        some = pairs[at : at + 256]
        scores = dc.align([as_array(k[1]) for _, k in some], [as_array(d[1]) for d, _ in some])
        want |= {(d[0], k[0]): s / 2 / len(k[1].split()) for (d, k), s in zip(some, scores.tolist(), strict=True) if s >= len(k[1].split())}
    assert sum(0.5 <= s < 0.75 for s in want.values()) > 150
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(df, bench).collect()}
    assert got == pytest.approx(want)


# --- passages ---------------------------------------------------------------------------------------------------------


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def test_embedded_passages_are_found(spark):
    rng = random.Random(5)
    passages = [" ".join(sentence(rng, rng.randint(8, 20)) for _ in range(5)) for _ in range(4)]
    rows, holds = [], {}
    for i in range(80):
        parts = [sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(2, 9))]
        if i % 2 == 0:
            k = rng.randrange(4)
            p = passages[k].split(" ")
            if i % 4 == 0:
                p[rng.randrange(len(p) - 1)] = "edited"
            parts.insert(rng.randint(0, len(parts)), " ".join(p))
            holds[i] = k
        rows.append((i, rng.choice([" ", "\n"]).join(parts), "x"))
    rows += [(500, None, ""), (501, "", ""), (502, "Short one. " * 3, ""), (503, "Short one. " * 3, ""), (None, passages[0], "")]
    got = ps.repeated_passages(spark, spark.createDataFrame(rows, "doc_id long, text string, keys string")).collect()
    found = {r.doc_id for r in got}
    assert found == set(holds) | {None}
    removed = {r.doc_id for r in got if r.removed}
    assert {min(d for d, k in holds.items() if k == j) for j in range(4)} & removed <= found
    text = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None:  # what is marked lies in the passage
            span = text[r.doc_id][r.first_char : r.last_char]
            shared = set(span.replace(".", "").split()) & set(passages[holds[r.doc_id]].replace(".", "").split())
            assert len(shared) >= 8


def test_banding_recall_and_exact_check():
    rng = np.random.default_rng(6)
    hit = pairs = 0
    for _ in range(300):
        a = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        b = a.copy()
        b[:4] = rng.integers(0, 1 << 62, 4).astype(np.uint64)  # similarity 36 / 44
        k = np.hstack([ps.band_keys(np.concatenate([a, b]), np.array([0, 40])), ps.band_keys(np.concatenate([a, b]), np.array([0, 40]), ps.FINE_BANDS, ps.FINE_ROWS, ps.BANDS * ps.ROWS)])
        same = k[0] == k[1]
        hit += bool(same[: ps.BANDS].any() and same[ps.BANDS :].any())
        pairs += 1
    assert hit / pairs >= 0.95


def test_passages_of_an_empty_table(spark):
    assert ps.repeated_passages(spark, spark.createDataFrame([], "doc_id long, text string")).collect() == []


# --- chat -------------------------------------------------------------------------------------------------------------

MARKS = ["<|turn|>x\n", "<|end|>\n", "</s>[INST] ok [/INST]", "\\", "\\\\n", "<\\|turn|>", "<<SYS>>a<</SYS>>", "<|im_end|>", "[\\INST]", "plain\ntext", "", None, "é😀", "<s", "a\\nb"]


def test_reply_trees_match_a_walk(spark):
    rng = random.Random(7)
    rows, want = [], []
    for tree in (1, 2, 3):
        n = rng.randint(20, 60)
        parent = {0: None, **{i: rng.choice([i - 1, rng.randrange(i)]) for i in range(1, n)}}
        score = {i: float(rng.randint(0, 3)) for i in range(n)}
        rows += [(tree, i, parent[i], "user" if i % 2 else "assistant", f"t{tree}-{i}", score[i], "extra") for i in range(n)]
        paths = []
        for leaf in set(range(n)) - set(parent.values()):
            path, x = [], leaf
            while x is not None:
                path.append(x)
                x = parent[x]
            paths.append((-sum(score[x] for x in path), leaf, path[::-1]))
        for b, (_, _, path) in enumerate(sorted(paths), 1):
            want += [(tree, b, k, f"t{tree}-{x}") for k, x in enumerate(path)]
    rows += [(9, 1, 2, "user", "ring", 0.0, ""), (9, 2, 1, "user", "ring", 0.0, ""), (10, 5, 99, "user", "orphan", 0.0, "")]
    want.append((10, 1, 0, "orphan"))
    df = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double, leaf string")
    got = sorted((r.tree, r.branch, r.turn, r.text) for r in chat.branches(Scratch(spark, "t"), df).collect())
    assert got == sorted(want)
    best = chat.branches(Scratch(spark, "t"), df, best=1).select("tree", "branch").distinct().count()
    assert best == len({r[0] for r in want})


def test_formats_reversibly(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(["user", "assistant", None, "odd\nrole\\n<|end|>"], MARKS))]
    rows += [(None, None, "assistant", "of no conversation"), (2, 0, "user", "same"), (2, 0, "user", "same")]
    scratch = Scratch(spark, "t")
    messages = scratch.write(chat.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "m")
    pieces = chat.format_conversations(scratch, messages)
    for p in pieces.collect():
        inner = p.piece[len(chat.TURN) : -len(chat.END) - 1]
        assert not any(m in inner for m in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))
    got = {r.conv_id: r for r in chat.digests(chat.read_turns(pieces)).collect()}
    assert set(got) == {1, 2, None}
    for conv in got:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        assert (got[conv].n_turns, got[conv].turns_sha256) == (len(own), hashlib.sha256(turns.encode()).hexdigest())
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_and_empty_conversations(spark):
    scratch = Scratch(spark, "t")
    rows = [(1, i, "user", "t%d" % i) for i in range(300)]
    m = scratch.write(chat.linear_tree(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "m")
    assert [r.text for r in chat.branches(scratch, m).orderBy("turn").collect()] == ["t%d" % i for i in range(300)]
    assert chat.digests(chat.read_turns(chat.format_conversations(scratch, m.where("false")))).collect() == []


# --- html -------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><a>Home</a></nav>
<div class="cookie-notice">We use cookies to make this better</div><div id="main"><h1>Title &eacute;&amp</h1><p>A long paragraph
 with many words in it.</p><aside>Related things</aside><p>Second, with <b>bold</b>text.<script>var x = "<p>no</p>";</script></p>
<form><label>Email</label><input></form><div class="ad">Buy now</div><p>Third<br>line of the text here</p></div>
<div id="comments"><p>First! I really like this article so much.</p></div><footer><p>Copyright 2024</p></footer></body></html>"""


def test_main_text():
    want = "Title é&\nA long paragraph with many words in it.\nSecond, with boldtext.\nThird line of the text here"
    assert ht.main_text(PAGE, {}) == want
    cases = {None: "", "": "", "<": "<", "<p": "", "plain words": "plain words", "<article><h1>T": "T", "<p>a &lt;b&gt; &#233;&nbsp;c</p>": "a <b> é c", "<!-- x --><p>y": "y", "<script>z": "", "<nav>only a menu</nav>": ""}
    for page, text in cases.items():
        assert ht.main_text(page, {}) == text


WRAPPERS = ["content no-sidebar", "post has-comments", "with-banner", "layout sidebar-right", "shareReport", "newsletter"]


@pytest.mark.parametrize("wrapper", [f'<div class="{w}">' for w in WRAPPERS] + ['<div id="share-price-report">', '<section class="with-banner">', '<div class=x><table><tr><td>'])
def test_no_article_is_lost_to_a_name(wrapper):
    lines = [" ".join("word%d" % (20 * k + i) for i in range(20)) for k in range(4)]
    page = "<body><ul class=menu><li>Home<li>About</ul>" + wrapper + "".join(f"<p>{x}</p>" for x in lines)
    page += '<div class="related-articles"><p>other things</div><div class="ad-slot">Buy</div><div class="post-comments"><p>I like it</div><div class=sidebarRight>more</div></div>'
    assert ht.main_text(page, {}) == "\n".join(lines)


def test_names_that_labelled_pages_know(spark):
    body = "<p>" + "some words of the text " * 10 + "</p>"
    page = f'<div class="strip">{"nothing to read here " * 8}</div><article class="nav-story">{body}</article>'
    df = spark.createDataFrame([(i, "u", page) for i in range(20)], "page_id long, url string, html string")
    weights = ht.learn_weights(df)
    assert weights[".strip"] < ht.NAME_ODDS
    plain = f'<body><div class="strip">{"nothing to read here " * 8}</div><div class=y>{body}</div>'
    assert ht.main_text(plain, weights) == " ".join(("some words of the text " * 10).split())
    # Comments that outnumber the article's words stay out.
    talk = f'<div class=y>{body}</div><div class="comments-area">{"<p>I think so as well</p>" * 40}</div>'
    assert ht.main_text(talk, {}) == " ".join(("some words of the text " * 10).split())


def test_inline_pictures_and_choices_end_where_they_end():
    assert ht.main_text("<p>one <svg viewBox='0'/>two <svg><title>x</title><path d=''/></svg>three <noscript>no</noscript>four</p><p><select><option>a<option>b</select>five and some more</p>", {}) == "one two three four\nfive and some more"


def test_long_and_broken_pages_take_linear_time():
    import time

    pages = ["<div>word " * 100_000, "<b>x" * 60_000 + "</i>y" * 60_000, "<p>" * 300_000, "<a '" * 250_000, "<b \">" * 200_001, "<!--" * 250_000, "&" * 1_000_000]
    for page in pages:
        start = time.process_time()
        ht.main_text(page, {})
        assert time.process_time() - start < 6  # quadratic time would take minutes
    assert ht.main_text(pages[0], {}).count("word") == 100_000


def slow_region(scores):
    best = (0.0, 0, 0)
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            if sum(scores[i:j]) > best[0] + 1e-9:
                best = (sum(scores[i:j]), i, j)
    return best


def test_whole_pages_by_the_best_region_of_all():
    rng = random.Random(12)
    weights = {"p": 0.9, "li": -0.4, "div": 0.2, "<p": -0.3, "<li": -0.3, "<div": -0.3}
    for _ in range(60):
        page = "".join(rng.choice([f"<p>{'w ' * rng.randint(0, 4)}</p>", f"<li>{'v ' * rng.randint(0, 4)}", "<nav>x y</nav>", "<div>u</div>", "<hr>"]) for _ in range(rng.randint(0, 12)))
        found = ht.page_tokens(page, weights)
        scores = [ht.weight(kind, weights, t is None, bad) * (1 if t is None else n) for t, kind, n, bad, *_ in found]
        total, i, j = slow_region(scores)
        want = " ".join(t.strip() for t, _, n, bad, *_ in found[i:j] if n and not bad)
        a, b = ht.best_region(scores)
        assert abs(sum(scores[a:b]) - total) < 1e-6
        if (a, b) == (i, j):
            assert ht.main_text(page, weights).split() == want.split()


def test_best_region_matches_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        s = [rng.uniform(-2, 2) for _ in range(rng.randint(0, 12))]
        a, b = ht.best_region(s)
        best = max([0.0] + [sum(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)])
        assert abs(sum(s[a:b]) - best) < 1e-9


def test_pages_as_their_articles(spark):
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in ht.extract(pages, ht.learn_weights(pages)).collect():
        inner = re.search(r"(?s)<article>(.*)</article>", raw[r.page_id])[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_edges(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "y"), (None, "u", "<p>a b", "z"), (None, "u", "<p>a b", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = ht.extract(df, ht.learn_weights(df))
    assert sorted((r.text, r.n_chars) for r in got.collect()) == [("", 0), ("", 0), ("a b", 3), ("a b", 3)]
    assert ht.extract(df.where("false"), {}).collect() == []


# --- nearest neighbours -----------------------------------------------------------------------------------------------


def brute(vectors, queries, k):
    ok = {i: np.array(v, dtype=float) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in queries:
        if q in ok:
            s = [(-float(ok[q] @ v / np.linalg.norm(ok[q]) / np.linalg.norm(v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])]
            out[q] = [i for _, i in sorted((round(a, 12), i) for a, i in s)[:k]]
    return out


def test_recall_and_edges(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(1500)]
    rows += [(2000 + i, [1.0] * 32) for i in range(300)]  # a hot vector
    rows += [(3000, None), (3050, [0.0] * 32), (3100, [None] * 32), (3150, [float("nan")] * 32), (3200, [float("inf")] * 32), (3250, []), (3300, [1.0, 2.0]), (3301, [2.0, 1.0]), (None, [1.0] * 32)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, v array<double>, rank string").select("id", "v", "rank")
    got: dict = {}
    for r in curves.nearest(spark, df.select("id", "v"), F.col("id") % 50 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    want = brute(rows, [r[0] for r in rows if r[0] is not None and r[0] % 50 == 0], 5)
    assert set(got) == set(want)
    assert got[3300][1][0] == 3301 and len(got[3300]) == 1
    assert [got[2000][k][0] for k in range(1, 6)] == [2001, 2002, 2003, 2004, 2005]
    found = sum(len({x[0] for x in got[q].values()} & set(want[q])) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def test_narrow_windows_on_many_vectors(spark):
    """20,000 vectors with planted neighbours: each window holds a fiftieth of all, so the curves decide."""
    rng = np.random.default_rng(10)
    base = rng.standard_normal((20_000, 24))
    for q in range(0, 20_000, 50):  # five rows near each query, spread over all ids
        for j in range(1, 6):
            base[(q + 3 + 3571 * j) % 20_000 // 50 * 50 + 7 * j] = base[q] + 0.35 * rng.standard_normal(24)
    df = spark.createDataFrame(((i, v.tolist()) for i, v in enumerate(base)), "id long, v array<double>")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    q = np.arange(0, 20_000, 50)
    s = unit[q] @ unit.T
    s[np.arange(len(q)), q] = -2
    want = np.argsort(-s, axis=1)[:, :5]
    got: dict = {}
    for r in curves.nearest(spark, df, F.col("id") % 50 == 0, curves=12, window_share=0.02).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
        assert abs(r.score - s[r.query_id // 50, r.vec_id]) < 1e-9
    recall = np.mean([len(got[i] & set(w.tolist())) / 5 for i, w in zip(q.tolist(), want, strict=True)])
    assert recall >= 0.9


def test_recall_on_the_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    vectors = [(r.vec_id, r.embedding) for r in rows]
    want = brute(vectors, [i for i, _ in vectors if i % 50 == 0], 5)
    got: dict = {}
    for r in curves.op9_curves(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)


def test_hilbert_curve_is_one():
    g = np.array(list(itertools.product(range(8), repeat=3)))
    h = curves.hilbert(g, 3)
    assert (np.sort(h) == np.arange(512)).all()
    assert (np.abs(np.diff(g[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "id long, v array<double>")
    assert curves.nearest(spark, df, F.col("id") % 50 == 0).collect() == []


# --- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages_keep_their_columns_and_shrink(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    scratch, n = Scratch(spark, "t"), docs.count()
    for k, (_, stage) in enumerate(cp.STAGES):
        out = scratch.write(stage(spark, docs, "/root/testdata/sf0.001"), f"s{k}")
        if k + 1 < len(cp.STAGES):
            assert out.columns == docs.columns
        assert 0 < out.count() <= n
        n, docs = out.count(), out


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)], [(1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (None, "x y z", "en", "s", 5)]])
def test_pipeline_stages_take_anything(spark, rows):
    import corpus_pipeline as cp

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        stage(spark, docs, "/root/testdata/sf0.001").collect()
