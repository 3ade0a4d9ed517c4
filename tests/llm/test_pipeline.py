"""The pipeline and the classifier chain against plain versions of each stage."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_line_dedup import slow as slow_lines
from trendspan.llm import decontamination as dc
from trendspan.llm import toxicity as tox

WORDS = ["w%d" % i for i in range(1500)]
VILE = ["vile", "nastyish", "nastyest"]


def plain_scores(texts, labelled):
    """Probabilities of a chain fitted on ``labelled`` (id, text, labels), by features and models written out."""
    features = [np.array(sorted({f for w in re.findall(r"\w+", (t or "").lower()) for f in tox.word_features(w)}), dtype=np.int32) for _, t, _ in labelled]
    import zlib

    folds = np.array([zlib.crc32(b"%d" % i) % tox.FOLDS for i, *_ in labelled])
    chain = tox.fit_chain(features, np.array([y for *_, y in labelled], dtype=float), folds)
    out = []
    for t in texts:
        have = {f for w in re.findall(r"\w+", (t or "").lower()) for f in tox.word_features(w)}
        earlier, row = [], []
        for m in chain:
            z = m.bias + sum(w for f, w in zip(m.features.tolist(), m.weights.tolist(), strict=True) if f in have) + sum(a * b for a, b in zip(m.earlier.tolist(), earlier, strict=True))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            q = min(max(p, 1e-4), 1 - 1e-4)
            earlier.append(np.log(q / (1 - q)))
            row.append(p)
        out.append(row)
    return np.array(out)


def corpus(rng, n):
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 90))]
        bad = rng.random() < 0.25
        if bad:
            words.insert(rng.randrange(len(words)), rng.choice(VILE))
        lines = [" ".join(words[a : a + 12]) for a in range(0, len(words), 12)]
        docs.append([i, "\n".join(lines)])
        labels.append((i, int(len(words) > 50), int(bad)))
    return docs, labels


def test_chain_matches_a_plain_one(spark):
    docs, labels = corpus(random.Random(21), 300)
    docs += [[900, None], [901, ""], [902, "nothing " * 30_000 + "vile"], [None, "vile words"]]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    chain = tox.train(df, spark.createDataFrame(labels[:200] + [(5, None, 1)], "doc_id long, quality int, toxic int"))
    got = [(r.p_quality, r.p_toxic) for r in tox.classify(df, chain).collect()]
    want = plain_scores([t for _, t in docs], [(i, docs[i][1], (q, t)) for i, q, t in labels[:200]])
    assert np.allclose(np.array(got), want, atol=1e-9)


def test_documents_that_share_an_id_are_one_of_the_sample(spark):
    docs, labels = corpus(random.Random(22), 60)
    df = spark.createDataFrame(docs + [[0, f"copy {k}"] for k in range(500)], "doc_id long, text string")
    sets, y, folds = tox.labelled_features(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), tox.CATEGORIES, 40, "doc_id", "text")
    assert len(sets) == len(y) == len(folds) == 40


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_pipeline(docs, labels, items):
    by_id = dict(docs)
    p = plain_scores([t for _, t in docs], [(i, by_id[i], (q, t)) for i, q, t in labels])
    docs = [d for d, row in zip(docs, p, strict=True) if row[1] < tox.THRESHOLD]
    docs = [(i, t) for i, t, _ in slow_lines([(i, t, "") for i, t in docs])]
    of = {i: i for i, _ in docs}
    sets = {i: shingles(t or "") for i, t in docs}
    links = [(a, b) for a, b in itertools.combinations(sorted(of), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in of:
        for a, b in links:
            of[a] = of[b] = min(of[a], of[b])
    docs = [(i, t) for i, t in docs if of[i] == i]
    kept = []
    numbers: dict = {}
    as_array = lambda t: np.array([numbers.setdefault(w, len(numbers)) for w in dc.words(t)], dtype=np.int64)
    for i, t in docs:
        words = as_array(t)
        leak = False
        for _, item in items:
            if len(words) and dc.words(item):
                score = dc.align([as_array(item)], [words])[0] / (2 * len(dc.words(item)))
                leak |= score >= (dc.THRESHOLD if len(dc.words(item)) >= dc.SHORT_ITEM else 1.0)
        if not leak:
            kept.append((i, t))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, t in kept:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_pipeline_matches_a_plain_one(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(23)
    docs, labels = corpus(rng, 120)
    items = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([5, 12, 25])))) for i in range(6)]
    block = "\n".join(" ".join(rng.choice(WORDS) for _ in range(6)) for _ in range(5))
    for k in range(0, 120, 9):  # a run of lines that repeats
        docs[k][1] += "\n" + block
    for k in range(4, 120, 17):  # a benchmark item, edited
        words = items[k % 6][1].split()
        words[len(words) // 2] = "edit" if len(words) > 8 else words[len(words) // 2]
        docs[k][1] += "\nand " + " ".join(words) + " so"
    for k in range(20):  # near and exact copies
        words = docs[k][1].split(" ")
        for _ in range(k % 3):
            words[rng.randrange(len(words))] = "changed"
        docs.append([200 + k, " ".join(words)])
    docs += [[300, ""], [301, None], [302, " "], [303, "long text here " * 20_000]]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "src", len(t or ""), "clash") for i, t in docs], "doc_id long, text string, source string, n_chars long, component_id string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in cp.run(spark, sf).collect())
    want = plain_pipeline([tuple(d) for d in docs], labels, items)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert got == want
    assert 60 < len(got) < 120


LONG = {c: " ".join(f"{c}{k}" for k in range(40)) for c in "abcd"}


def staged(spark, stage, rows, sf_dir=""):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = stage(spark, df, sf_dir)
    assert out.columns == df.columns
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)


def test_near_duplicates_go_row_by_row(spark):
    import corpus_pipeline as cp

    a, b, c = LONG["a"], LONG["b"], LONG["c"]
    drop = lambda *rows: staged(spark, cp.drop_near_duplicates, [(*r, "s") for r in rows])
    assert drop((1, a), (2, a), (2, b)) == [(1, a, "s"), (2, b, "s")]
    assert drop((1, a), (1, b), (2, c)) == [(1, a, "s"), (1, b, "s"), (2, c, "s")]
    assert drop((1, a), (None, a)) == [(1, a, "s")]
    assert drop((1, a), (None, a), (None, b)) == [(1, a, "s"), (None, b, "s")]
    assert drop((None, a), (None, a), (3, b), (3, b), (None, None), (None, "")) in ([(3, b, "s"), (None, a, "s"), (None, None, "s")], [(3, b, "s"), (None, "", "s"), (None, a, "s")])
    near = a.replace("a39", "x")
    assert drop((5, near), (5, a), (4, None), (6, c)) in ([(4, None, "s"), (5, a, "s"), (6, c, "s")], [(4, None, "s"), (5, near, "s"), (6, c, "s")])


def test_benchmark_copies_go_row_by_row(spark, tmp_path):
    import corpus_pipeline as cp

    spark.createDataFrame([(1, LONG["a"])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "x " + LONG["a"], "s"), (7, LONG["a"], "s"), (7, LONG["b"], "s"), (None, LONG["c"], "s"), (8, None, "s"), (8, "", "t")]
    assert staged(spark, cp.drop_benchmark_copies, rows, str(tmp_path)) == sorted([rows[2], rows[3], rows[4], rows[5]], key=str)
