"""Toxicity by a classifier chain of linear models.

The categories are predicted one after the other. Each model sees the text's features and the log-odds of every
category before it in the chain. While training, those come from models that did not see the row (out-of-fold
predictions), so that a later model learns how far an earlier one can be trusted on new text.

Features are whether a text holds a word, one of its beginnings of 3 to 5 letters or one of its endings of 3 or 4
letters, hashed; each model keeps those that tell its category best in its own training rows. The
models are fitted on a sample of at most ``SAMPLE`` labelled rows, the first by a hash of their id, so a larger
corpus doesn't make the fit larger; every document is then scored over its whole text.

Edge cases: a null or empty text has no features and gets the base rate; labels with a null are not used; a
document with several label rows is used with each; of documents with one id one text, the first by its hash, stands for
the id in training, and all are scored; ties in the order of the sample go by id; texts are read whole, whatever their
length; without labelled rows nothing is known and every probability
is zero; with one class only the probability is that class's smoothed rate; extra columns are kept, and columns
with the names of the outputs are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trendspan.llm.shared import table

CATEGORIES = ("quality", "toxic")
#: Most labelled rows that the models are fitted on.
SAMPLE = 8_000
FOLDS = 5
BITS = 20
#: Features that a model keeps.
KEPT = 2048
#: Rows of its training set that a feature has to be in.
LEAST_ROWS = 5
#: Chi-squared statistic, with one degree of freedom, that a feature needs: one in a thousand useless ones has it.
LEAST_GAIN = 10.83
PENALTY = 0.3
#: Words whose features a scorer keeps at hand.
KNOWN = 200_000
THRESHOLD = 0.5

_WORD = re.compile(r"\w+")


def word_features(word: str) -> set[int]:
    parts = ["=" + word]
    parts += ["<" + word[:n] for n in (3, 4, 5) if len(word) > n]
    parts += [">" + word[-n:] for n in (3, 4) if len(word) > n]
    return {zlib.crc32(p.encode()) & ((1 << BITS) - 1) for p in parts}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


@dataclass
class Linear:
    """A logistic model over chosen features and the log-odds of earlier categories."""

    features: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


class Rows:
    """Feature sets of texts as one sparse matrix."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), [len(s) for s in sets])
        self.column = np.concatenate(sets) if sets else np.empty(0, dtype=np.int32)

    def only(self, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[features] = np.arange(len(features), dtype=np.int32)
        at = place[self.column]
        return self.row[at >= 0], at[at >= 0]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: Rows, train: np.ndarray, label: np.ndarray, earlier: np.ndarray, steps: int = 80) -> Linear:
    """Fit on the rows where ``train`` is true; ``earlier`` has a column of log-odds for each earlier category."""
    y = label[train].astype(float)
    nothing = Linear(np.empty(0, dtype=np.int64), np.empty(0), np.zeros(earlier.shape[1]), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    if not 0 < y.sum() < len(y):
        return nothing
    used = train[rows.row]
    size = 1 << BITS
    both = np.bincount(rows.column[used], minlength=size).astype(float)
    ones = np.bincount(rows.column[used], weights=label[rows.row[used]], minlength=size)
    # The chi-squared statistic of feature against label.
    n, p = len(y), y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((both >= LEAST_ROWS) & (both < n), n * (ones - both * p) ** 2 / (both * (n - both) * p * (1 - p)), 0)
    features = np.sort(np.argsort(-gain, kind="stable")[: min(KEPT, int((gain >= LEAST_GAIN).sum()))])
    r, c = rows.only(features)
    index = np.cumsum(train) - 1
    keep = train[r]
    r, c = index[r[keep]], c[keep]
    e = earlier[train]
    w, v, b = np.zeros(len(features)), np.zeros(e.shape[1]), nothing.bias
    theta = np.concatenate([w, v, [b]])
    m, s = np.zeros_like(theta), np.zeros_like(theta)
    k = len(features)
    for t in range(1, steps + 1):  # Adam on the whole sample
        z = np.bincount(r, weights=theta[c], minlength=n) + e @ theta[k:-1] + theta[-1]
        g = _sigmoid(z) - y
        grad = np.concatenate([np.bincount(c, weights=g[r], minlength=k) + PENALTY * theta[:k], e.T @ g + PENALTY * theta[k:-1], [g.sum()]])
        m, s = 0.9 * m + 0.1 * grad, 0.99 * s + 0.01 * grad**2
        theta -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
    return Linear(features, theta[:k].copy(), theta[k:-1].copy(), float(theta[-1]))


def apply(model: Linear, rows: Rows, earlier: np.ndarray) -> np.ndarray:
    r, c = rows.only(model.features)
    return _sigmoid(np.bincount(r, weights=model.weights[c], minlength=rows.n) + earlier @ model.earlier + model.bias)


def fit_chain(sets: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """A model for each column of ``labels``; ``folds`` numbers each row's fold."""
    rows, everything = Rows(sets), np.ones(len(sets), dtype=bool)
    earlier = np.empty((len(sets), 0))
    chain = []
    for k in range(labels.shape[1]):
        chain.append(fit(rows, everything, labels[:, k], earlier))
        if k + 1 < labels.shape[1]:
            out = np.empty(len(sets))
            for f in range(FOLDS):
                held = folds == f
                if held.any():
                    # Without other rows there is nothing to learn from; the rate of all rows stands in.
                    model = fit(rows, ~held, labels[:, k], earlier) if (~held).any() else chain[-1]
                    out[held] = apply(model, rows, earlier)[held]
            earlier = np.column_stack([earlier, _logit(out)])
    return chain


class Scorer:
    """Scores texts by a chain; keeps the chosen features of words it has met."""

    def __init__(self, chain: list[Linear]):
        self.chain = chain
        every = np.unique(np.concatenate([m.features for m in chain])) if chain else np.empty(0, dtype=np.int64)
        self.place = {int(f): i for i, f in enumerate(every)}
        self.weights = np.zeros((len(every) + 1, len(chain)))
        for k, m in enumerate(chain):
            self.weights[np.searchsorted(every, m.features), k] = m.weights
        self.known: dict[str, tuple[int, ...]] = {}

    def _learn(self, words: set[str]) -> None:
        place = self.place
        if len(self.known) > KNOWN:
            self.known.clear()
        for w in words:
            self.known[w] = tuple(place[f] for f in word_features(w) if f in place)

    def score(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.chain)))
        for i, t in enumerate(texts):
            words = words_of(t)
            new = words.difference(self.known)
            if new:
                self._learn(new if len(self.known) <= KNOWN else words)
            found = list(set().union(*map(self.known.__getitem__, words)))
            z = self.weights[found].sum(axis=0)
            logits = np.empty(len(self.chain))
            for k, m in enumerate(self.chain):
                logits[k] = z[k] + m.bias + logits[:k] @ m.earlier
                # As in training: log-odds of a probability kept off 0 and 1.
                out[i, k] = _sigmoid(logits[k])
                logits[k] = _logit(out[i, k])
        return out


def labelled_features(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], sample: int, key: str, text: str) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The bounded sample's feature sets, labels and folds."""
    whole = labels.select(F.col(key).cast("long").alias("k"), *(F.col(c).cast("int").alias(c) for c in categories)).dropna()
    order = F.xxhash64("k")
    chosen = whole.orderBy(order, "k", *categories).limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[int]] = {}
        for batch in batches:
            found = []
            for t in batch.column(1):
                words = words_of(t.as_py())
                for w in words.difference(known):
                    known[w] = word_features(w)
                found.append(np.fromiter(set().union(*map(known.__getitem__, words)), dtype=np.int32).tobytes())
                if len(known) > 300_000:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.binary())], ["k", *categories, "features"])

    schema = "k long, " + "".join(f"{c} int, " for c in categories) + "features binary"
    # The sample has at most ``sample`` rows of a few numbers. Of documents that share an id one is used, so no more come back.
    named = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen.select("k").distinct()), "k", "left_semi")
    once = named.groupBy("k").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    joined = once.join(F.broadcast(chosen), "k").select("k", "text", *categories)
    rows = joined.mapInArrow(run, schema).toArrow().to_pandas().sort_values(["k", *categories], kind="stable")
    sets = [np.frombuffer(f, dtype=np.int32) for f in rows["features"]]
    folds = np.array([zlib.crc32(b"%d" % k) % FOLDS for k in rows["k"]], dtype=np.int64)
    return sets, rows[list(categories)].to_numpy().astype(float).reshape(-1, len(categories)), folds


def train(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = CATEGORIES, sample: int = SAMPLE, key: str = "doc_id", text: str = "text") -> list[Linear]:
    sets, y, folds = labelled_features(docs, labels, categories, sample, key, text)
    return fit_chain(sets, y, folds) if sets else []


def classify(docs: DataFrame, chain: list[Linear], categories: tuple[str, ...] = CATEGORIES, text: str = "text") -> DataFrame:
    """Add a probability ``p_<category>`` for each category of the chain."""
    names = [f"p_{c}" for c in categories]
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])

    @F.pandas_udf(schema)
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(chain)
        for some in texts:
            values = scorer.score(some.tolist()) if chain else np.zeros((len(some), len(names)))
            yield pd.DataFrame(values, columns=names)

    return docs.withColumn("__score", score(text)).withColumns({n: F.col(f"__score.{n}") for n in names}).drop("__score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = train(docs, table(spark, sf_dir, "labels"))
    return classify(docs, chain).select("doc_id", "p_quality", "p_toxic", (F.col("p_toxic") >= THRESHOLD).alias("is_toxic"))
