"""Toxicity by a chain of linear classifiers.

The chain predicts its categories in order; each later logistic model also reads the
earlier categories' probabilities. While fitting, those are out-of-fold predictions,
so a later model meets probabilities of the quality that it will meet on new texts.

Fitting uses a bounded sample: the ``max_rows`` labelled documents whose hashed doc_id
is smallest. Their words and word beginnings are counted by Spark, and each category
gets its share of ``max_features`` by chi-square; the driver holds those features
and the sample's sparse rows (at most max_rows x max_features bits) and fits there.
Scoring reads every whole text once, where it lies, with no shuffle.

A null text is empty; a very long one is read whole. Labels that are null or whose document is missing don't count;
a doc_id labelled twice counts once, with its largest labels; repeated rows get a row
each. With no labels, or one class only, a category's probability is its share among
the labels (0 without any) and nothing is rejected for it. Other columns are ignored
when scoring and kept by ``keep_clean``; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import Scratch, narrowed, text_bytes

_WORD = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TO_WORDS = bytes((c | 0x20 if 0x41 <= c <= 0x5A else c) if c in _WORD else 0x20 for c in range(256))
_UPPER, _DIGIT, _SIGN = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), re.sub(rb"[.,;:'\"\s]", b"", bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum()))
DENSE = 4


def text_features(text: bytes) -> set[bytes]:
    """Distinct words, and with a caret their first 4 and 5 bytes, so that inflected forms share evidence."""
    words = set(text.translate(_TO_WORDS).split())
    return words | {b"^" + w[:4] for w in words if len(w) > 4} | {b"^" + w[:5] for w in words if len(w) > 5}


def dense_features(text: bytes, n_words: int) -> list[float]:
    """Log of the number of distinct features; shares of capitals, digits and signs."""
    n = max(1, len(text))
    share = lambda of: 1 - len(text.translate(None, of)) / n if text else 0.0
    return [np.log1p(n_words) / 10, share(_UPPER), share(_DIGIT), share(_SIGN)]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.2, rounds: int = 25) -> np.ndarray:
    """Weights and bias (last) by Newton steps on the penalised log loss."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w[-1] = np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6))
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.5 * (penalty * w * w).sum()
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = 1.0
        while (then := loss(w - size * step)) > now and size > 1e-4:
            size /= 2
        w, gained, now = w - size * step, now - then, then
        if gained < 1e-6 * (1 + abs(now)):
            break
    return w


def predict(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))


@dataclass
class Chain:
    """vocabulary: word to column; weights: one vector a category, in order; None where only a share is known."""

    categories: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray | None]
    shares: list[float]

    def row(self, text: bytes) -> tuple[list[int], list[float]]:
        words = text_features(text)
        return [self.vocabulary[w] for w in (words & self.vocabulary.keys())], dense_features(text, len(words))

    def matrix(self, rows: list[tuple[list[int], list[float]]]) -> np.ndarray:
        x = np.zeros((len(rows), len(self.vocabulary) + DENSE))
        for i, (hot, dense) in enumerate(rows):
            x[i, hot] = 1.0
            x[i, len(self.vocabulary) :] = dense
        return x

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probability of each category (columns) for each text."""
        x = self.matrix([self.row(t) for t in texts])
        for w, share in zip(self.weights, self.shares, strict=True):
            p = np.full(len(x), share) if w is None else predict(w, x)
            x = np.hstack([x, p[:, None]])
        return x[:, x.shape[1] - len(self.categories) :]


def fit_chain(x: np.ndarray, ys: np.ndarray, folds: np.ndarray, l2: float = 0.2) -> tuple[list[np.ndarray | None], list[float]]:
    """Weights and shares of each category; column k of ys is the chain's k-th."""
    weights, shares = [], []
    for y in ys.T:
        shares.append(float(y.mean()) if len(y) else 0.0)
        if len(y) == 0 or y.min() == y.max():
            weights.append(None)
            out = np.full(len(x), shares[-1])
        else:
            out = np.zeros(len(x))
            for k in np.unique(folds):
                here = folds == k
                out[here] = predict(fit_logistic(x[~here], y[~here], l2), x[here]) if (~here).any() else shares[-1]
            weights.append(fit_logistic(x, y, l2))
        x = np.hstack([x, out[:, None]])
    return weights, shares


def fit(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], max_rows: int = 10_000, max_features: int = 256, folds: int = 5) -> Chain:
    """A chain over the labels' columns ``categories``, in that order."""
    asked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    asked = asked.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in categories]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = narrowed(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text").join(F.broadcast(asked), "doc_id")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(text_features(t), t) for t in text_bytes(b.column("text"))]
            words = pa.array([list(w) for w, _ in rows], pa.list_(pa.binary()))
            dense = pa.array([dense_features(t, len(w)) for w, t in rows], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[b.column(c) for c in categories], words, dense], names=["doc_id", *categories, "words", "dense"])

    kinds = ", ".join(f"{c} int" for c in categories)
    with Scratch(docs.sparkSession) as scratch:
        sample = scratch.written(texts.mapInArrow(split, f"doc_id long, {kinds}, words array<binary>, dense array<double>").dropDuplicates(["doc_id"]), "toxicity-sample")
        sums = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
        n = sums["n"]
        # Chi-square of each word against each category; each category brings in the words with its largest.
        with_word = sample.select(*categories, F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("a"), *[F.sum(c).alias(c) for c in categories]).where("a >= 3").persist()
        best: dict[bytes, int] = {}
        for c in reversed(categories):
            share = (sums[c] or 0) / max(n, 1)
            chi = F.pow(F.col(c) - F.col("a") * share, 2) / (F.col("a") * max(share * (1 - share), 1e-9))
            for r in with_word.select("word", chi.alias("chi")).orderBy(F.desc("chi"), "word").limit(max_features // len(categories)).collect():
                best.setdefault(bytes(r["word"]), len(best))
        with_word.unpersist()
        chain = Chain(categories, best, [], [])
        known = F.array(*[F.lit(w) for w in chain.vocabulary]) if chain.vocabulary else F.array().cast("array<binary>")
        rows = sample.select("doc_id", *categories, F.array_intersect("words", known).alias("words"), "dense").orderBy("doc_id").collect()
        x = chain.matrix([([chain.vocabulary[bytes(w)] for w in r["words"]], r["dense"]) for r in rows])
        ys = np.array([[r[c] for c in categories] for r in rows], dtype=float).reshape(len(rows), len(categories))
    chain.weights, chain.shares = fit_chain(x, ys, np.arange(len(rows)) % folds)
    return chain


def score(docs: DataFrame, chain: Chain, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_<category> of each category, and toxic: whether the last one's probability reaches the threshold."""
    names = [f"p_{c}" for c in chain.categories]
    model = docs.sparkSession.sparkContext.broadcast(chain)  # max_features words and weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, parts = text_bytes(b.column("text")), []
            for at in range(0, len(texts), 1000):
                parts.append(model.value.scores(texts[at : at + 1000]))
            p = np.vstack(parts) if parts else np.zeros((0, len(names)))
            flags = (p[:, -1] >= threshold) & (model.value.weights[-1] is not None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x) for x in p.T], pa.array(flags)], names=["doc_id", *names, "toxic"])

    rows = narrowed(docs.withColumn("doc_id", docs["doc_id"].cast("long")), "doc_id", "text")
    return rows.mapInArrow(run, f"doc_id long, {', '.join(f'{x} double' for x in names)}, toxic boolean")


CATEGORIES = ("low_quality", "toxic")


def label_categories(labels: DataFrame) -> DataFrame:
    """The chain's categories from the table's quality (0 or 1) and toxic columns."""
    return labels.select("doc_id", (1 - F.col("quality").cast("int")).alias("low_quality"), F.col("toxic").cast("int").alias("toxic"))


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, label_categories(labels), CATEGORIES))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that the chain doesn't find toxic; rows without a label table's help are scored alike."""
    chain = fit(docs, label_categories(labels), CATEGORIES)
    model = docs.sparkSession.sparkContext.broadcast(chain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = text_bytes(b.column("text")), []
            for at in range(0, len(texts), 1000):
                keep += (model.value.scores(texts[at : at + 1000])[:, -1] < threshold).tolist()
            yield b if model.value.weights[-1] is None else b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
