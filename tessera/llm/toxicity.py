"""Toxicity by a classifier chain.

The categories are the label columns: every column of labels that holds 0 and 1 alone, in their order, with toxic at the
end. They are predicted one after the other; each linear model sees the log-odds that the models before it gave. While
fitting, those are out-of-fold predictions, so that a later model learns how far earlier ones are to be trusted. Features are
hashed words and word beginnings, of which the FEATURES most telling ones (by the G statistic of presence) of each category
are kept. A document is toxic if its last probability reaches the threshold that gave the best F1 out of fold.

Result: doc_id, and p_<category> of each, of the toxic documents.

Defined results: a null or empty text has no features and is never toxic; texts of any length are read whole; labels that are
null in toxic, or of no document, are left out, a null of another category is 0; of several labels of one doc_id the lowest counts; a category of which there is
one kind of label has probability 0 or 1 throughout; without both kinds of toxic nothing is fitted and nothing is toxic; of
features that tell alike those of lower hash are taken, of equal thresholds the highest; a null doc_id is scored and reported
as it is; repeated rows are each reported; only doc_id and text of documents are read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as X
from tessera.llm.quality_classifier import sample

#: The category that is reported.
LAST = "toxic"
BITS, FEATURES, FOLDS = 22, 8192, 5
#: Labelled documents that the chain is fitted on: those of lowest hash.
SAMPLE = 12_000
PREFIXES = (4, 5, 6, 7, 8)  # bytes
L2, STEPS = 1e-4, 300


def features(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of every word and word beginning of about these many bytes, which end with a letter."""
    w = X.words(text)
    row = np.repeat(np.arange(len(text)), np.diff(w.off))
    rows, out = [row], [w.hash]
    for n in PREFIXES:
        long = w.end - w.begin > n
        rows.append(row[long])
        out.append(X.beginnings(w, n)[long])
    return np.concatenate(rows), (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


class Sparse(NamedTuple):
    """Values at (row, column) of n rows and width columns, and dense columns behind them."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int
    width: int
    dense: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.column], self.n) + self.dense @ w[self.width :]

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.concatenate((np.bincount(self.column, self.value * e[self.row], self.width), self.dense.T @ e))

    def some(self, rows: np.ndarray) -> Sparse:
        """The rows where rows is true."""
        at, ok = np.cumsum(rows) - 1, rows[self.row]
        return Sparse(at[self.row[ok]], self.column[ok], self.value[ok], int(rows.sum()), self.width, self.dense[rows])

    def beside(self, column: np.ndarray) -> Sparse:
        return self._replace(dense=np.column_stack((self.dense, column)))


def _solve(x: Sparse, y: np.ndarray) -> np.ndarray:
    """Logistic weights by accelerated gradient; the first dense column, all ones, is not drawn to zero."""
    norm = np.bincount(x.row, x.value**2, x.n) + np.square(x.dense).sum(1)
    scale = 4 / (norm.mean() * 2 + 4 * L2)
    w = prev = np.zeros(x.width + x.dense.shape[1])
    decay = np.full(len(w), L2)
    decay[x.width] = 0
    for t in range(STEPS):
        look = w + (t / (t + 3)) * (w - prev)
        p = 1 / (1 + np.exp(-np.clip(x.dot(look), -30, 30)))
        prev, w = w, look - scale * (x.back(p - y) / x.n + decay * look)
    return w


def fit_chain(x: Sparse, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """One weight vector for each column of y, and the out-of-fold log-odds of each."""
    fold = np.random.default_rng(11).permutation(x.n) % FOLDS
    models, all_out = [], []
    for k in range(y.shape[1]):
        out = np.zeros(x.n)
        for f in range(FOLDS):
            out[fold == f] = x.some(fold == f).dot(_solve(x.some(fold != f), y[fold != f, k]))
        models.append(_solve(x, y[:, k]))
        all_out.append(out)
        x = x.beside(np.clip(out, -6, 6))
    return models, np.column_stack(all_out)


def predict_chain(x: Sparse, models: list[np.ndarray]) -> np.ndarray:
    """The log-odds of each category."""
    out = []
    for w in models:
        out.append(x.dot(w))
        x = x.beside(np.clip(out[-1], -6, 6))
    return np.column_stack(out)


def _counted(text: pa.Array, index: np.ndarray, width: int) -> Sparse:
    """log(1 + count) of the chosen features; index maps a hashed feature to its column or -1."""
    rows, columns, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for a, b in X.slices(text):
        row, feature = features(text.slice(a, b - a))
        column = index[feature]
        hit = column >= 0
        pair, count = np.unique(row[hit] * width + column[hit], return_counts=True)
        rows.append(pair // width + a)
        columns.append(pair % width)
        values.append(np.log1p(count))
    return Sparse(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), len(text), width, np.ones((len(text), 1)))


def telling(there: list[np.ndarray], n: np.ndarray) -> np.ndarray:
    """The FEATURES most telling of the features that occur in so many documents of either label, of n documents each."""
    seen = np.flatnonzero(there[0] + there[1] >= 2)
    a, b = there[1][seen], there[0][seen]
    expected = (a + b) * n[1] / n.sum()
    g = a * np.log(np.maximum(a, 0.5) / expected) + b * np.log(np.maximum(b, 0.5) / (a + b - expected))
    return seen[np.argsort(-g, kind="stable")[:FEATURES]]


def best_threshold(odds: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """The log-odds from which on documents are toxic, and the F1 that it gives: the best there is."""
    order = np.argsort(-odds, kind="stable")
    right = np.cumsum(toxic[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + toxic.sum())
    f1[:-1][odds[order][1:] == odds[order][:-1]] = -1  # equal ones can't be parted
    best = int(np.argmax(f1))
    after = odds[order[best + 1]] if best + 1 < len(order) else odds[order[best]] - 2
    return float((odds[order[best]] + after) / 2), float(f1[best])


def fit(text: pa.Array, y: np.ndarray) -> dict:
    """The chain, its features and its threshold, from labels of 0 and 1, a column for each category."""
    there = np.zeros((y.shape[1], 2, 1 << BITS), np.int32)
    for a, b in X.slices(text):
        row, feature = features(text.slice(a, b - a))
        pair = np.unique(row * np.int64(1 << BITS) + feature)
        row, feature = pair >> BITS, pair & ((1 << BITS) - 1)
        for k in range(y.shape[1]):
            for label in (0, 1):
                there[k, label] += np.bincount(feature[y[a:b, k][row] == label], minlength=1 << BITS)
    chosen = np.unique(np.concatenate([telling(list(t.astype(float)), np.array([(c == 0).sum(), (c == 1).sum()], float)) for t, c in zip(there, y.T) if 0 < c.sum() < len(c)]))
    index = np.full(1 << BITS, -1, np.int32)
    index[chosen] = np.arange(len(chosen))
    x = _counted(text, index, len(chosen))
    models, out = fit_chain(x, y.astype(float))
    threshold, f1 = best_threshold(out[:, -1], y[:, -1])
    return {"index": index, "width": len(chosen), "models": models, "threshold": threshold, "f1": f1}


def categories(labels: DataFrame) -> list[str]:
    """The label columns in the order of the chain: those that hold 0 and 1 alone."""
    numbers = [c for c, kind in labels.dtypes if c not in ("doc_id", "text", LAST) and kind in ("tinyint", "smallint", "int", "bigint", "boolean")]
    ok = labels.agg(F.lit(1).alias("one"), *(F.bool_and(F.col(c).cast("int").isin(0, 1)).alias(c) for c in numbers)).first()
    return [*(c for c in numbers if ok[c]), LAST]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The result that the module describes; the documents aren't shuffled."""
    names = categories(labels)
    got = sample(docs, labels.select("doc_id", *(F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in names[:-1]), LAST), names, SAMPLE).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    schema = "doc_id long, " + ", ".join(f"`p_{c}` double" for c in names)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    y = np.column_stack([got.column(c).to_numpy() > 0 for c in names]) if got.num_rows else np.zeros((0, len(names)), bool)
    text = got.column("text").combine_chunks()
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.string())
    if y[:, -1].all() or not y[:, -1].any():
        return slim.where("false").select("doc_id", *(F.lit(None).cast("double").alias(f"p_{c}") for c in names))
    shared = docs.sparkSession.sparkContext.broadcast(fit(text, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for batch in batches:
            x = _counted(batch.column(1), chain["index"], chain["width"])
            out = predict_chain(x, chain["models"])
            ok = (out[:, -1] >= chain["threshold"]) & (np.bincount(x.row, minlength=x.n) > 0)
            p = 1 / (1 + np.exp(-np.clip(out[ok], -30, 30)))
            yield pa.record_batch([batch.column(0).filter(pa.array(ok)), *(pa.array(np.round(c, 6)) for c in p.T)], names=["doc_id", *(f"p_{c}" for c in names)])

    return slim.mapInArrow(run, schema)
