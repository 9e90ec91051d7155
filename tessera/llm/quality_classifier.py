"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Words stand in BUCKETS by hash, each followed by its shape (case and marks at its ends), which is a word of its own.
Every bucket has a sparse random index vector of DIM dimensions; its context vector is the sum of the index vectors of its
neighbours, WINDOW words and as many shapes to either side, over the whole corpus. A document is the mean of its words'
vectors and the mean absolute step between adjacent ones in their first STEPS dimensions. A network of one hidden layer, fitted in numpy on at most SAMPLE labelled documents, gives the probability that the
document is good; a temperature fitted on held-out labels calibrates it. All documents are scored.

Defined results: a null or empty text, or one without words, has no vector and is rejected with probability 0; texts of
any length are read whole; labels of documents that aren't there, or null, are left out; of several labels of one
doc_id the lowest counts; without labels of both kinds nothing can be fitted and every document is kept with probability
null; a null doc_id is scored like any other; repeated rows are scored each and alike. Other columns pass through kept()
untouched; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import text as X

BUCKETS, DIM, NONZERO, WINDOW = 1 << 15, 256, 8, 2
#: Dimensions in which steps from word to word are taken.
STEPS = 32
#: Labelled documents that the network is fitted on: those of lowest hash.
SAMPLE = 12_000
HIDDEN, EPOCHS, RATE, DECAY = 32, 40, 0.003, 1e-3
HELD_OUT = 0.2
KEEP = 0.5
_BLOCK = 128
_SLICE = 1 << 19
#: Words whose vectors are in the processor's cache together.
_CHUNK = 2048

_RANDOM = np.random.default_rng(3)
_PLACE = _RANDOM.integers(0, DIM // NONZERO, (BUCKETS, NONZERO)) + DIM // NONZERO * np.arange(NONZERO)  # one in each stripe
_SIGN = _RANDOM.choice(np.array([-1, 1], np.float32), (BUCKETS, NONZERO))

_KIND = np.zeros(256, np.uint64)  # 0 other, 1 lower or beyond ASCII, 2 upper, 3 digit, else the mark itself
for _b in range(256):
    _KIND[_b] = 1 if _b >= 128 or chr(_b).islower() else 2 if chr(_b).isupper() else 3 if chr(_b).isdigit() else _b


def stream(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and their shapes by turns, and the rows' offsets."""
    w = X.words(text, strip=False)
    if not len(w.hash):
        return np.zeros(0, np.int64), w.off
    length = w.end - w.begin
    at = [w.begin, np.minimum(w.begin + 1, w.end - 1), np.maximum(w.end - 2, w.begin), w.end - 1]
    shape = (length == 1).astype(np.uint64)
    for p in at:
        shape = shape * np.uint64(257) + _KIND[w.data[p]]
    out = np.empty(2 * len(w.hash), np.int64)
    mask = np.uint64(BUCKETS - 1)
    out[::2] = (w.hash & mask).astype(np.int64)
    out[1::2] = (X.mix(shape + np.uint64(0xABCDEF)) & mask).astype(np.int64)
    return out, 2 * w.off


def _planes(x: np.ndarray) -> bytes:
    """Floats byte by byte, which a shuffle compresses far better: sums of few words differ in one byte or two."""
    return x.view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view(np.float32).ravel()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's sums of neighbours' index vectors, in blocks of _BLOCK buckets."""
    total = np.zeros(BUCKETS * DIM, np.float32)
    for batch in batches:
        for a, b in X.slices(batch.column(0), _SLICE):
            ids, off = stream(batch.column(0).slice(a, b - a))
            row = np.repeat(np.arange(b - a), np.diff(off))
            near = []
            for d in range(1, 2 * WINDOW + 1):
                same = row[d:] == row[:-d]
                left, right = ids[:-d][same], ids[d:][same]
                near += [left * BUCKETS + right, right * BUCKETS + left]
            if not near:
                continue
            pair, many = np.unique(np.concatenate(near), return_counts=True)  # in order of the bucket that they are added to
            own, other, many = pair // BUCKETS * DIM, pair % BUCKETS, many.astype(np.float32)
            for k in range(NONZERO):
                np.add.at(total, own + _PLACE[other, k], many * _SIGN[other, k])
    parts = total.reshape(-1, _BLOCK * DIM)
    at = np.flatnonzero(parts.any(axis=1))
    for k in at:
        yield pa.record_batch([pa.array([k], pa.int32()), pa.array([_planes(parts[k])], pa.binary())], names=["block", "part"])
    X.release()


def _summed(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_BLOCK * DIM)
    for batch in batches:
        for part in batch.column("part"):
            total += _from_planes(part.as_buffer())
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([_planes(total.astype(np.float32))], pa.binary())], names=["block", "part"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit context vectors of the whole corpus; a bucket that never occurs is all zero.

    The tasks' sums are of fixed size, so there are no more tasks than cores.
    """
    tasks = docs.sparkSession.sparkContext.defaultParallelism
    parts = docs.select(F.col("text").cast("string").alias("text")).coalesce(tasks).mapInArrow(_contexts, "block int, part binary")
    out = np.zeros((BUCKETS // _BLOCK, _BLOCK * DIM), np.float32)
    for r in parts.groupBy("block").applyInArrow(_summed, "block int, part binary").toLocalIterator():
        out[r.block] = _from_planes(r.part)
    out = out.reshape(BUCKETS, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


WIDTH = DIM + STEPS + 1


def pooled(text: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """WIDTH features of each row; the last is 1 where there are words."""
    out = []
    v, first = np.empty((_CHUNK, DIM), np.float32), np.ascontiguousarray(vectors[:, :STEPS])
    here, before = np.empty((_CHUNK, STEPS), np.float32), np.empty((_CHUNK, STEPS), np.float32)
    for a, b in X.slices(text, _SLICE):
        ids, off = stream(text.slice(a, b - a))
        n = np.diff(off)
        row = np.repeat(np.arange(b - a), n)
        part = np.zeros((b - a, WIDTH))
        place = np.arange(len(ids)) - off[:-1][row]
        for c in range(0, len(ids), _CHUNK):
            i, r = ids[c : c + _CHUNK], row[c : c + _CHUNK]
            m = len(i)
            new = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            np.take(vectors, i, axis=0, out=v[:m], mode="clip")
            part[r[new], :DIM] += np.add.reduceat(v[:m], new, axis=0)
            # a word and the word before it, a shape and the shape before it
            np.take(first, i, axis=0, out=here[:m], mode="clip")
            np.take(first, ids[np.maximum(np.arange(c, c + m) - 2, 0)], axis=0, out=before[:m], mode="clip")
            np.subtract(here[:m], before[:m], out=here[:m])
            np.abs(here[:m], out=here[:m])
            here[:m][place[c : c + m] < 2] = 0
            part[r[new], DIM:-1] += np.add.reduceat(here[:m], new, axis=0)
        part[:, :DIM] /= np.maximum(n, 1)[:, None]
        part[:, DIM:-1] /= np.maximum(n - 2, 1)[:, None]
        part[:, -1] = n > 0
        out.append(part)
    return np.concatenate(out) if out else np.zeros((0, WIDTH))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """The network's weights and temperature, from features and 0/1 labels."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    held, train = order[: int(HELD_OUT * len(x))], order[int(HELD_OUT * len(x)) :]
    mean, std = x[train].mean(0), x[train].std(0) + 1e-6
    z = (x - mean) / std
    w = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
    m, v, t = {k: np.zeros_like(p) for k, p in w.items()}, {k: np.zeros_like(p) for k, p in w.items()}, 0
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
            h = np.tanh(z[part] @ w["a"] + w["b"])
            e = (_sigmoid(h @ w["c"] + w["d"]) - y[part]) / len(part)
            back = np.outer(e, w["c"]) * (1 - h * h)
            grad = {"a": z[part].T @ back, "b": back.sum(0), "c": h.T @ e, "d": np.array([e.sum()])}
            t += 1
            for k, g in grad.items():
                g = g + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    w |= {"mean": mean, "std": std, "temperature": np.ones(1)}
    if len(held):
        logit = _logit(x[held], w)
        grid = np.exp(np.linspace(-2, 3, 101))
        p = np.clip(_sigmoid(logit[None] / grid[:, None]), 1e-9, 1 - 1e-9)
        w["temperature"] = grid[[np.argmin(-(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean(1))]]
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return (np.tanh((x - w["mean"]) / w["std"] @ w["a"] + w["b"]) @ w["c"] + w["d"]) / w["temperature"]


def probability(x: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    return np.where(x[:, -1] > 0, _sigmoid(_logit(x, w)), 0.0)


def sample(docs: DataFrame, labels: DataFrame, columns: list[str], size: int) -> DataFrame:
    """doc_id, text and the label columns of at most size labelled documents, those of lowest hash of doc_id."""
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("int").alias(c) for c in columns)).dropna()
    few = ids.groupBy("doc_id").agg(*(F.min(c).alias(c) for c in columns)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    return slim.join(F.broadcast(few), "doc_id")  # of at most size rows


def train(docs: DataFrame, labels: DataFrame, shared: Broadcast) -> dict[str, np.ndarray] | None:
    """The network fitted on labels (doc_id, quality) over broadcast word vectors; None if there is nothing to fit."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), shared.value)
            yield pa.record_batch([batch.column("doc_id"), batch.column("quality"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "quality", "x"])

    got = sample(docs, labels, ["quality"], SAMPLE).mapInArrow(features, "doc_id long, quality int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = np.array(got.column("x").to_pylist()).reshape(-1, WIDTH)
    y = (got.column("quality").to_numpy() > 0).astype(float)
    order = np.lexsort(np.concatenate((x.T, [got.column("doc_id").to_numpy()])))
    return fit(x[order], y[order]) if len(set(y)) == 2 else None


def scored(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """doc_id and quality_probability of the documents that are kept."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _filtered(slim, labels, keep, True).select("doc_id", "quality_probability")


def kept(docs: DataFrame, labels: DataFrame, keep: float = KEEP) -> DataFrame:
    """docs that are kept, with their own columns; no shuffle of documents."""
    return _filtered(docs, labels, keep, False)


def _filtered(docs: DataFrame, labels: DataFrame, keep: float, with_probability: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(docs))
    network = train(docs, labels, shared)  # small enough to go with the function
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema, T.StructField("quality_probability", T.DoubleType())]) if with_probability else docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = shared.value
        for batch in batches:
            if network is None:
                ok, p = np.ones(batch.num_rows, bool), pa.nulls(batch.num_rows, pa.float64())
            else:
                p = probability(pooled(batch.column(at), vectors), network)
                ok, p = p >= keep, pa.array(np.round(p, 6))
            if with_probability:
                batch = pa.record_batch([*batch.columns, p], names=[*batch.schema.names, "quality_probability"])
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(run, schema)
