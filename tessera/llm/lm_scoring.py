"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

Words (by their letters and digits, in lower case) are counted over the whole corpus. In order of their counts they are the
leaves of nested classes: a class of BRANCH members holds LEAVES words and as many smaller classes, down to as many levels
as the corpus has words, so that each word has an output of its own and a frequent one is reached in few steps. A word's
probability is the product, over the classes on its way, of the member's probability given the class and the context: a
softmax of what the counts alone say plus the weights of hashed features: the word before, and on the first WIDE levels the
two words before (n-grams) and the second word before alone (a skip). The table of weights has ROWS * words ** GROWTH rows, at most MOST_ROWS, which is
the bound of what is broadcast.

Training visits every document once, in STEPS synchronous steps that each take the documents of one hash. In a step every
task sums the gradients of its documents at the same weights; the sums of all tasks are added up, and each row follows its
mean gradient, drawn to zero as if SHRINK more occurrences had none. So the model doesn't depend on the number of tasks but
for rounding. Scoring goes through all documents in numpy batches.

Result: doc_id, n_words, log_prob (mean natural logarithm of the words' probabilities), perplexity.

Defined results: a null or empty text, or one without words, has n_words 0 and null scores; texts of any length are read
whole; a null doc_id is scored and reported as it is; repeated rows are scored each, and count in the training; words of
equal count are in order of their hash; a word that training never saw has the probability of a class of its own, which
counts once; words of one id (the first bits of the hash, of which there are two to four times as many as
words, MOST_BITS bits at most) are one. Only doc_id and text are read, so other columns may clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as X
from tessera.plans.lineage import cut

#: Members of a class; of those, words where there are smaller classes below. LEAVES is 1 << _SHIFT and half of BRANCH.
BRANCH, LEAVES, _SHIFT = 32, 16, 4
#: Levels on which all features have weights; below them, where classes are rare, the word before alone has.
WIDE = 2
ROWS, GROWTH, LEAST_ROWS, MOST_ROWS = 2.4, 0.6, 1 << 10, 1 << 21
LEAST_BITS, MOST_BITS = 12, 22
STEPS, RATE, SHRINK, CLIP = 5, 4.0, 10.0, 15.0
#: Positions whose gradients are added up together, and positions whose weights are in the processor's cache together.
BATCH, CHUNK = 1 << 16, 1 << 12
#: Rows of the table that are sent together.
_BLOCK = 2048
_SLICE = 1 << 20
#: Distinct words that a task holds before it hands their counts on, about.
_HELD = 1 << 21
_NEVER = np.float32(-1e4)

_ODD = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class Vocabulary(NamedTuple):
    """Of each word id the place of its leaf: class within the level << 8 | member << 3 | level (from 1); of each level its
    first class; of each class the logarithms of its members' shares by the counts."""

    leaf: np.ndarray
    first: np.ndarray
    base: np.ndarray

    @property
    def bits(self) -> int:
        return len(self.leaf).bit_length() - 1


class Sums(NamedTuple):
    """The gradient of each row's weights (a column each), of the summed logarithms of probabilities, and how often the row
    occurred."""

    gradient: np.ndarray
    seen: np.ndarray


def table_rows(words: int) -> int:
    """Rows of the table of weights for a corpus of so many words."""
    return int(min(max(ROWS * words**GROWTH, LEAST_ROWS), MOST_ROWS)) // 4 * 4


def vocabulary(counts: np.ndarray) -> Vocabulary:
    """From the count of each word id; ids that never occur share one leaf that counts once."""
    some = np.argsort(-counts, kind="stable")[: int((counts > 0).sum())]
    many = np.append(counts[some], 1)
    level, home, member = (np.zeros(len(many), np.int64) for _ in range(3))
    first, at, depth = [0], 0, 1
    while at < len(many):
        classes = LEAVES ** (depth - 1)
        left = len(many) - at
        last = left <= BRANCH * classes
        if last:
            classes = math.ceil(left / BRANCH)
        n = left if last else LEAVES * classes
        k = np.arange(n)
        level[at : at + n], home[at : at + n], member[at : at + n] = depth, k % classes, k // classes
        at += n
        first.append(first[-1] + classes)
        depth += 1
    first = np.array(first)
    mass = np.zeros((first[-1], BRANCH))
    for step in range(1, depth):
        at = np.flatnonzero(level >= step)
        np.add.at(mass, (first[step - 1] + _class(home[at], level[at], step), _member(home[at], member[at], level[at], step)), many[at])
    total = mass.sum(axis=1, keepdims=True)
    base = np.where(mass > 0, np.log(np.maximum(mass, 1e-30) / np.maximum(total, 1e-30)), _NEVER).astype(np.float32)
    place = np.full(len(counts), len(many) - 1, np.int32)
    place[some] = np.arange(len(some))
    return Vocabulary((home << 8 | member << 3 | level).astype(np.uint32)[place], first, base)


def leaves(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level, class within it and member of Vocabulary.leaf."""
    code = code.astype(np.int64)
    return code & 7, code >> 8, code >> 3 & 31


def _class(home: np.ndarray, level: np.ndarray, step: int) -> np.ndarray:
    """The class within the level step on the way to a leaf."""
    return home >> (_SHIFT * (level - step))


def _member(home: np.ndarray, member: np.ndarray, level: np.ndarray, step: int) -> np.ndarray:
    """The member of that class on the way to a leaf."""
    return np.where(level == step, member, LEAVES + ((home >> (_SHIFT * np.maximum(level - step - 1, 0))) & (LEAVES - 1)))


def ids(w: X.Words, bits: int) -> np.ndarray:
    return (w.hash >> np.uint64(64 - bits)).astype(np.int64)


def features(word: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Three 64-bit feature hashes of each position: n-grams of one and two words before, and the skip to the second."""
    w = word.astype(np.uint64)
    back = []
    for d in (1, 2):
        x = np.full(len(w), np.uint64(1) << np.uint64(40))
        ok = row[d:] == row[:-d] if len(w) > d else np.zeros(0, bool)
        x[d:][ok] = w[:-d][ok]
        back.append(x)
    a, b = back
    return np.stack([X.mix(a * _ODD[0] + np.uint64(1)), X.mix(X.mix(b * _ODD[1] + np.uint64(2)) + a * _ODD[2]), X.mix(b * _ODD[3] + np.uint64(3))])


class Scorer:
    """Goes through words in batches, with buffers of its own."""

    def __init__(self, v: Vocabulary, table: np.ndarray) -> None:
        self.v, self.table = v, table
        half, quarter = len(table) // 2, len(table) // 4
        self.parts = ((0, half), (half, quarter), (half + quarter, len(table) - half - quarter))
        self.salt = X.mix(np.arange(v.first[-1], dtype=np.uint64) * _ODD[1] + np.uint64(7))
        self.z, self.y = np.empty((CHUNK, BRANCH), np.float32), np.empty((CHUNK, BRANCH), np.float32)
        self.turned = np.empty((BRANCH, BATCH), np.float32)

    def rows(self, f: np.ndarray, cls: np.ndarray, wide: bool) -> list[np.ndarray]:
        """The table row of each feature, or of the first alone, within each class."""
        out, salt = [], self.salt[cls]
        for k, (begin, size) in enumerate(self.parts if wide else self.parts[:1]):
            h = ((f[k] ^ salt) * _ODD[2]) >> np.uint64(32)
            out.append(((h * np.uint64(size)) >> np.uint64(32)).astype(np.int64) + begin)
        return out

    def batches(self, word: np.ndarray, row: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
        """(places, classes, members, rows) of a level of a batch; a place comes once for each level of its word."""
        f = features(word, row)
        for a in range(0, len(word), BATCH):
            level, home, member = leaves(self.v.leaf[word[a : a + BATCH]])
            for step in range(1, len(self.v.first)):
                at = np.flatnonzero(level >= step)
                if not len(at):
                    break
                cls = self.v.first[step - 1] + _class(home[at], level[at], step)
                yield at + a, cls, _member(home[at], member[at], level[at], step), self.rows(f[:, a + at] if step <= WIDE else f[:1, a + at], cls, step <= WIDE)

    def exponentials(self, cls: np.ndarray, member: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Chunk by chunk: the exponentials of all members' logits, their sums, and the logits of the members asked for."""
        one = np.ones(BRANCH, np.float32)
        for a in range(0, len(cls), CHUNK):
            part = slice(a, min(a + CHUNK, len(cls)))
            z, y = self.z[: part.stop - a], self.y[: part.stop - a]
            np.take(self.v.base, cls[part], axis=0, out=z, mode="clip")
            for r in rows:
                np.take(self.table, r[part], axis=0, out=y, mode="clip")
                z += y
            own = z[np.arange(len(z)), member[part]]
            np.exp(z, out=z)  # weights are within CLIP, so it is finite and the sum isn't 0
            yield part, z, z @ one, own

    def log_probabilities(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Of each word of rows that lie end to end."""
        out = np.zeros(len(word))
        for at, cls, member, rows in self.batches(word, row):
            for part, _, total, own in self.exponentials(cls, member, rows):
                out[at[part]] += own - np.log(total)
        return out

    def add_gradients(self, word: np.ndarray, row: np.ndarray, sums: Sums) -> None:
        one = np.ones(BATCH, np.float32)
        for at, cls, member, rows in self.batches(word, row):
            turned = self.turned[:, : len(at)]
            for part, p, total, _ in self.exponentials(cls, member, rows):
                p *= (-1 / total)[:, None]
                p[np.arange(len(p)), member[part]] += 1
                turned[:, part] = p.T
            for one_member, errors in zip(sums.gradient, turned):  # member by member, which is far faster than whole rows
                for r in rows:
                    np.add.at(one_member, r, errors)
            for r in rows:
                np.add.at(sums.seen, r, one[: len(r)])


def no_sums(rows: int) -> Sums:
    return Sums(np.zeros((BRANCH, rows), np.float32), np.zeros(rows, np.float32))


def stepped(table: np.ndarray, sums: Sums) -> np.ndarray:
    """The weights after a step along the summed gradients."""
    return np.ascontiguousarray(np.clip(table + RATE * (sums.gradient / (sums.seen + SHRINK)).T, -CLIP, CLIP), np.float32)


def _words(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[X.Words, np.ndarray]]:
    for batch in batches:
        for a, b in X.slices(batch.column(column), _SLICE):
            w = X.words(batch.column(column).slice(a, b - a))
            if len(w.hash):
                yield w, np.repeat(np.arange(b - a), np.diff(w.off))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their numbers of occurrences; a task may give a word more than once."""
    held, size = [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        h, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h)
        h, n = h[order], n[order]
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        return h[new], np.add.reduceat(n, new)

    for w, _ in _words(batches):
        held.append(np.unique(w.hash, return_counts=True))
        size += len(held[-1][0])
        if size > _HELD:
            held = [merged()]
            size = len(held[0][0])
            if size > _HELD // 2:
                yield pa.record_batch([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], names=["word", "n"])
                held, size = [], 0
    if held:
        h, n = merged()
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])


def count_words(docs: DataFrame) -> np.ndarray:
    """The number of occurrences of each word id in all of docs; there are ids enough for the words of the corpus."""
    each = cut(docs.select("text").mapInArrow(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    bits = min(max(LEAST_BITS, (2 * each.count()).bit_length()), MOST_BITS)
    got = each.groupBy(F.shiftrightunsigned("word", 64 - bits).alias("id")).agg(F.sum("n").alias("n")).toArrow()  # 2**bits rows at most
    out = np.zeros(1 << bits, np.int64)
    out[got.column("id").to_numpy()] = got.column("n").to_numpy()
    return out


def _added(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's sums over all tasks."""
    total, seen = 0.0, 0.0
    for batch in batches:
        for g, n in zip(batch.column("gradient"), batch.column("seen")):
            total = total + np.frombuffer(g.as_buffer(), np.float32).astype(np.float64)
            seen = seen + np.frombuffer(n.as_buffer(), np.float32).astype(np.float64)
    yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.astype(np.float32).tobytes()], pa.binary())], names=["block", "gradient", "seen"])


def gradients(docs: DataFrame, v: Vocabulary, table: np.ndarray) -> Sums:
    """The summed gradients of all of docs (text) at these weights.

    What a task sends is of the table's size, so there are no more tasks than cores.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((v, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = shared.value
        scorer, sums = Scorer(v, table), no_sums(len(table))
        for w, row in _words(batches):
            scorer.add_gradients(ids(w, v.bits), row, sums)
        for a in range(0, len(table), _BLOCK):
            if sums.seen[a : a + _BLOCK].any():
                yield pa.record_batch([pa.array([a // _BLOCK], pa.int32()), pa.array([sums.gradient[:, a : a + _BLOCK].tobytes()], pa.binary()), pa.array([sums.seen[a : a + _BLOCK].tobytes()], pa.binary())], names=["block", "gradient", "seen"])
        X.release()

    schema = "block int, gradient binary, seen binary"
    out = no_sums(len(table))
    for r in docs.select("text").coalesce(sc.defaultParallelism).mapInArrow(run, schema).groupBy("block").applyInArrow(_added, schema).toLocalIterator():  # the table's size
        at = slice(r.block * _BLOCK, (r.block + 1) * _BLOCK)
        out.gradient[:, at], out.seen[at] = np.frombuffer(r.gradient, np.float32).reshape(BRANCH, -1), np.frombuffer(r.seen, np.float32)
    shared.unpersist()
    return out


def train(docs: DataFrame) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary and the weights of docs (doc_id, text)."""
    counts = count_words(docs)
    v = vocabulary(counts)
    table = np.zeros((table_rows(int(counts.sum())), BRANCH), np.float32)
    for k in range(STEPS):
        table = stepped(table, gradients(docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(STEPS)) == k), v, table))
    return v, table


def scored(docs: DataFrame) -> DataFrame:
    """The result that the module describes."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(train(slim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, table = shared.value
        scorer = Scorer(v, table)
        for batch in batches:
            for a, b in X.slices(batch.column(1), _SLICE):
                w = X.words(batch.column(1).slice(a, b - a))
                n = np.diff(w.off)
                total = X.row_sums(scorer.log_probabilities(ids(w, v.bits), np.repeat(np.arange(b - a), n)), w.off)
                mean = total / np.maximum(n, 1)
                none = n == 0
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(n), pa.array(np.round(mean, 6), mask=none), pa.array(np.round(np.exp(-mean), 4), mask=none)], names=["doc_id", "n_words", "log_prob", "perplexity"])

    return slim.mapInArrow(run, "doc_id long, n_words long, log_prob double, perplexity double")
