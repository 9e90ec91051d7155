"""Benchmark decontamination with spaced seeds.

Fixed masks over a few word positions ignore some of the positions, so a seed still hits where an ignored word was
substituted. The masks of each length of item are chosen so that every pattern of substitutions that MIN_EQUAL allows
in WINDOW words, or in all words of a shorter item, leaves at least one seed whole (tested by enumeration). The hashes of the benchmark's masked windows are joined with those of the documents; around each hit the
item is laid over the document and the words are compared one by one, substitutions allowed.

Defined results: a null or empty text has no words and matches nothing; an item of fewer than EXACT words is found where
all its words stand in a row, as with so few a substitution would match what has nothing to do with it; repeated item rows count once; a null doc_id or item_id is carried as it is; every repeated document row is reported. Of several places of
one item in one document the one with most equal words is reported, the first of those that tie. Only the columns named
here are read, so others may clash as they like; an empty table gives an empty result.
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

EXACT = 8
#: A hit holds if in some WINDOW words of the item around it (all of a shorter item) so large a share is equal.
WINDOW = 13
MIN_EQUAL = 0.8
#: The masks by the least number of words of an item: two substitutions in 13 words and in 10, one in 8.
MASKS = {
    13: ("1101110111", "11010011111", "11111010011", "111101111", "110011110101"),
    10: ("1111011", "10101111", "110110011", "11001111", "111010101"),
    8: ("1101111", "11110101", "10111011"),
} | {n: ("1" * n,) for n in range(1, EXACT)}
#: Characters of benchmark text that are broadcast at once; a larger benchmark is looked for slice by slice.
BROADCAST_CHARS = 24_000_000

SCHEMA = "doc_id long, item_id long, item_words int, start_word int, equal_words int, similarity double"


class Seeds(NamedTuple):
    """The benchmark's words by item and its seeds, sorted by hash; kinds are the keys of MASKS that its items need, table
    marks the high bits that occur."""

    item_id: list
    words: np.ndarray
    off: np.ndarray
    kinds: np.ndarray
    hash: np.ndarray
    item: np.ndarray
    at: np.ndarray
    table: np.ndarray


def _masked(words: np.ndarray, mask: str, salt: int) -> np.ndarray:
    """The hash of the mask laid over each position that it fits."""
    n = max(0, len(words) - len(mask) + 1)
    out = np.full(n, salt, np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            out = (out ^ words[k : k + n]) * np.uint64(0x9DDFEA08EB382D69)
            out ^= out >> np.uint64(29)
    return out


def _kind(length: np.ndarray) -> np.ndarray:
    """The key of MASKS for items of so many words, 0 for those too short."""
    least = np.array([0, *sorted(MASKS)])
    return least[np.searchsorted(least, length, "right") - 1]


def _masks(kinds: np.ndarray) -> list[tuple[int, int, str]]:
    """(salt, kind, mask) of the kinds."""
    return [(100 * int(kind) + k, int(kind), m) for kind in kinds for k, m in enumerate(MASKS[int(kind)])]


def seeds(items: pa.Table) -> Seeds:
    text = items.column("text").combine_chunks()
    w = X.words(text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks))
    length = np.diff(w.off)
    kind_of = _kind(length)
    kinds = np.unique(kind_of[kind_of > 0])
    owner = np.repeat(np.arange(len(length)), length)
    hashes, item, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for salt, kind, mask in _masks(kinds):
        h = _masked(w.hash, mask, salt)
        p = np.arange(len(h))
        fits = owner[: len(h)] == owner[len(mask) - 1 : len(mask) - 1 + len(h)]
        fits &= kind_of[owner[: len(h)]] == kind
        hashes.append(h[fits])
        item.append(owner[: len(h)][fits])
        at.append((p - w.off[owner[: len(h)]])[fits])
    h, item, at = (np.concatenate(x) for x in (hashes, item, at))
    order = np.argsort(h, kind="stable")
    bits = max(16, math.ceil(math.log2(len(h) + 1)) + 6)
    table = np.zeros(1 << bits, bool)
    table[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
    return Seeds(items.column("item_id").to_pylist(), w.hash, w.off, kinds, h[order], item[order], at[order], table)


def _hits(w: X.Words, s: Seeds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (row, item, place of the item's first word) of all seed hits."""
    shift = np.uint64(64 - int(math.log2(len(s.table))))
    rows, items, places = ([np.zeros(0, np.int64)] for _ in range(3))
    for salt, _, mask in _masks(s.kinds):
        h = _masked(w.hash, mask, salt)
        p = np.flatnonzero(s.table[(h >> shift).astype(np.int64)])
        lo, hi = np.searchsorted(s.hash, h[p]), np.searchsorted(s.hash, h[p], "right")
        row = np.searchsorted(w.off, p, "right") - 1
        ok = (hi > lo) & (p + len(mask) <= w.off[row + 1])
        p, lo, row, many = p[ok], lo[ok], row[ok], (hi - lo)[ok]
        k = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
        rows.append(np.repeat(row, many))
        items.append(s.item[k])
        places.append(np.repeat(p, many) - s.at[k])
    found = np.unique(np.stack([np.concatenate(x) for x in (rows, items, places)]), axis=1)
    return found[0], found[1], found[2]


def matches(text: pa.Array, s: Seeds) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, item, start, equal words, similarity) of the verified overlaps, slice by slice."""
    for a, b in X.slices(text):
        w = X.words(text.slice(a, b - a))
        row, item, place = _hits(w, s)
        if not len(row):
            continue
        m = np.diff(s.off)[item]
        to = np.concatenate(([0], np.cumsum(m)))
        which = np.repeat(np.arange(len(m)), m)
        j = np.arange(to[-1]) - to[which]
        p = place[which] + j
        inside = (p >= w.off[row[which]]) & (p < w.off[row[which] + 1])
        same = inside & (w.hash[np.clip(p, 0, len(w.hash) - 1)] == s.words[s.off[item[which]] + j])
        total = np.concatenate(([0], np.cumsum(same)))
        width = np.minimum(m, WINDOW)[which]
        fits = j + width <= m[which]
        t = np.arange(to[-1])
        share = np.where(fits, (total[np.minimum(t + width, to[-1])] - total[t]) / width, 0.0)
        best = np.maximum.reduceat(share, to[:-1])
        equal = total[to[1:]] - total[to[:-1]]
        ok = best >= np.where(m < EXACT, 1.0, MIN_EQUAL)
        row, item, place, equal, best = row[ok], item[ok], place[ok], equal[ok], best[ok]
        order = np.lexsort((place, -equal, item, row))
        row, item, place, equal, best = (x[order] for x in (row, item, place, equal, best))
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
        start = np.maximum(place - w.off[row], 0)
        yield row[first] + a, item[first], start[first], equal[first], best[first]


def _sliced(benchmark: DataFrame) -> Iterator[Seeds]:
    """Seeds of the whole benchmark, in as many slices as its checked size asks for."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = max(1, math.ceil(chars / BROADCAST_CHARS))
    for k in range(n):
        yield seeds((items if n == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)).toArrow())


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """SCHEMA's row for each document and item that overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for s in _sliced(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(s)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            s = shared.value
            ids = np.array([-1 if x is None else x for x in s.item_id], np.int64)
            lost = np.array([x is None for x in s.item_id], bool)
            for batch in batches:
                for row, item, start, equal, share in matches(batch.column(1), s):
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(row)), pa.array(ids[item], mask=lost[item]), pa.array(np.diff(s.off)[item], pa.int32()), pa.array(start, pa.int32()), pa.array(equal, pa.int32()), pa.array(np.round(share, 6))],
                        names=["doc_id", "item_id", "item_words", "start_word", "equal_words", "similarity"],
                    )

        part = docs.mapInArrow(scan, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that overlap with no item, all their columns kept; no shuffle, unless the benchmark has several slices:
    then those found in each are left out by a hash of doc_id and text."""
    found = []
    for s in _sliced(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(s)

        def overlaps(text: pa.Array, shared=shared) -> np.ndarray:
            out = np.zeros(len(text), bool)
            for rows, *_ in matches(text, shared.value):
                out[rows] = True
            return out

        found.append(overlaps)
    if len(found) == 1:
        at = docs.columns.index("text")

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(~found[0](batch.column(at))))

        return docs.mapInArrow(keep, docs.schema)
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text").cast("string"))
    gone = None
    for overlaps in found:

        def keys(batches: Iterator[pa.RecordBatch], overlaps=overlaps) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.record_batch([batch.column(0).filter(pa.array(overlaps(batch.column(1))))], names=["_tessera_key"])

        part = docs.select(key.alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(keys, "_tessera_key long")
        gone = part if gone is None else gone.unionByName(part)
    return docs.withColumn("_tessera_key", key).join(gone.distinct(), "_tessera_key", "left_anti").select(*docs.columns)
