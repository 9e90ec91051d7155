"""Exact nearest neighbours: numpy over Arrow batches, k rows kept per task, the best k of those.

Ties go to the lower row id. Rows without a vector are in no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import metric as canonical
from tessera.config import top_k
from tessera.functions import metrics

#: Query vectors that go with one pass over the table; more are searched in several. Rows that are scored at once, and for
#: how many of the queries; pairs of them whose vectors are laid side by side.
QUERIES, ROWS, BLOCK, PAIRS = 4_096, 1_024, 256, 1 << 11


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """A list column without nulls as rows of doubles."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(values) != len(column) * dimension:
        raise ValueError(f"a vector doesn't have {dimension} dimensions")
    return values.reshape(len(column), dimension)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the k highest scores, lower ids first among equal ones."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= least)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))[:k]]


def first(who: np.ndarray, k: int) -> np.ndarray:
    """Which places are among the first k of their run of equal values."""
    begin = np.flatnonzero(np.diff(who, prepend=-1))
    return np.arange(len(who)) - np.repeat(begin, np.diff(begin, append=len(who))) < k


def exact(metric: str, vectors: np.ndarray, row: np.ndarray, queries: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The score of each pair (row, query), PAIRS at a time."""
    each = [metrics.paired(metric, vectors[row[a : a + PAIRS]], queries[query[a : a + PAIRS]]) for a in range(0, len(row), PAIRS)]
    return np.concatenate(each) if each else np.zeros(0)


def restricted(df: DataFrame, candidates: DataFrame | Iterable[int] | None, id_column: str = "_row_id") -> DataFrame:
    """df's rows among the candidates, before any search; duplicates and unknown ids don't matter."""
    if candidates is None:
        return df
    if not isinstance(candidates, DataFrame):
        ids = sorted(set(map(int, candidates)))
        if not ids:
            return df.where("false")
        candidates = df.sparkSession.createDataFrame([(x,) for x in ids], f"`{id_column}` long")
    return df.join(candidates.select(F.col(candidates.columns[0]).alias(id_column)), id_column, "left_semi")


def knn(df: DataFrame, query, k: int, metric: str = "l2", candidates: DataFrame | Iterable[int] | None = None, id_column: str = "_row_id", vector_column: str = "vector") -> DataFrame:
    """_row_id and score of the k nearest rows."""
    q, how, k = metrics.checked(query), canonical(metric), top_k(k)
    rows = restricted(df.select(F.col(id_column).cast("long").alias("_row_id"), F.col(vector_column).alias("vector")).where(F.col("vector").isNotNull()), candidates)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, score = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            new = metrics.scores(how, matrix(batch.column(1), len(q)), q)
            ids, score = np.concatenate((ids, batch.column(0).to_numpy())), np.concatenate((score, new))
            at = best(score, ids, k)
            ids, score = ids[at], score[at]
        yield pa.record_batch([pa.array(ids), pa.array(score)], names=["_row_id", "score"])

    return rows.mapInArrow(nearest, "_row_id long, score double").orderBy(F.desc("score"), F.asc("_row_id")).limit(k)


def knn_batch(df: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_column: str = "_row_id", vector_column: str = "vector") -> DataFrame:
    """query_id, _row_id, score, rank: the k nearest rows of every row (query_id, vector) of queries."""
    how, k = canonical(metric), top_k(k)
    rows = df.select(F.col(id_column).cast("long").alias("_row_id"), F.col(vector_column).alias("vector")).where(F.col("vector").isNotNull())
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where(F.col("vector").isNotNull())
    parts = max(1, math.ceil(asked.count() / QUERIES))
    out = None
    for part in range(parts):
        got = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).toArrow()
        vectors = got.column("vector").combine_chunks()
        dimension = len(vectors[0].as_py()) if len(vectors) else 0
        shared = df.sparkSession.sparkContext.broadcast((got.column("query_id").to_numpy(), matrix(vectors, dimension) if dimension else np.zeros((0, 0))))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared, dimension=dimension) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            blocks = range(0, len(names), BLOCK)
            kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))] * len(blocks)  # query, row id and score
            least = np.full(len(names), -np.inf)  # the k-th best score of each query so far
            for batch in batches:
                all_ids = batch.column(0).to_numpy()
                for a in range(0, batch.num_rows if len(names) else 0, ROWS):
                    x = matrix(batch.column(1).slice(a, ROWS), dimension)
                    for n, begin in enumerate(blocks):
                        some, limit = q[begin : begin + BLOCK], least[begin : begin + BLOCK]
                        row, j = metrics.promising(how, x, some, k, limit)
                        if not len(row):
                            continue
                        who, ids, score = map(np.concatenate, zip(kept[n], (j, all_ids[a + row], exact(how, x, row, some, j))))
                        order = np.lexsort((ids, -score, who))
                        order = order[first(who[order], k)]
                        who, ids, score = kept[n] = who[order], ids[order], score[order]
                        full = np.flatnonzero(np.bincount(who, minlength=len(some)) == k)
                        limit[full] = score[np.searchsorted(who, full, "right") - 1]
            who, ids, score = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *((w + begin, i, s) for begin, (w, i, s) in zip(blocks, kept))))
            yield pa.record_batch([pa.array(names[who]), pa.array(ids), pa.array(score)], names=["query_id", "_row_id", "score"])

        one = rows.mapInArrow(nearest, "query_id long, _row_id long, score double")
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("_row_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rescored(hits: DataFrame, df: DataFrame, query, metric: str = "l2", id_column: str = "_row_id", vector_column: str = "vector") -> DataFrame:
    """hits (_row_id, score) with exact scores, best first; a row without vector keeps its score."""
    q, how = metrics.checked(query), canonical(metric)
    raw = df.select(F.col(id_column).alias("_row_id"), F.col(vector_column).alias("vector"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there = batch.column(2).is_valid()
            score = batch.column(1).to_numpy(zero_copy_only=False).copy()
            score[there.to_numpy(zero_copy_only=False)] = metrics.scores(how, matrix(batch.column(2).filter(there), len(q)), q)
            yield pa.record_batch([batch.column(0), pa.array(score)], names=["_row_id", "score"])

    return hits.join(raw, "_row_id", "left").select("_row_id", "score", "vector").mapInArrow(again, "_row_id long, score double").orderBy(F.desc("score"), F.asc("_row_id"))
