"""Inverted-file vector index: clusters, quantised postings, budgeted search with exact rescoring.

Clusters of too many rows are split, all of a level at once, until none holds more than about vectors_per_cluster: each
is sampled in place and split by k-means in a task of its own, and its rows go to the nearest of its new centroids. A
second cluster is then given to each row among its siblings, one whose residual is least along the first. Postings lie
in cluster order with quantised codes, so a search reads the probed clusters alone; the best of them are scored exactly.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.config import metric as canonical
from tessera.config import top_k
from tessera.functions import metrics
from tessera.functions.quantize import BITS, Codes, packed, products, quantize, restored, rotation, unpacked
from tessera.operators.vector import QUERIES, best, exact, first, knn, knn_batch, matrix, rescored, restricted
from tessera.plans.lineage import cut

VECTORS_PER_CLUSTER, LEAST_PER_CLUSTER = 384, 64
FLAT = 3
MOST_SPLITS, SAMPLE, STEPS, SEED = 128, 64, 6, 42
#: Centroids of up to so many bytes are broadcast; more travel beside the rows of their cluster, of which a task has about
#: TASK_ROWS.
BROADCAST_BYTES, TASK_ROWS = 64 << 20, 100_000
OVERSIZE = 1.34
SOAR = 1.0
_STATE = "_row_id long, vector array<double>, cluster_id long, parent_id long"
#: Sample rows, and the neighbours of each, by which the share to visit is found; the share of them to be reached.
PROBES, NEIGHBOURS, TARGET = 64, 10, 0.97
#: Of a batched search: scores that are found at once, and those above their query's floor that wait to be sorted; bytes of
#: vectors that a task holds.
SCORES, WAITING, TASK_BYTES = 1 << 20, 1 << 19, 32 << 20


@dataclass(frozen=True)
class Ivf:
    """centroids: cluster_id, parent_id, n, centroid; postings: cluster_id, _row_id, code, low, high, square, vector.

    ratio: the share of the postings that rows of the table, taken as queries, needed for their neighbours.
    """

    centroids: DataFrame
    postings: DataFrame
    rows: int
    dimension: int
    metric: str
    bits: int
    rotated: bool = False
    ratio: float = 0.0


def kmeans(x: np.ndarray, k: int, seed: int = SEED, steps: int = STEPS) -> np.ndarray:
    """Centroids of x that aren't empty."""
    c = x[np.sort(np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False))]
    for _ in range(steps):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = (total / np.maximum(n, 1)[:, None])[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (np.square(c).sum(1)[None] - 2 * x @ c.T).argmin(1)


def spilled(x: np.ndarray, c: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The second cluster of each row, -1 if there is none: the distance plus SOAR times what lies along the first residual."""
    if len(c) < 2:
        return np.full(len(x), -1)
    r = x - c[own]
    square = np.square(r).sum(1)
    cost = np.square(c).sum(1)[None] - 2 * x @ c.T + np.square(x).sum(1)[:, None]
    along = (x * r).sum(1)[:, None] - r @ c.T
    cost += SOAR * np.divide(along * along, square[:, None], out=np.zeros_like(along), where=square[:, None] > 1e-16)
    cost[np.arange(len(x)), own] = np.inf
    return np.where(square > 1e-16, cost.argmin(1), -1)


def build(df: DataFrame, dimension: int, metric: str = "l2", vectors_per_cluster: int = VECTORS_PER_CLUSTER, bits: int = 4, rotate: bool = False, spill: bool = True, id_column: str = "_row_id", vector_column: str = "vector") -> Ivf:
    how = canonical(metric)
    if not LEAST_PER_CLUSTER <= vectors_per_cluster <= 65_536:
        raise ValueError(f"vectors_per_cluster must be from {LEAST_PER_CLUSTER} to 65536")
    if bits not in BITS:
        raise ValueError(f"bits must be one of {BITS}")
    rows = cut(_prepared(df, dimension, how, rotate, id_column, vector_column))
    n = rows.count()
    centroids = cut(_means(rows, dimension))
    while n > FLAT * vectors_per_cluster:
        large = cut(rows.groupBy("cluster_id").count().where(F.col("count") > OVERSIZE * vectors_per_cluster))
        if large.isEmpty():
            break
        found = cut(_splits(rows, large, vectors_per_cluster, dimension))
        if found.groupBy("cluster_id").count().where("count > 1").isEmpty():
            break  # equal vectors can't be parted
        rows = cut(_reassigned(rows, found, dimension, _STATE))
        centroids = cut(centroids.join(found.select("cluster_id").distinct(), "cluster_id", "left_anti").unionByName(found.select(F.col("child").alias("cluster_id"), F.col("cluster_id").alias("parent_id"), "centroid")))
    members = rows.select("_row_id", "vector", "cluster_id")
    if spill:
        members = members.unionByName(_second(rows, centroids, dimension))
    members = cut(members)
    counted = centroids.join(members.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id").select("cluster_id", "parent_id", "n", "centroid")
    counted = cut(counted)
    return Ivf(counted, _quantized(members, centroids, dimension, bits), n, dimension, how, bits, rotate, _calibrated(members, counted, dimension, how))


def _calibrated(members: DataFrame, centroids: DataFrame, dimension: int, metric: str) -> float:
    """The share of the postings within which TARGET of the nearest rows of PROBES sample rows lie."""
    how = "dot_product" if metric == "cosine" else metric
    rows = members.dropDuplicates(["_row_id"]).select("_row_id", "vector")
    queries = cut(rows.orderBy(F.xxhash64("_row_id"), "_row_id").limit(PROBES).withColumnRenamed("_row_id", "query_id"))
    near = knn_batch(rows, queries, NEIGHBOURS, how).select("query_id", "_row_id")
    homes = near.join(members.select("_row_id", "cluster_id"), "_row_id").toArrow()  # PROBES * NEIGHBOURS rows, twice at most
    asked, c = queries.toArrow(), centroids.toArrow()
    if not asked.num_rows:
        return 0.0
    ids, size = c.column("cluster_id").to_numpy(), c.column("n").to_numpy()
    score = metrics.scores(how, matrix(c.column("centroid").combine_chunks(), dimension), matrix(asked.column("vector").combine_chunks(), dimension))
    needed: dict[tuple[int, int], float] = {}
    passed = {}
    for j, q in enumerate(asked.column("query_id").to_pylist()):
        order = np.lexsort((ids, -score[:, j]))
        passed[q] = dict(zip(ids[order].tolist(), (np.cumsum(size[order]) / size.sum()).tolist()))
    for q, r, k in zip(*(homes.column(x).to_pylist() for x in ("query_id", "_row_id", "cluster_id"))):
        needed[q, r] = min(needed.get((q, r), 1.0), passed[q][k])
    return float(np.quantile(list(needed.values()), TARGET))


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1] or 1), pa.int32()), pa.array(x.ravel()))


def _means(rows: DataFrame, dimension: int) -> DataFrame:
    """The centroid of all rows, as cluster 0; each task sends one sum."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dimension), 0
        for batch in batches:
            total += matrix(batch.column(0), dimension).sum(axis=0)
            n += batch.num_rows
        if n:
            yield pa.record_batch([_vectors(total[None]), pa.array([n])], names=["total", "n"])

    parts = rows.select("vector").mapInArrow(summed, "total array<double>, n long").select("n", F.posexplode("total").alias("k", "x"))
    mean = parts.groupBy("k").agg((F.sum("x") / F.sum("n")).alias("x"))
    all_k = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("centroid"))  # a row per dimension
    return all_k.where(F.size("centroid") > 0).select(F.lit(0).cast("long").alias("cluster_id"), F.lit(-1).cast("long").alias("parent_id"), "centroid")


def _splits(rows: DataFrame, large: DataFrame, target: int, dimension: int) -> DataFrame:
    """cluster_id, child, centroid: each large cluster split by k-means over a sample of SAMPLE rows a centroid."""
    k = F.least(F.greatest(F.round(F.col("count") / target), F.lit(2)), F.lit(MOST_SPLITS))
    share = (F.pmod(F.xxhash64("_row_id"), F.lit(1 << 20)) / F.lit(1 << 20)) < (k * SAMPLE / F.col("count"))
    some = rows.join(large, "cluster_id").where(share).select("cluster_id", "_row_id", "vector", k.cast("int").alias("k"))

    def split(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("_row_id")
        c = kmeans(matrix(table.column("vector").combine_chunks(), dimension), table.column("k")[0].as_py())
        base = key[0].as_py()
        return pa.table({"cluster_id": np.full(len(c), base), "child": base * (MOST_SPLITS + 1) + 1 + np.arange(len(c)), "centroid": _vectors(c)})

    return some.groupBy("cluster_id").applyInArrow(split, "cluster_id long, child long, centroid array<double>")


def _beside(rows: DataFrame, found: DataFrame, by: str, dimension: int, work: Callable, schema: str) -> DataFrame:
    """work(part, children, centroids) for the rows of each cluster `by`, with the centroids (child, centroid) found for it;
    both are None where none were."""
    found = cut(found.select(by, "child", "centroid"))
    if found.count() * dimension * 8 <= BROADCAST_BYTES:
        got = found.orderBy(by, "child").toArrow()
        c = matrix(got.column("centroid").combine_chunks(), dimension) if got.num_rows else np.zeros((0, dimension))
        shared = rows.sparkSession.sparkContext.broadcast((got.column(by).to_numpy(), got.column("child").to_numpy(), c))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, children, c = shared.value
            for batch in batches:
                own = batch.column(by).to_numpy()
                order = np.argsort(own, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
                    if len(part):
                        a, b = np.searchsorted(names, own[part[0]]), np.searchsorted(names, own[part[0]], "right")
                        yield work(batch.take(pa.array(part)), *((children[a:b], c[a:b]) if b > a else (None, None)))

        return rows.mapInArrow(run, schema)
    # a cluster's centroids come before its rows, once for each of the tasks that share it
    tasks = cut(rows.groupBy(by).agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("tasks")))
    one = rows.join(tasks, by).withColumn("salt", F.pmod(F.xxhash64("_row_id"), F.col("tasks")).cast("int"))
    many = found.join(tasks, by).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)))
    columns = [F.col(c) for c in rows.columns]
    both = one.select(F.col(by).alias("_by"), "salt", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("child"), F.struct(*columns).alias("row"), F.lit(None).cast("array<double>").alias("centroid"))
    both = both.unionByName(many.select(F.col(by).alias("_by"), "salt", F.lit(0).alias("kind"), "child", F.lit(None).cast(both.schema["row"].dataType).alias("row"), "centroid"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, children, c = None, [], []
        for batch in batches:
            own, kind = np.stack([batch.column(k).to_numpy() for k in (0, 1)]), batch.column(2).to_numpy()
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero((np.diff(own) != 0).any(axis=0) | (np.diff(kind) != 0)) + 1):
                if not len(part):
                    continue
                key, some = (int(own[0, part[0]]), int(own[1, part[0]])), batch.slice(int(part[0]), len(part))
                if key != name:
                    name, children, c = key, [], []
                if kind[part[0]] == 0:
                    children.append(some.column(3).to_numpy())
                    c.append(matrix(some.column(5), dimension))
                else:
                    inner = pa.RecordBatch.from_struct_array(some.column(4))
                    yield work(inner, *((np.concatenate(children), np.concatenate(c)) if children else (None, None)))

    return both.repartition("_by", "salt").sortWithinPartitions("_by", "salt", "kind", "child").mapInArrow(stream, schema)


def _reassigned(rows: DataFrame, found: DataFrame, dimension: int, schema: str) -> DataFrame:
    def assign(part: pa.RecordBatch, children: np.ndarray | None, c: np.ndarray | None) -> pa.RecordBatch:
        if children is None:
            return part
        own = children[nearest(matrix(part.column("vector"), dimension), c)]
        return pa.record_batch([part.column("_row_id"), part.column("vector"), pa.array(own), part.column("cluster_id")], names=["_row_id", "vector", "cluster_id", "parent_id"])

    return _beside(rows, found, "cluster_id", dimension, assign, schema)


def _second(rows: DataFrame, centroids: DataFrame, dimension: int) -> DataFrame:
    def second(part: pa.RecordBatch, children: np.ndarray | None, c: np.ndarray | None) -> pa.RecordBatch:
        ok, other = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if children is not None:
            to = spilled(matrix(part.column("vector"), dimension), c, np.searchsorted(children, part.column("cluster_id").to_numpy()))
            ok = np.flatnonzero(to >= 0)
            other = children[to[ok]]
        take = pa.array(ok)
        return pa.record_batch([part.column("_row_id").take(take), part.column("vector").take(take), pa.array(other)], names=["_row_id", "vector", "cluster_id"])

    siblings = centroids.select("parent_id", F.col("cluster_id").alias("child"), "centroid")
    return _beside(rows, siblings, "parent_id", dimension, second, "_row_id long, vector array<double>, cluster_id long")


def _prepared(df: DataFrame, dimension: int, metric: str, rotated: bool, id_column: str, vector_column: str) -> DataFrame:
    """_row_id, vector as it stands in the index, cluster_id 0 and parent_id -1."""
    turn = rotation(dimension) if rotated else None

    def prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), dimension)
            x = metrics.normalized(x) if metric == "cosine" else x
            yield pa.record_batch([batch.column(0), _vectors(x if turn is None else x @ turn), pa.array(np.zeros(len(x), np.int64)), pa.array(np.full(len(x), -1))], names=["_row_id", "vector", "cluster_id", "parent_id"])

    rows = df.select(F.col(id_column).cast("long").alias("_row_id"), F.col(vector_column).alias("vector")).where(F.col("vector").isNotNull())
    return rows.mapInArrow(prepared, _STATE)


def assigned(index: Ivf, df: DataFrame, id_column: str = "_row_id", vector_column: str = "vector") -> DataFrame:
    """Postings of further rows in the clusters of an index: each goes to the nearest centroid.

    Centroids are broadcast in blocks of BROADCAST_BYTES; a row keeps the best of the blocks before.
    """
    rows = _prepared(df, index.dimension, index.metric, index.rotated, id_column, vector_column).select("_row_id", "vector", F.lit(-1).cast("long").alias("cluster_id"), F.lit(math.inf).alias("at"))
    dimension = index.dimension
    blocks = max(1, math.ceil(index.centroids.count() * dimension * 8 / BROADCAST_BYTES))
    for k in range(blocks):
        got = index.centroids.where(F.pmod(F.xxhash64("cluster_id"), F.lit(blocks)) == k).select("cluster_id", "centroid").orderBy("cluster_id").toArrow()
        c = matrix(got.column("centroid").combine_chunks(), dimension) if got.num_rows else np.zeros((0, dimension))
        shared = df.sparkSession.sparkContext.broadcast((got.column("cluster_id").to_numpy(), c))

        def nearer(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, c = shared.value
            for batch in batches:
                own, at = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
                if len(c) and batch.num_rows:
                    x = matrix(batch.column(1), dimension)
                    d = np.square(c).sum(1)[None] - 2 * x @ c.T
                    best_at = d.argmin(1)
                    d = d[np.arange(len(x)), best_at]
                    ok = (d < at) | ((d == at) & (names[best_at] < own))
                    own[ok], at[ok] = names[best_at][ok], d[ok]
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own), pa.array(at)], names=["_row_id", "vector", "cluster_id", "at"])

        rows = rows.mapInArrow(nearer, "_row_id long, vector array<double>, cluster_id long, at double")
    return _quantized(cut(rows.where("cluster_id >= 0").select("_row_id", "vector", "cluster_id")), index.centroids, dimension, index.bits)


def save(index: Ivf, path: str, part: str) -> None:
    """Write an index to a folder, its postings as one part."""
    index.centroids.repartitionByRange("cluster_id").sortWithinPartitions("cluster_id").write.mode("overwrite").parquet(f"{path}/centroids")
    save_postings(index.postings, path, part)
    meta = {k: getattr(index, k) for k in ("rows", "dimension", "metric", "bits", "rotated", "ratio")}
    index.centroids.sparkSession.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def save_postings(postings: DataFrame, path: str, part: str) -> None:
    postings.repartitionByRange("cluster_id", "_row_id").sortWithinPartitions("cluster_id", "_row_id").write.mode("overwrite").parquet(f"{path}/postings/{part}")


def load(spark: SparkSession, path: str, parts: Iterable[str] = ("0",)) -> Ivf:
    """An index that save() wrote, with these parts of its postings; it needs nothing else than its folder."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Ivf(spark.read.parquet(f"{path}/centroids"), spark.read.parquet(*(f"{path}/postings/{p}" for p in parts)), **meta)


def _quantized(members: DataFrame, centroids: DataFrame, dimension: int, bits: int) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = quantize(matrix(batch.column("vector"), dimension) - matrix(batch.column("centroid"), dimension), bits)
            data = [x.tobytes() for x in packed(c.code, bits)]
            yield pa.record_batch([batch.column("cluster_id"), batch.column("_row_id"), pa.array(data, pa.binary()), pa.array(c.low), pa.array(c.high), pa.array(c.square), batch.column("vector")], names=["cluster_id", "_row_id", "code", "low", "high", "square", "vector"])

    joined = members.join(centroids.select("cluster_id", "centroid"), "cluster_id").select("cluster_id", "_row_id", "vector", "centroid")
    return joined.mapInArrow(code, "cluster_id long, _row_id long, code binary, low double, high double, square double, vector array<double>")


def visit_ratio(n: int, candidates: int, k: int = 10) -> float:
    """The share of all vectors that a search of candidates results may look at."""
    scaled = lambda x, most: min(max(math.log1p(x) / most, 0.0), 1.0)
    ratio = 0.003 + 0.037 * (0.85 * scaled(candidates / k - 1, math.log(11)) + 0.15 * scaled(k, math.log(10001)))
    return min(ratio, min(1.0, 0.045 * (1e6 / max(n, 1)) ** 0.35))


def search(index: Ivf, query, k: int, ratio: float | None = None, n_probe: int | None = None, candidates: DataFrame | Iterable[int] | None = None, oversample: float = 3.0, raw: DataFrame | None = None) -> DataFrame:
    """_row_id and score of about the k nearest rows: clusters are probed in order of their centroids' scores.

    Probing goes on past the budget until k rows are found. n_probe sets the clusters, ratio the share of vectors. raw
    (_row_id, vector) are the vectors for exact scores, by default those of the postings.
    """
    if oversample < 1:
        raise ValueError("oversample must be at least 1")
    k, q = top_k(k), metrics.checked(query, index.dimension)
    q = metrics.normalized(q[None])[0] if index.metric == "cosine" else q
    original, q = q, q @ rotation(index.dimension) if index.rotated else q
    how = "dot_product" if index.metric == "cosine" else index.metric
    wanted = max(k, math.ceil(k * oversample))
    clusters, total = index.centroids.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not clusters:
        return index.postings.where("false").selectExpr("_row_id", "CAST(0 AS double) AS score")
    budget = 2 * ratio * index.rows if ratio else max(2 * visit_ratio(index.rows, wanted) * index.rows, index.ratio * total)
    # as many clusters as the budget takes at their mean size; more if they turn out small, or hold too few candidates
    probes = min(clusters, n_probe or math.ceil(max(budget, 1) * clusters / total))
    while True:
        order = _ranked(index, q, how, probes)
        short = not n_probe and sum(n for _, n in order) < budget
        if not short or probes == clusters:
            hits = cut(_probe(index, [c for c, _ in order], q, wanted, how, candidates))
            if n_probe or probes == clusters or hits.count() >= k:
                break
        probes = min(2 * probes, clusters)
    vectors = index.postings.where(F.col("cluster_id").isin([c for c, _ in order])).select("_row_id", "vector").dropDuplicates(["_row_id"]) if raw is None else raw
    exact = rescored(hits, vectors, q if raw is None else original, how)
    return exact.limit(k)


def _order(how: str, centroids: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """What ranks the clusters (columns) of each query as their scores do, by one product of matrices."""
    out = queries @ centroids.T
    if how == "l2":
        out *= 2
        out -= np.square(centroids).sum(1)
    elif how != "inner_product":
        np.maximum(out, -1, out=out)  # the score is 0 below
    return out


class _Tops:
    """The most best places of each of n queries among the scores that are added."""

    def __init__(self, n: int, most: int) -> None:
        self.most, self.floor, self.waiting = most, np.full(n, -np.inf), 0
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]  # query, place, score

    def add(self, here: np.ndarray, score: np.ndarray, begin: int) -> None:
        """The scores of the places from begin on (columns) for the queries here (rows)."""
        at = np.flatnonzero(score > self.floor[here, None])
        row, column = np.divmod(at, score.shape[1])
        self.parts.append((here[row], begin + column, score.ravel()[at]))
        self.waiting += len(at)
        if self.waiting > WAITING:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        """Sort what waits, and raise the floors; the queries and places that are left."""
        who, place, score = map(np.concatenate, zip(*self.parts))
        # by query and falling score as one integer, which sorts many times faster; scores go without their last bits
        bits = max(len(self.floor).bit_length(), 1)
        raw = score.view(np.int64)
        falling = ~(raw ^ (raw >> 63 & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)
        order = np.argsort(who.astype(np.uint64) << np.uint64(64 - bits) | falling >> np.uint64(bits))
        order = order[first(who[order], self.most)]
        who, place, score = who[order], place[order], score[order]
        full = np.flatnonzero(np.bincount(who, minlength=len(self.floor)) == self.most)
        self.floor[full] = score[np.searchsorted(who, full, "right") - 1]
        self.parts, self.waiting = [(who, place, score)], 0
        return who, place


def search_batch(index: Ivf, queries: DataFrame, k: int, oversample: float = 3.0) -> DataFrame:
    """query_id, _row_id, score, rank: about the k nearest rows of every row (query_id, vector) of queries.

    Each query visits its best clusters up to the budget of search, and at least twice the candidates it wants, as a row
    may stand in two clusters. Each task scores the best of its own postings exactly.
    """
    if oversample < 1:
        raise ValueError("oversample must be at least 1")
    k, dimension, bits = top_k(k), index.dimension, index.bits
    unit = index.metric == "cosine"
    how = "dot_product" if unit else index.metric
    wanted = max(k, math.ceil(k * oversample))
    turn = rotation(dimension) if index.rotated else None
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector").where(F.col("vector").isNotNull())
    c = index.centroids.orderBy("cluster_id").toArrow()
    size = c.column("n").to_numpy()
    where = matrix(c.column("centroid").combine_chunks(), dimension) if len(size) else np.zeros((0, dimension))
    budget = max(2 * visit_ratio(index.rows, wanted) * index.rows, index.ratio * size.sum(), 2 * wanted)
    context = queries.sparkSession.sparkContext
    all_centroids = context.broadcast((where, size))

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, size = all_centroids.value
        for batch in batches:
            q = matrix(batch.column(1), dimension)
            q = metrics.normalized(q) if unit else q
            q = q if turn is None else q @ turn
            least = np.zeros(len(q))
            for a in range(0, len(q) if len(size) else 0, 256):
                score = _order(how, where, q[a : a + 256])
                order = np.argsort(-score, axis=1, kind="stable")
                last = np.minimum((np.cumsum(size[order], axis=1) < budget).sum(axis=1), len(size) - 1)
                at = np.arange(len(score))
                least[a : a + 256] = score[at, order[at, last]]
            yield pa.record_batch([batch.column(0), _vectors(q), pa.array(least)], names=["query_id", "vector", "least"])

    asked = cut(asked.mapInArrow(limits, "query_id long, vector array<double>, least double"))
    postings = index.postings.join(index.centroids.select("cluster_id", "centroid"), "cluster_id")
    tasks = max(context.defaultParallelism, math.ceil(size.sum() * dimension * 8 / TASK_BYTES))
    postings = cut(postings.repartition(tasks, "cluster_id").sortWithinPartitions("cluster_id").select("cluster_id", "_row_id", "code", "low", "high", "square", "vector", "centroid"))
    parts = max(1, math.ceil(asked.count() / QUERIES))
    out = None
    for part in range(parts):
        got = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)).toArrow()  # about QUERIES rows
        shared = context.broadcast((got.column("query_id").to_numpy(), matrix(got.column("vector").combine_chunks(), dimension) if got.num_rows else np.zeros((0, dimension)), got.column("least").to_numpy()))

        def visit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, least = shared.value
            least = least - 1e-12 * np.square(q).sum(1)  # what rounding may hide
            ids, vectors, passed = [np.zeros(0, np.int64)], [np.zeros((0, dimension))], 0
            tops = _Tops(len(q), 2 * wanted)  # a row may stand in two clusters
            for batch in batches:
                if not batch.num_rows or not len(q):
                    continue
                data = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                cluster = batch.column(0).to_numpy()
                begin = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
                near = matrix(batch.column(7), dimension)
                x = near + restored(Codes(unpacked(data, bits, dimension), *(batch.column(j).to_numpy() for j in (3, 4, 5))), bits)
                near = near[begin]
                visited = (_order(how, near, q) + 1e-12 * np.square(near).sum(1) >= least[:, None]).T.copy()
                square = np.square(x).sum(1)
                for j, (a, b) in enumerate(zip(begin, np.append(begin[1:], len(cluster)))):
                    here = np.flatnonzero(visited[j])
                    if not len(here):
                        continue
                    asking, step = q[here], max(1, SCORES // len(here))
                    for c in range(a, b, step):
                        to = min(b, c + step)
                        new = asking @ x[c:to].T  # in the order of the scores
                        if how == "l2":
                            new *= 2
                            new -= square[c:to]
                        tops.add(here, new, passed + c)
                ids.append(batch.column(1).to_numpy())
                vectors.append(matrix(batch.column(6), dimension))
                passed += batch.num_rows
            i, v = np.concatenate(ids), np.concatenate(vectors)
            who, place = tops.fold()
            order = np.lexsort((i[place], who))
            who, place = who[order], place[order]
            once = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(i[place], prepend=-1) != 0))
            who, place = who[once], place[once]
            score = exact(how, v, place, q, who)
            order = np.lexsort((i[place], -score, who))
            order = order[first(who[order], k)]
            yield pa.record_batch([pa.array(names[who[order]]), pa.array(i[place[order]]), pa.array(score[order])], names=["query_id", "_row_id", "score"])

        one = postings.mapInArrow(visit, "query_id long, _row_id long, score double")
        out = one if out is None else out.unionByName(one)
    once = out.groupBy("query_id", "_row_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("_row_id"))
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def estimated(how: str, codes: Codes, bits: int, centroid: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The scores of a cluster's rows from their codes; the residuals' lengths are exact."""
    if how == "l2":
        u = q - centroid
        return 1 / (1 + np.maximum(u @ u - 2 * products(codes, bits, u) + codes.square, 0))
    return metrics.of_product(how, q @ centroid + products(codes, bits, q))


def global_centroid(index: Ivf) -> list[float]:
    """The mean of all centroids."""
    parts = index.centroids.select(F.posexplode("centroid").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()  # a row per dimension
    return [r.x for r in parts]


def quantiles(index: Ivf, of: list[float]) -> list[float]:
    """Approximate quantiles of the rows' squared distances from their centroids, from a mergeable sketch."""
    sketch = index.postings.agg(F.kll_sketch_agg_double("square").alias("s"))
    return list(sketch.select(*(F.kll_sketch_get_quantile_double("s", F.lit(q)).alias(f"q{k}") for k, q in enumerate(of))).first())


def _ranked(index: Ivf, q: np.ndarray, how: str, many: int) -> list[tuple[int, int]]:
    """The best clusters and their sizes; no others leave the executors."""
    best = knn(index.centroids, q, many, how, id_column="cluster_id", vector_column="centroid")
    got = best.join(index.centroids.select(F.col("cluster_id").alias("_row_id"), "n"), "_row_id").collect()
    return [(r._row_id, r.n) for r in sorted(got, key=lambda r: (-r.score, r._row_id))]


def _probe(index: Ivf, clusters: list[int], q: np.ndarray, k: int, how: str, candidates) -> DataFrame:
    """The k rows of the clusters with the best scores from their codes, each row once."""
    rows = restricted(index.postings.where(F.col("cluster_id").isin(clusters)), candidates)
    near = index.centroids.where(F.col("cluster_id").isin(clusters)).select("cluster_id", "centroid")
    rows = rows.join(F.broadcast(near) if len(clusters) * index.dimension <= 1 << 22 else near, "cluster_id").select("_row_id", "code", "low", "high", "square", "centroid", "cluster_id")
    bits, dimension = index.bits, index.dimension

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, score = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            codes = Codes(unpacked(data, bits, dimension), *(batch.column(c).to_numpy() for c in (2, 3, 4)))
            cluster = batch.column(6).to_numpy()
            new = np.empty(len(cluster))
            order = np.argsort(cluster, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
                own = Codes(*(x[part] for x in codes))
                new[part] = estimated(how, own, bits, matrix(batch.column(5).slice(int(part[0]), 1), dimension)[0], q)
            ids, score = np.concatenate((ids, batch.column(0).to_numpy())), np.concatenate((score, new))
            at = best(score, ids, 2 * k)  # a row may stand in two clusters
            ids, score = ids[at], score[at]
        yield pa.record_batch([pa.array(ids), pa.array(score)], names=["_row_id", "score"])

    once = rows.mapInArrow(estimate, "_row_id long, score double").groupBy("_row_id").agg(F.max("score").alias("score"))
    return once.orderBy(F.desc("score"), F.asc("_row_id")).limit(k)


def neighbours(index: Ivf, k: int) -> DataFrame:
    """cluster_id, other, rank: the k nearest centroids of each."""
    a = index.centroids.select("cluster_id", "centroid")
    b = index.centroids.select(F.col("cluster_id").alias("other"), F.col("centroid").alias("there"))
    d = F.aggregate(F.zip_with("centroid", "there", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    pairs = a.join(b, F.col("cluster_id") != F.col("other")).select("cluster_id", "other", d.alias("d"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("cluster_id").orderBy("d", "other"))).where(F.col("rank") <= k).select("cluster_id", "other", "rank")
