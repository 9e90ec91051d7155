"""N-gram Jaccard join with Bayesian candidate pruning.

Each document is the set of its word n-grams. Documents of equal words are one text. Texts that agree in a band of MinHash
values are candidates of each other; they are compared block by block: a text belongs to the lowest band that it shares,
texts of bands that a text has in common are brought together MERGES times over and cut into blocks of about BLOCK texts at
most, and two blocks are compared once if they share a band, however many bands and texts that may be. So a family of copies
is one block, not one for each of its bands, and its texts are sent once, not once for every pair of those; a band of a
million texts is a million / BLOCK blocks over as many tasks, and no pair is ever a row. The MinHash values of two texts are compared STEP at a time; the pair is dropped as soon as the posterior probability
that its Jaccard similarity reaches the threshold, given the agreements so far and a uniform prior, falls below TOLERANCE.
The pairs left are verified exactly on their n-gram sets.

Result: one row for each document that is linked with another: doc_id, class_id (the lowest doc_id of all that links
connect), text_id (the lowest doc_id of equal words) and links (the number of different texts whose similarity to the
document's own reaches the threshold; equal texts have one text_id and are no links).

Defined results: a null or empty text, or one without words, has no n-grams and no row; a text of fewer than NGRAM words is
one n-gram of all of them; texts of any length are taken whole; a null doc_id can't be named and is left out; rows that
repeat a doc_id are one document, and where their texts differ it belongs to one class with all their links, whose numbers
are added up, under the least text_id. Only doc_id and text are read, so other columns may clash as they like; an empty
table gives an empty result. one_of_each_group() keeps the document of lowest doc_id of each class, one row of it (of
several texts the least), and all documents without doc_id or text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import text as X
from tessera.plans.lineage import cut

NGRAM = 3
THRESHOLD = 0.5
#: Candidates agree in all ROWS values of one of BANDS bands: a pair at 0.5 is one with probability 0.95, at 0.55 with 0.99, at 0.6 with 0.999.
BANDS, ROWS = 48, 4
STEP = 16
TOLERANCE = 1e-4
#: Texts of a block, and n-grams of them, about.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Times that texts under different bands are brought together by the bands that they share.
MERGES = 3
#: Pairs that are compared at once.
_PAIRS = 1 << 16
_CELL = ["label_a", "part_a", "label_b", "part_b"]
#: Sets of ids of up to so many are broadcast to the scan of the documents; larger ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_SEED = np.random.default_rng(77)
_MULTIPLY = (_SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_ADD = _SEED.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)


def signatures(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """MinHash values of each non-empty row, cut to 16 bits: BANDS * ROWS each."""
    some = np.flatnonzero(np.diff(off) > 0)
    out = np.empty((len(some), BANDS * ROWS), np.uint16)
    base = (grams >> np.uint64(32)).astype(np.uint32)
    if len(some):
        for k in range(BANDS * ROWS):
            h = base * _MULTIPLY[k] + _ADD[k]
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            out[:, k] = X.mix(np.minimum.reduceat(h, off[some]).astype(np.uint64)) >> np.uint64(48)
    return out


@cache
def least_agreements(threshold: float, tolerance: float) -> tuple[int, ...]:
    """After STEP, 2 STEP, ... values: the fewest agreements at which P(J >= threshold) under Beta(m + 1, n - m + 1) is still tolerance."""
    out = []
    for n in range(STEP, BANDS * ROWS + 1, STEP):
        p, m = 0.0, -1
        while p < tolerance:  # P = P(Binomial(n + 1, threshold) <= m)
            m += 1
            p += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def in_steps(values: np.ndarray) -> np.ndarray:
    """Signature rows cut into STEP values, all rows of a step together."""
    return np.ascontiguousarray(values.reshape(len(values), -1, STEP).transpose(1, 0, 2))


def survives(steps: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> np.ndarray:
    """Which pairs (a, b) of the rows are left after all comparisons."""
    alive, agree = np.arange(len(a)), np.zeros(len(a), np.int64)
    for part, least in zip(steps, least_agreements(threshold, tolerance)):
        agree[alive] += (part[a[alive]] == part[b[alive]]).sum(axis=1)
        alive = alive[agree[alive] >= least]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _sequences(w: X.Words) -> np.ndarray:
    """Each row's sequence of words as a 64-bit sum over place-dependent scrambles."""
    out, some = np.zeros(len(w.off) - 1, np.uint64), np.flatnonzero(np.diff(w.off) > 0)
    place = (np.arange(len(w.hash)) - np.repeat(w.off[:-1], np.diff(w.off))).astype(np.uint64)
    if len(some):
        out[some] = np.add.reduceat(X.mix(w.hash + place * np.uint64(0x9E3779B97F4A7C15)), w.off[some])
    return out


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.slices(batch.column(1)):
            w = X.words(batch.column(1).slice(a, b - a))
            grams, off = X.ngrams(w.hash, w.off, NGRAM)
            some = np.flatnonzero(np.diff(w.off) > 0)
            if not len(some):
                continue
            place = (np.arange(len(w.hash)) - np.repeat(w.off[:-1], np.diff(w.off))).astype(np.uint64)
            one = _sequences(w)[some]
            two = np.add.reduceat(X.mix((w.hash ^ np.uint64(0x5851F42D4C957F2D)) + place * np.uint64(0xD1342543DE82EF95)), w.off[some])
            values = signatures(grams, off)
            width = values.shape[1] * 2
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(some), [None, pa.py_buffer(values)]).cast(pa.binary())
            yield pa.record_batch(
                [batch.column(0).slice(a, b - a).take(pa.array(some)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(np.diff(off)[some]), sig],
                names=["doc_id", "node", "h2", "size", "sig"],
            )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node under the hash of each of its bands."""
    for batch in batches:
        values = _signature_rows(batch.column(1))
        key = np.tile(np.arange(BANDS, dtype=np.uint64), len(values))
        for k in range(ROWS):
            key = X.mix(key * np.uint64(0x9FB21C651E98DF25) + values[:, k::ROWS].ravel().astype(np.uint64))
        yield pa.record_batch([pa.array(key.view(np.int64)), batch.column(0).take(pa.array(np.repeat(np.arange(len(values)), BANDS)))], names=["band", "node"])


def _signature_rows(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, BANDS * ROWS), np.uint16)
    off = np.frombuffer(column.buffers()[1], np.int32)
    return np.frombuffer(column.buffers()[2], np.uint8)[off[column.offset] : off[column.offset + len(column)]].copy().view(np.uint16).reshape(len(column), -1)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come sorted by _CELL, as tables of whole cells, and where in them each cell begins and ends."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if batch is not None and batch.num_rows:
            held.append(batch)
        if not held or (batch is not None and not batch.num_rows):
            continue
        table = pa.Table.from_batches(held)
        key = np.stack([table.column(c).to_numpy() for c in (*_CELL, "side", "node")])
        again = np.concatenate(([False], (key[:, 1:] == key[:, :-1]).all(axis=0)))
        if again.any():  # rows of the table that repeat each other
            table, key = table.filter(pa.array(~again)), key[:, ~again]
        key = key[: len(_CELL)]
        begin = np.flatnonzero(np.concatenate(([True], (key[:, 1:] != key[:, :-1]).any(axis=0))))
        upto = table.num_rows if batch is None else int(begin[-1])  # the last cell may go on in the next batch
        held = table.slice(upto).to_batches()
        if upto:
            yield table.slice(0, upto).combine_chunks(), np.append(begin[begin < upto], upto)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _left(table: pa.Table, cells: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs (a, b) of rows within each cell that aren't dropped, in order of a; rows of side 0 go with those of side 1,
    or with each other where there is one side alone. Rows of one lowest document are no pair."""
    steps = in_steps(_signature_rows(_plain(table.column("sig"))))
    side, low = table.column("side").to_numpy(), table.column("low").to_numpy()
    at = np.arange(len(side))
    stop = np.repeat(cells[1:], np.diff(cells))
    ones = np.concatenate(([0], np.cumsum(side)))
    first = stop - (ones[stop] - ones[np.repeat(cells[:-1], np.diff(cells))])  # of side 1, which comes last
    alone = first == stop
    begin, end = np.where(alone, at + 1, first), np.where(side == 1, 0, stop)
    many = np.maximum(end - begin, 0)
    passed = np.concatenate(([0], np.cumsum(many)))
    x = 0
    while x < len(at):
        y = max(x + 1, int(np.searchsorted(passed, passed[x] + _PAIRS, "right")) - 1)
        n = many[x:y]
        a = np.repeat(at[x:y], n)
        b = np.arange(len(a)) - np.repeat(passed[x:y] - passed[x], n) + begin[a]
        ok = low[a] != low[b]
        a, b = a[ok], b[ok]
        if len(a):
            ok = survives(steps, a, b, threshold)
            yield a[ok], b[ok]
        x = y


def _candidates(threshold: float):
    """The rows of each cell that are in a pair that isn't dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in _whole_cells(batches):
            some = np.zeros(table.num_rows, bool)
            for a, b in _left(table, cells, threshold):
                some[a] = some[b] = True
            yield from table.filter(pa.array(some)).to_batches()
        X.release()

    return run


def _common(grams: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of n-grams that the rows of each pair have in common; each row's are distinct and in order."""
    known, number = np.unique(grams, return_inverse=True)
    size, width = np.diff(off), len(known)
    small, large = np.where(size[a] <= size[b], (a, b), (b, a))
    if len(a) * 2e-7 * size[small].mean() <= 5e-11 * len(size) ** 2 * width:  # seconds of either way, about
        row = np.repeat(np.arange(len(size)), size)
        keys = row * np.int64(width) + number
        out = np.zeros(len(a), np.int64)
        for k, (x, y) in enumerate(zip(small, large)):
            want = number[off[x] : off[x + 1]] + y * np.int64(width)
            at = np.minimum(np.searchsorted(keys[off[y] : off[y + 1]], want), size[y] - 1)
            out[k] = (keys[off[y] + at] == want).sum() if size[y] else 0
        return out
    shared = np.flatnonzero(np.bincount(number, minlength=width) > 1)
    column = np.full(width, -1)
    column[shared] = np.arange(len(shared))
    at, row = column[number], np.repeat(np.arange(len(size)), size)
    total = np.zeros((len(size), len(size)), np.float32)  # exact up to 2**24
    for c in range(0, len(shared), 4096):
        ok = (at >= c) & (at < c + 4096)
        part = np.zeros((len(size), min(4096, len(shared) - c)), np.float32)
        part[row[ok], at[ok] - c] = 1
        total += part @ part.T
    return total[a, b].astype(np.int64)


def _verified(threshold: float):
    """low, other, links: each text's exact links within a cell, and the lowest place of those that these links connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cells in _whole_cells(batches):
            found = [np.stack(x) for x in _left(table, cells, threshold)]
            a, b = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
            lists = _plain(table.column("grams"))
            off = lists.offsets.to_numpy().astype(np.int64)
            grams, low = lists.values.to_numpy(), table.column("low").to_numpy()
            links, root = np.zeros(len(low), np.int64), np.arange(len(low))
            parts = np.searchsorted(a, cells)
            for c in np.flatnonzero(np.diff(parts)):
                x, y = cells[c], cells[c + 1]
                i, j = a[parts[c] : parts[c + 1]] - x, b[parts[c] : parts[c + 1]] - x
                size = np.diff(off[x : y + 1])
                common = _common(grams[off[x] : off[y]], off[x : y + 1] - off[x], i, j)
                ok = common >= threshold * (size[i] + size[j] - common)
                i, j = i[ok] + x, j[ok] + x
                np.add.at(links, i, 1)
                np.add.at(links, j, 1)
                while (root[i] != root[j]).any():
                    least = np.minimum(root[i], root[j])
                    np.minimum.at(root, i, least)
                    np.minimum.at(root, j, least)
            some = links > 0
            yield pa.record_batch([pa.array(low[some]), pa.array(low[root[some]]), pa.array(links[some])], names=["low", "other", "links"])
        X.release()

    return run


def _gram_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in X.slices(batch.column(0)):
            w = X.words(batch.column(0).slice(a, b - a))
            grams, off = X.ngrams(w.hash, w.off, NGRAM)
            row = np.repeat(np.arange(b - a), np.diff(off))
            grams = grams.view(np.int64)
            order = np.lexsort((grams, row))
            row, grams = row[order], grams[order]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1])
            to = np.searchsorted(row[first], np.arange(b - a + 1))
            yield pa.record_batch([pa.array(_sequences(w).view(np.int64)), pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(grams[first]))], names=["node", "grams"])


def _slim(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")


def _merges(there: DataFrame) -> Iterator[DataFrame]:
    """MERGES times: from and to, the lowest of all homes that a band joins with this one, for homes that share a band with another."""
    ties = there.select(F.col("home0").alias("from"), F.explode("bands").alias("band")).distinct()
    for _ in range(MERGES):
        lowest = ties.groupBy("band").agg(F.min("from").alias("to"), F.max("from").alias("most")).where("to < most").drop("most")
        ties = cut(ties.join(lowest, "band"))  # few: most bands have one home alone
        to = ties.groupBy("from").agg(F.min("to").alias("to"))
        yield to
        ties = ties.drop("to").join(to, "from").select(F.col("to").alias("from"), "band").distinct()


def _placed(there: DataFrame) -> DataFrame:
    """home0, label, first and parts: the blocks of a label that a home's texts are spread over. A home of over half a block
    has blocks of its own; smaller ones are put together, those first that were brought together first."""
    homes = there.groupBy("home0").agg(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_GRAMS).alias("weight"))
    for k, to in enumerate(_merges(there)):
        homes = homes.join(to.withColumnRenamed("from", f"home{k}"), f"home{k}", "left").withColumn(f"home{k + 1}", F.coalesce("to", f"home{k}")).drop("to")
    label, own = F.col(f"home{MERGES}").alias("label"), F.col("weight") > 0.5
    of = Window.partitionBy(f"home{MERGES}")
    before = of.orderBy(own.desc(), *(f"home{k}" for k in reversed(range(MERGES)))).rowsBetween(Window.unboundedPreceding, -1)
    room = F.when(own, F.ceil("weight").cast("double")).otherwise(F.col("weight"))
    several = F.sum("weight").over(of) > 1
    first = F.when(several, F.floor(F.coalesce(F.sum(room).over(before), F.lit(0.0)))).otherwise(0).alias("first")
    return homes.select("home0", label, first, F.when(several & own, F.ceil("weight")).otherwise(1).alias("parts"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """label, part and bands of the nodes that share a band with another, beside their own columns."""
    bands = nodes.select("node", "sig").mapInArrow(_bands, "band long, node long")
    shared = bands.groupBy("band").count().where("count > 1").select("band")
    of = bands.join(shared, "band").groupBy("node").agg(F.collect_set("band").alias("bands"), F.min("band").alias("home0"))  # BANDS at most
    there = cut(nodes.join(of, "node"))
    moved = _beside(there, _placed(there).where("label <> home0 OR first > 0 OR parts > 1"), "home0", "left")
    part = F.coalesce(F.col("first") + F.pmod(F.xxhash64("node"), "parts"), F.lit(0)).cast("int")
    return cut(moved.withColumn("label", F.coalesce("label", "home0")).withColumn("part", part).drop("home0", "first", "parts"))


def _links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """low, other, links of _verified(), cell by cell."""
    homes = _blocks(nodes)
    touched = homes.select("label", "part", F.explode("bands").alias("band")).distinct()
    a, b = (touched.select("band", F.col("label").alias(f"label_{x}"), F.col("part").alias(f"part_{x}")) for x in "ab")
    across = a.join(b, "band").where("label_a < label_b OR label_a = label_b AND part_a < part_b").select(*_CELL).distinct()
    within = homes.groupBy("label", "part").count().where("count > 1").selectExpr("label AS label_a", "part AS part_a", "label AS label_b", "part AS part_b")
    across = cut(across)
    cells = across.unionByName(within).select("*", F.col("label_a").alias("label"), F.col("part_a").alias("part"), F.lit(0).alias("side"))
    cells = cells.unionByName(across.select("*", F.col("label_b").alias("label"), F.col("part_b").alias("part"), F.lit(1).alias("side")))
    rows = cells.join(homes.select("label", "part", "node", "low", "sig"), ["label", "part"]).select(*_CELL, "side", "node", "low", "sig")
    kept = cut(_by_cell(rows).mapInArrow(_candidates(threshold), rows.schema))
    sets = only(docs, kept.select("low").distinct()).select("text").mapInArrow(_gram_sets, "node long, grams array<long>")
    return cut(_by_cell(kept.join(sets, "node")).mapInArrow(_verified(threshold), "low long, other long, links long"))


def _by_cell(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "side", "node")


def _grouped(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, low) of all documents that have words; (node, label) of texts that are connected, by their lowest
    documents; and (low, links)."""
    slim = _slim(docs)
    sketches = cut(slim.mapInArrow(_sketch, "doc_id long, node long, h2 long, size long, sig binary"))
    nodes = cut(sketches.groupBy("node", "h2", "size", "sig").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    found = _links(slim, nodes.select("node", "size", "sig", "low"), threshold)
    repeated = nodes.where("low < high").select("node", "h2", "low")
    alone = nodes.where("low = high").select(F.col("low").alias("doc_id"), "low")
    members = cut(sketches.select("doc_id", "node", "h2").join(repeated, ["node", "h2"]).select("doc_id", "low").unionByName(alone).distinct())
    several = members.groupBy("doc_id").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least < most")
    ties = members.join(several, "doc_id").where("low <> least").select(F.col("least").alias("doc_a"), F.col("low").alias("doc_b"))
    edges = found.where("low <> other").select(F.col("low").alias("doc_a"), F.col("other").alias("doc_b")).union(ties).distinct()
    return members, components(edges), found.groupBy("low").agg(F.sum("links").alias("links"))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, text_id, links as the module says."""
    members, labels, links = _grouped(docs, threshold)
    copied = members.where("doc_id <> low").select("low").distinct().withColumn("copied", F.lit(True))
    rows = members.join(labels.withColumnRenamed("node", "low"), "low", "left").join(copied, "low", "left").where("label IS NOT NULL OR copied").join(links, "low", "left")
    least = F.min(F.coalesce("label", "low")).alias("class_id")
    return rows.groupBy("doc_id").agg(least, F.min("low").alias("text_id"), F.coalesce(F.sum("links"), F.lit(0)).cast("long").alias("links"))


def _beside(df: DataFrame, few: DataFrame, on: str, how: str) -> DataFrame:
    """df joined with a table that is broadcast if it is small."""
    few = cut(few)
    return df.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, on, how)


def only(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """docs whose doc_id is (left_semi) or isn't (left_anti) the single column of ids; ids are broadcast if they are few."""
    return _beside(docs, ids.toDF("doc_id"), "doc_id", how)


def components(edges: DataFrame) -> DataFrame:
    """node and label, the lowest node that is connected with it, by least labels of neighbours and pointer jumping."""
    both = cut(edges.select(F.col("doc_a").alias("node"), F.col("doc_b").alias("other")).union(edges.select("doc_b", "doc_a")))
    labels = cut(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = lower.join(labels.select(F.col("node").alias("label"), F.col("label").alias("further")), "label", "left")
        new = cut(jump.select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = new.select("node", "label")
        if new.where("label < was").isEmpty():
            return labels


def one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that a document of lower doc_id of their class stands for."""
    members, labels, _ = _grouped(docs, threshold)
    class_id = F.coalesce("label", "low")
    gone = members.join(labels.withColumnRenamed("node", "low"), "low", "left").where(F.col("doc_id") != class_id).select("doc_id").distinct()
    out = only(docs, gone, "left_anti")
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out
    again = cut(again)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    first = out.join(again, "doc_id", "left_semi").withColumn("_tessera_rank", rank).where("_tessera_rank = 1").select(*docs.columns)
    return out.join(again, "doc_id", "left_anti").select(*docs.columns).union(first)
