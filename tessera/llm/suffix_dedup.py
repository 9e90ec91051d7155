"""Deduplication of repeated passages with suffix arrays that are sorted in two stages.

A passage is repeated if its LENGTH words, compared byte for byte, occur in at least two documents. All of them are
found. Every window of LENGTH words holds the anchor of its lowest GRAM-word hash (the first of equal ones), which is
the same wherever the window occurs; so anchors that occur in one document only are left, and the words around the others
are brought together by anchor. There the texts are laid end to end, each behind a separator of its own. First only the
suffixes smaller than their successors are sorted; a scan over the buckets of first words induces the order of the rest;
then adjacent suffixes whose common prefix reaches LENGTH words are repeated windows. An anchor in more than HOT places
is too much for one task: its windows are grouped by two 64-bit hashes of all their words, by an ordinary aggregation.

The occurrence of lowest doc_id, and in it the first, stays; the others are removed.

Result: doc_id, start_word, end_word (exclusive), first_doc_id (the lowest doc_id of an occurrence of some of its
windows), removed. Rows of removed and of kept words are apart.

Defined results: a null or empty text has no passages, nor has one of fewer than LENGTH words; texts of any length are
taken whole; what repeats within one document alone is no repeated passage; a null doc_id can't be named: such rows
take no part and stay as they are; rows that repeat doc_id and text are one; rows of one doc_id and differing texts are
the same document, each with its own places. Only doc_id and text are read, so other columns may clash; an empty table
gives an empty result. without_repeats() cuts removed words, with the white space after them, out of the texts, sets
n_chars where there is such a column, leaves all other columns and rows as they are, and drops a document of which
nothing but white space is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm import text as X
from tessera.plans.lineage import cut

LENGTH = 50
GRAM = 20
#: GRAM-word hashes in a window.
SPAN = LENGTH - GRAM + 1
#: Places of an anchor beyond which its windows are grouped by hash.
HOT = 20_000
#: Bytes of text that share one suffix array, about.
CHUNK_BYTES = 4 << 20
#: Sets of row keys of up to so many are broadcast to the scan of the documents; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
_SLICE = 1 << 20

_P = np.uint64(0x9E3779B97F4A7C15)


class Places:
    """The words of a slice of texts, their GRAM hashes and each window's anchor."""

    def __init__(self, text: pa.Array) -> None:
        self.words = w = X.words(text, strip=False)
        n = len(w.hash)
        self.row = np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
        m = max(0, n - GRAM + 1)
        g = np.zeros(m, np.uint64)
        for k in range(GRAM):
            g = g * _P + w.hash[k : k + m]
        self.gram = X.mix(g)
        if n < LENGTH:
            self.start = self.anchor = np.zeros(0, np.int64)
            return
        anchor = np.arange(n - LENGTH + 1) + sliding_window_view(self.gram, SPAN).argmin(1)
        self.start = np.flatnonzero(self.row[: n - LENGTH + 1] == self.row[LENGTH - 1 :])  # windows within a row
        self.anchor = anchor[self.start]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors with the first and last window of each; anchors never go back from window to window."""
        at = np.flatnonzero(np.concatenate(([True], self.anchor[1:] != self.anchor[:-1])[: len(self.anchor) + 1])) if len(self.anchor) else np.zeros(0, np.int64)
        last = np.append(at[1:], len(self.anchor)) - 1
        return self.anchor[at], self.start[at], self.start[last] if len(at) else at


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, rk, pos) of every anchor of (rk, text)."""
    for batch in batches:
        key = batch.column(0).to_numpy()
        for a, b in X.slices(batch.column(1), _SLICE):
            p = Places(batch.column(1).slice(a, b - a))
            at, _, _ = p.runs()
            row = p.row[at] if len(at) else at
            yield pa.record_batch([pa.array(p.gram[at].view(np.int64)), pa.array(key[a + row]), pa.array((at - p.words.off[row]).astype(np.int32))], names=["h", "rk", "pos"])


def _wanted(batches: Iterator[pa.RecordBatch]):
    """Of rows (doc_id, rk, text, pos, h): the places, and the row, first window and last window of the anchors asked for."""
    for batch in batches:
        text, pos, h = batch.column(2), batch.column(3), batch.column(4)
        for a, b in X.slices(text, _SLICE):
            p = Places(text.slice(a, b - a))
            at, first, last = p.runs()
            many = pc.list_value_length(pos.slice(a, b - a)).to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(b - a), many)
            want = p.words.off[row] + pos.slice(a, b - a).flatten().to_numpy()
            gram = h.slice(a, b - a).flatten().to_numpy()
            if not len(at) or not len(want):
                continue
            k = np.minimum(np.searchsorted(at, want), len(at) - 1)
            ok = (at[k] == want) & (p.gram[at[k]].view(np.int64) == gram) & (p.row[at[k]] == row)
            k, row, gram = k[ok], row[ok], gram[ok]
            yield p, gram, batch.column(0).slice(a, b - a).take(pa.array(row)), batch.column(1).slice(a, b - a).take(pa.array(row)), row, first[k], last[k]


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, gram, doc, rk, row, first, last in _wanted(batches):
        w = p.words
        begin, end = w.begin[first], w.end[last + LENGTH - 1]
        to = np.concatenate(([0], np.cumsum(end - begin)))
        data = w.data[np.repeat(begin - to[:-1], end - begin) + np.arange(to[-1])]
        words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        yield pa.record_batch([pa.array(gram), doc, rk, pa.array((first - w.off[row]).astype(np.int32)), words], names=["h", "doc_id", "rk", "start", "words"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for p, _, doc, rk, row, first, last in _wanted(batches):
        many = last - first + 1
        k = np.repeat(np.arange(len(first)), many)
        at = np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many) + first[k]
        g = [p.gram[at + d] for d in (*range(0, LENGTH - GRAM, GRAM), LENGTH - GRAM)]
        one, two = np.zeros(len(at), np.uint64), np.full(len(at), 7, np.uint64)
        for x in g:
            one, two = X.mix(one * _P + x), X.mix((two ^ x) * np.uint64(0xD1342543DE82EF95) + _P)
        yield pa.record_batch([pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), doc.take(pa.array(k)), rk.take(pa.array(k)), pa.array((at - p.words.off[row[k]]).astype(np.int32))], names=["w1", "w2", "doc_id", "rk", "start"])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """The suffixes of t (integers from 0, below 2**21 - 1) in order, sorted in two stages.

    A suffix is smaller than its successor (type S) or larger (type L); the end is smaller than all.
    """
    n = len(t)
    if n < 2:
        return np.arange(n)
    step = np.sign(np.append(t[1:], -1) - t)  # 1: the next is larger, so S
    known = np.flatnonzero(step)
    step = step[known[np.searchsorted(known, np.arange(n))]]  # equal ones go with the next that differs
    small = np.flatnonzero(step > 0)
    ordered = _sorted(t, small)
    size = np.bincount(t)
    end = np.cumsum(size)
    # in a bucket of equal first words the L stand before the S
    own = t[ordered]
    group = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])[: len(own) + 1])) if len(own) else np.zeros(0, np.int64)
    many = np.diff(np.append(group, len(own)))
    sa = np.full(n, -1, np.int64)
    if len(own):
        sa[np.arange(len(own)) - np.repeat(group + many, many) + end[own]] = ordered
    head, word, large, out = (end - size).tolist(), t.tolist(), (step < 0).tolist(), sa.tolist()
    out[head[word[n - 1]]] = n - 1  # induced by the end
    head[word[n - 1]] += 1
    for j in out:  # the list is filled while it is scanned; every place is filled before it is reached
        if j > 0 and large[j - 1]:
            c = word[j - 1]
            out[head[c]] = j - 1
            head[c] += 1
    return np.array(out)


def _sorted(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The suffixes that begin at these places, sorted by comparing three words at a time."""
    padded = np.concatenate((t.astype(np.int64) + 1, np.zeros(3, np.int64)))
    packed = (padded[:-3] << 42) | (padded[1:-2] << 21) | padded[2:-1]
    packed = np.append(packed, 0)
    n = len(t)
    key = packed[at]
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    tied = np.concatenate(([False], key[1:] == key[:-1]))  # equal to the one before it so far
    depth = 3
    while tied.any():
        member = tied.copy()
        member[:-1] |= tied[1:]
        places = np.flatnonzero(member)
        group = np.cumsum(~tied[places])
        own = at[places]
        key = packed[np.minimum(own + depth, n)]
        order = np.lexsort((key, group))
        at[places] = own[order]
        key, group = key[order], group[order]
        tied[places] = np.concatenate(([False], (key[1:] == key[:-1]) & (group[1:] == group[:-1])))
        depth += 3
    return at


def _alike(t: np.ndarray, sa: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Whether each suffix shares LENGTH first words with the one before it; left: the words left to each."""
    out = np.zeros(len(sa), bool)
    alive = np.flatnonzero((left[sa[1:]] >= LENGTH) & (left[sa[:-1]] >= LENGTH)) + 1
    for k in range(LENGTH):
        alive = alive[t[sa[alive] + k] == t[sa[alive - 1] + k]]
    out[alive] = True
    return out


def repeats(doc: np.ndarray, start: np.ndarray, words: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, start, end, first, first_doc) of the runs of repeated windows of rows that hold words from start on."""
    w = X.words(words, strip=False)
    length = np.diff(w.off)
    place = (np.arange(len(w.hash)) - np.repeat(w.off[:-1], length)).astype(np.uint64)
    one = np.add.reduceat(X.mix(w.hash + place * _P), w.off[:-1])
    two = np.add.reduceat(X.mix((w.hash ^ np.uint64(0x5851F42D4C957F2D)) + place * np.uint64(0xD1342543DE82EF95)), w.off[:-1])
    # equal texts are one, at their first place
    order = np.lexsort((start, doc, two, one))
    new = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    text_of = np.empty(len(doc), np.int64)
    text_of[order] = np.cumsum(new) - 1
    rep = order[new]
    low_doc, low_start, high_doc = doc[rep], start[rep], np.maximum.reduceat(doc[order], np.flatnonzero(new))
    # one sequence, each text behind its own separator
    n, m = length[rep], len(rep)
    base = np.concatenate(([0], np.cumsum(n + 1)))
    owner = np.repeat(np.arange(m), n + 1)
    inner = np.arange(base[-1]) - base[owner]
    t = np.empty(base[-1], np.int64)
    is_word = inner > 0
    t[~is_word] = np.arange(m)
    t[is_word] = np.unique(w.hash[(w.off[rep][owner] + inner - 1)[is_word]], return_inverse=True)[1] + m
    left = np.where(is_word, n[owner] + 1 - inner, 0)
    sa = suffix_array(t)
    same = _alike(t, sa, left)
    # classes of equal windows
    member = same.copy()
    member[:-1] |= same[1:]
    window = left >= LENGTH
    cls = np.full(len(t), -1, np.int64)
    at = sa[member]
    label = np.cumsum(~same[member]) - 1
    # windows that only equal texts share
    alone = np.ones(len(t), bool)
    alone[at] = False
    alone = np.flatnonzero(alone & window)
    at, label = np.concatenate((at, alone)), np.concatenate((label, np.arange(len(alone)) + (label[-1] + 1 if len(label) else 0)))
    own, offset = owner[at], inner[at] - 1
    d, s = low_doc[own], low_start[own] + offset
    order = np.lexsort((s, d, label))
    begin = np.flatnonzero(np.concatenate(([True], label[order][1:] != label[order][:-1]))) if len(order) else np.zeros(0, np.int64)
    if not len(begin):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    many = np.diff(np.append(begin, len(order)))
    first_doc, first_start = d[order][begin], s[order][begin]
    across = np.maximum.reduceat(high_doc[own][order], begin) > first_doc
    # per window of a distinct text: is it repeated, whose is it, and is the text's first place the first of all
    k = np.repeat(np.arange(len(begin)), many)
    at, d, s = at[order], d[order], s[order]
    cls[at] = np.where(across[k], first_doc[k], -1)
    hit = np.zeros(len(t), bool)
    hit[at] = across[k]
    lead = np.zeros(len(t), bool)
    lead[at] = across[k] & (d == first_doc[k]) & (s == first_start[k])
    out = []
    rows_of = np.argsort(text_of, kind="stable")
    rows_from = np.searchsorted(text_of[rows_of], np.arange(m + 1))
    is_rep = (doc == low_doc[text_of]) & (start == low_start[text_of])
    for flag in (True, False):  # runs at a text's first place, and at all its others
        kind = lead.astype(np.int64) if flag else np.zeros(len(t), np.int64)
        head = hit.copy()
        head[1:] &= ~(hit[:-1] & (kind[1:] == kind[:-1]) & (owner[1:] == owner[:-1]) & (cls[1:] == cls[:-1]))
        begin = np.flatnonzero(head)
        if not len(begin):
            continue
        run = np.cumsum(head) - 1
        size = np.bincount(run[hit], minlength=len(begin))
        text = owner[begin]
        many = rows_from[text + 1] - rows_from[text]
        r = np.repeat(np.arange(len(begin)), many)
        row = rows_of[np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many) + rows_from[text[r]]]
        ok = is_rep[row] == flag
        r, row = r[ok], row[ok]
        from_ = start[row] + inner[begin[r]] - 1
        out.append((row, from_, from_ + size[r] + LENGTH - 1, kind[begin[r]], cls[begin[r]]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else tuple(np.zeros(0, np.int64) for _ in range(5))


def _by_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs of (h, doc_id, rk, start, words), which come sorted by h."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, (None,)):
        if batch is not None:
            held.append(batch)
            if sum(b.nbytes for b in held) < CHUNK_BYTES:
                continue
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            continue
        h = table.column("h").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        upto = int(starts[-1]) if batch is not None else len(h)  # the last anchor may go on in the next batch
        part, held = table.slice(0, upto), [x for x in table.slice(upto).to_batches() if x.num_rows]
        # chunks of whole anchors
        cuts, size = [0], np.concatenate(([0], np.cumsum(pc.binary_length(part.column("words")).to_numpy().astype(np.int64))))
        for s in [*starts[starts < upto], upto]:
            if size[s] - size[cuts[-1]] >= CHUNK_BYTES or s == upto:
                cuts.append(int(s))
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            one = part.slice(a, b - a).combine_chunks()
            words = one.column("words").combine_chunks()
            if isinstance(words, pa.ChunkedArray):
                words = pa.concat_arrays(words.chunks)
            row, start, end, first, first_doc = repeats(one.column("doc_id").to_numpy(), one.column("start").to_numpy().astype(np.int64), words.cast(pa.string()))
            take = lambda c: pa.array(one.column(c).to_numpy()[row])  # noqa: E731, B023
            yield pa.record_batch([take("doc_id"), take("rk"), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(first.astype(bool)), pa.array(first_doc)], names=["doc_id", "rk", "start", "end", "first", "first_doc_id"])


def _keyed(docs: DataFrame) -> DataFrame:
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return slim.select("doc_id", F.xxhash64("doc_id", "text").alias("rk"), "text")


def _around(keyed: DataFrame, places: DataFrame) -> DataFrame:
    """doc_id, rk, text and the lists pos and h of the rows that have places (h, rk, pos)."""
    lists = cut(places.groupBy("rk").agg(F.collect_set(F.struct("pos", "h")).alias("at")).select("rk", "at.pos", "at.h"))
    ids = lists.select("rk")
    if ids.count() <= BROADCAST_ROWS:
        keyed = keyed.join(F.broadcast(ids), "rk", "left_semi")
    return keyed.join(lists, "rk").select("doc_id", "rk", "text", "pos", "h")


def _runs(docs: DataFrame, hot: int) -> DataFrame:
    """doc_id, rk, start, end, first, first_doc_id: runs of repeated windows, some of which touch or overlap."""
    keyed = _keyed(docs)
    anchors = keyed.select("rk", "text").mapInArrow(_anchors, "h long, rk long, pos int")
    # counted first, so that an anchor of any number of places is many rows of a join and no task's own
    often = anchors.groupBy("h").agg(F.min("rk").alias("low"), F.max("rk").alias("high"), F.count("*").alias("n")).where("low < high").select("h", "n")
    shared = cut(anchors.join(often, "h"))
    snippets = _around(keyed, shared.where(F.col("n") <= hot)).mapInArrow(_snippets, "h long, doc_id long, rk long, start int, words binary")
    schema = "doc_id long, rk long, start int, end int, first boolean, first_doc_id long"
    runs = snippets.repartition("h").sortWithinPartitions("h").mapInArrow(_by_suffixes, schema)
    beyond = shared.where(F.col("n") > hot)
    if beyond.isEmpty():
        return runs
    windows = _around(keyed, beyond).mapInArrow(_windows, "w1 long, w2 long, doc_id long, rk long, start int").distinct()
    windows = cut(windows)
    first = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc_id", "start")).alias("low"), F.max("doc_id").alias("high")).where("low.doc_id < high")
    seen = windows.join(first, ["w1", "w2"])
    return runs.unionByName(seen.selectExpr("doc_id", "rk", "start", f"start + {LENGTH} AS end", "doc_id = low.doc_id AND start = low.start AS first", "low.doc_id AS first_doc_id"))


def _spans(docs: DataFrame, hot: int) -> DataFrame:
    """Repeated passages: runs that touch or overlap are one; kept and removed ones are apart."""
    by = ["doc_id", "rk", "first"]
    order = Window.partitionBy(*by).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = _runs(docs, hot).withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(order))
    return islands.groupBy(*by, "island").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("first_doc_id").alias("first_doc_id")).select("doc_id", "rk", "start_word", "end_word", "first_doc_id", (~F.col("first")).alias("removed"))


def passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """The result that the module describes."""
    return _spans(docs, hot).drop("rk").distinct()


def _cut(text: pa.Array, begins: pa.Array, ends: pa.Array) -> list[str | None]:
    """Each text without its words [begin, end)."""
    out: list[str | None] = []
    for k in range(len(text)):
        w = X.words(text.slice(k, 1), strip=False)
        keep = np.ones(len(w.data), bool)
        for b, e in zip(begins[k].as_py(), ends[k].as_py()):
            if b < len(w.begin):
                keep[w.begin[b] : w.begin[e] if e < len(w.begin) else len(w.data)] = False
        out.append(w.data[keep].tobytes().decode())
    return out


def without_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs without the passages that an earlier occurrence stands for."""
    spans = cut(_spans(docs, hot).where("removed").groupBy("rk").agg(F.collect_list("start_word").alias("_tessera_begins"), F.collect_list("end_word").alias("_tessera_ends")).withColumnRenamed("rk", "_tessera_rk"))
    key = F.when(F.col("doc_id").isNotNull() & F.col("text").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    rows = docs.withColumn("_tessera_rk", key)
    ids = spans.select("_tessera_rk")
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    rest = rows.join(ids, "_tessera_rk", "left_anti").select(*docs.columns)
    at = docs.columns.index("text")
    size = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-2]
            text = pa.array(_cut(batch.column(at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)), pa.string())
            columns[at] = text
            if size is not None:
                columns[size] = pc.utf8_length(text).cast(columns[size].type)
            left = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(text)), 0)
            yield pa.record_batch(columns, names=batch.schema.names[:-2]).filter(left)

    affected = rows.join(ids, "_tessera_rk", "left_semi").join(spans, "_tessera_rk").select(*docs.columns, "_tessera_begins", "_tessera_ends")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])
    return rest.unionByName(affected.mapInArrow(shorten, schema))


def oracle_sql() -> str:
    """All windows of LENGTH words by their text, in DuckDB."""
    return f"""
WITH d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, text, s, md5(array_to_string(w[s + 1:s + {LENGTH}], ' ')) AS k FROM (SELECT doc_id, text, w, unnest(range(len(w) - {LENGTH - 1})) AS s FROM d WHERE len(w) >= {LENGTH})),
g AS (SELECT k, min(doc_id) AS low FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)),
f AS (SELECT k, min(s) AS low_start FROM p JOIN g USING (k) WHERE doc_id = low GROUP BY k),
h AS (SELECT doc_id, text, s, low, NOT (doc_id = low AND s = low_start) AS removed FROM p JOIN g USING (k) JOIN f USING (k)),
i AS (SELECT *, CASE WHEN s <= {LENGTH} + lag(s) OVER (PARTITION BY doc_id, text, removed ORDER BY s) THEN 0 ELSE 1 END AS new FROM h),
j AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, text, removed ORDER BY s) AS island FROM i)
SELECT DISTINCT doc_id, CAST(start_word AS INTEGER) AS start_word, CAST(end_word AS INTEGER) AS end_word, first_doc_id, removed
FROM (SELECT doc_id, text, removed, island, min(s) AS start_word, max(s) + {LENGTH} AS end_word, min(low) AS first_doc_id FROM j GROUP BY doc_id, text, removed, island)"""
