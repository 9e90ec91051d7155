"""Suffix-array deduplication against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """{(doc_id, start, end, first_doc_id, removed)} by a dictionary of all windows."""
    seen = defaultdict(set)
    texts = {(d, t) for d, t in rows if d is not None and t is not None}
    for d, t in texts:
        w = t.split()
        for s in range(len(w) - S.LENGTH + 1):
            seen[tuple(w[s : s + S.LENGTH])].add((d, s))
    out = set()
    for d, t in texts:
        w = t.split()
        marks = {True: [], False: []}
        for s in range(len(w) - S.LENGTH + 1):
            places = seen[tuple(w[s : s + S.LENGTH])]
            if len({x for x, _ in places}) > 1:
                marks[min(places) != (d, s)].append((s, min(places)[0]))
        for removed, found in marks.items():
            spans = []
            for s, first in found:
                if spans and s <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], s + S.LENGTH, min(spans[-1][2], first))
                else:
                    spans.append((s, s + S.LENGTH, first))
            out |= {(d, *x, removed) for x in spans}
    return out


def corpus(seed=0, docs=60, vocabulary=400):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    text = lambda n: [words[k] for k in rng.integers(0, vocabulary, n)]
    shared = [text(int(n)) for n in (49, 50, 51, 80, 130, 200)]
    rows = []
    for d in range(docs):
        parts = text(int(rng.integers(0, 120)))
        for k in rng.integers(0, len(shared), rng.integers(0, 3)):
            parts = parts + shared[k] + text(int(rng.integers(0, 60)))
        rows.append((d, " ".join(parts)))
    rows.append((docs, " ".join(shared[4] + shared[4])))  # twice in one document
    rows.append((docs + 1, " ".join(["again"] * 300)))  # a repeated line of one document
    rows.append((docs + 2, rows[3][1]))  # exact copies
    rows.append((docs + 3, rows[3][1]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], SCHEMA)


def test_suffix_array_is_the_sorted_suffixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 400):
        for letters in (1, 2, 5):
            t = rng.integers(0, letters, n)
            assert S.suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("hot", [S.HOT, 3, 0])
def test_passages_are_those_of_brute_force(spark, hot):
    rows = corpus()
    got = {tuple(r) for r in S.passages(frame(spark, rows), hot).collect()}
    assert got == brute(rows)
    assert got


def test_nulls_empty_long_and_repeated_rows(spark):
    rng = np.random.default_rng(5)
    long = " ".join(f"x{k}" for k in rng.integers(0, 10**6, 60_000))
    rows = [(None, long), (1, None), (2, ""), (3, " \n "), (4, long), (4, long), (5, "a " + long), (6, long[:40])]
    got = {tuple(r) for r in S.passages(frame(spark, rows)).collect()}
    assert got == brute(rows)
    docs = frame(spark, rows).withColumn("h", F.lit(1)).withColumn("start", F.lit(2))
    out = S.without_repeats(docs)
    assert out.columns == docs.columns
    kept = {(r.doc_id, r.text) for r in out.collect()}
    assert kept == {(None, long), (1, None), (2, ""), (3, " \n "), (4, long), (5, "a "), (6, long[:40])}


def test_one_doc_id_with_two_texts_is_one_document(spark):
    p = " ".join(f"p{k}" for k in range(60))
    rows = [(1, "a " + p), (1, "b " + p)]
    assert S.passages(frame(spark, rows)).count() == 0
    rows.append((2, p))
    got = {tuple(r) for r in S.passages(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_cutting_leaves_one_copy(spark):
    rows = corpus(2)
    docs = frame(spark, rows)
    out = S.without_repeats(docs)
    assert out.schema.names == docs.schema.names
    after = [(r.doc_id, r.text) for r in out.collect()]
    assert all(r.n_chars == len(r.text) for r in out.collect())
    removed = defaultdict(list)
    for d, s, e, _, gone in brute(rows):
        if gone:
            removed[d].append((s, e))
    want = {}
    for d, t in rows:
        w = t.split()
        left = [x for k, x in enumerate(w) if not any(s <= k < e for s, e in removed[d])]
        if left or not removed[d]:
            want[d] = left
    assert {d: t.split() for d, t in after} == want


def test_empty_table(spark):
    docs = frame(spark, [])
    assert S.passages(docs).count() == 0
    assert S.without_repeats(docs).count() == 0


def test_snippets_share_a_suffix_array_across_anchors():
    doc, start, words = np.array([1, 2, 3]), np.array([0, 5, 9]), pa.array([" ".join(f"a{k}" for k in range(60))] * 2 + [" ".join(f"b{k}" for k in range(60))])
    row, s, e, first, of = S.repeats(doc, start, words)
    assert sorted(zip(row.tolist(), s.tolist(), e.tolist(), first.tolist(), of.tolist())) == [(0, 0, 60, 1, 1), (1, 5, 65, 0, 1)]


def test_passages_are_those_of_the_sql(spark):
    import duckdb

    for rows in (corpus(7), None):
        docs = frame(spark, rows) if rows else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
        con = duckdb.connect()
        con.register("documents", docs.toPandas())
        want = con.execute(S.oracle_sql())
        columns = [d[0] for d in want.description]
        assert sorted(map(tuple, S.passages(docs).select(*columns).collect())) == sorted(want.fetchall())


def test_columns_of_any_name_stay(spark):
    p = " ".join(f"p{k}" for k in range(60))
    docs = frame(spark, [(1, "a " + p), (2, p + " b")]).withColumn("_rk", F.lit(5)).withColumn("rk", F.lit("x")).withColumn("h", F.lit(1.5))
    assert sorted((r.doc_id, r.text, r._rk, r.rk, r.h) for r in S.without_repeats(docs).collect()) == [(1, "a " + p, 5, "x", 1.5), (2, "b", 5, "x", 1.5)]
