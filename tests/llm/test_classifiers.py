"""Quality classifier and toxicity: held-out accuracy, brute-force features, defined results."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import quality_classifier as Q
from tessera.llm import text as X
from tessera.llm import toxicity as T

SF = "/root/testdata/sf0.1"
DOCS = "doc_id long, text string, quality string, toxic string, p_toxic int"
LABELS = "doc_id long, quality int, toxic int, text int"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_labels(real):
    docs, labels = real
    test = {r.doc_id: r.quality for r in labels.collect() if r.doc_id % 4 == 0}
    out = {r.doc_id: r.quality_probability for r in Q.scored(docs, labels.where("doc_id % 4 <> 0"), keep=0.0).collect()}
    y = np.array([test[d] for d in test if d in out])
    p = np.array([out[d] for d in test if d in out])
    assert ((p >= 0.5) == y).mean() > 0.95
    assert (p[y == 1] >= Q.KEEP).mean() > 0.98  # clean documents stay
    bins = np.digitize(p, [0.2, 0.8])
    assert all(abs(p[bins == b].mean() - y[bins == b].mean()) < 0.12 for b in (0, 2) if (bins == b).sum() > 30)


def test_toxicity_on_held_out_labels(real):
    docs, labels = real
    test = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id % 4 == 0}
    found = {r.doc_id for r in T.flagged(docs, labels.where("doc_id % 4 <> 0")).collect()}
    y = np.array([test[d] for d in test])
    p = np.array([d in found for d in test])
    assert (p & (y == 1)).sum() >= 0.95 * (y == 1).sum()
    assert (p & (y == 0)).sum() <= 0.01 * (y == 0).sum()


def test_context_vectors_are_those_of_brute_force(spark):
    texts = ["one Two three.", "four one", None, "", "one one"]
    docs = spark.createDataFrame([(k, t, "x", "y", 1) for k, t in enumerate(texts)], DOCS)
    want = np.zeros((Q.BUCKETS, Q.DIM))
    for t in texts:
        ids, _ = Q.stream(pa.array([t or ""]))
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2 * Q.WINDOW), min(len(ids), i + 2 * Q.WINDOW + 1)):
                if i != j:
                    for k in range(Q.NONZERO):
                        want[a, Q._PLACE[ids[j], k]] += Q._SIGN[ids[j], k]
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    want = np.divide(want, norm, out=np.zeros_like(want), where=norm > 0)
    assert np.allclose(Q.word_vectors(docs), want, atol=1e-5)


def test_index_vectors_are_sparse_and_all_different():
    assert all(len(set(p)) == Q.NONZERO for p in Q._PLACE[:2000].tolist())
    full = np.zeros((Q.BUCKETS, Q.DIM), np.int8)
    np.put_along_axis(full, Q._PLACE, Q._SIGN.astype(np.int8), 1)
    assert len(np.unique(full, axis=0)) == Q.BUCKETS


def test_pooling_is_that_of_brute_force():
    vectors = np.random.default_rng(0).normal(size=(Q.BUCKETS, Q.DIM)).astype(np.float32)
    texts = ["a b c d", "", "single", None, "x y", " ".join(f"w{k % 700}" for k in range(3000)), "after it"]
    got = Q.pooled(pa.array(texts), vectors)
    for k, t in enumerate(texts):
        ids, _ = Q.stream(pa.array([t or ""]))
        if not len(ids):
            assert not got[k].any()
            continue
        v = vectors[ids]
        step = [np.abs(v[i] - v[i - 2])[: Q.STEPS] for i in range(2, len(v))]
        assert np.allclose(got[k, : Q.DIM], v.astype(float).mean(0), atol=1e-4)
        assert np.allclose(got[k, Q.DIM : -1], np.mean(step, axis=0) if step else 0, atol=1e-4)


def test_the_network_learns_and_is_calibrated():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 6))
    y = (rng.random(4000) < 1 / (1 + np.exp(-4 * x[:, 0] * x[:, 1]))).astype(float)
    x[:, -1] = 1
    w = Q.fit(x[:3000], y[:3000])
    p = Q.probability(x[3000:], w)
    assert ((p > 0.5) == y[3000:]).mean() > 0.75
    assert abs(p.mean() - y[3000:].mean()) < 0.06


def test_the_chain_uses_earlier_categories():
    rng = np.random.default_rng(2)
    n = 1200
    row, column = np.nonzero(rng.random((n, 8)) < 0.5)
    x = T.Sparse(row, column, np.ones(len(row)), n, 8, np.ones((n, 1)))
    has = np.zeros((n, 8), bool)
    has[row, column] = True
    y = np.column_stack((has[:, 0], has[:, 0] & has[:, 1])).astype(float)
    models, out = T.fit_chain(x, y)
    assert [len(m) for m in models] == [9, 10]
    assert ((out > 0) == y).mean() > 0.97
    assert ((T.predict_chain(x, models) > 0) == y).mean() > 0.97


def test_telling_features_and_threshold_are_those_of_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [" ".join([*(f"w{k}" for k in rng.integers(0, 40, 12)), *(["vile"] if k % 4 == 0 and rng.random() < 0.9 else []), *(["été"] if k % 3 else [])]) for k in range(300)]
    y = np.array([[k % 2, k % 4 == 0] for k in range(300)], bool)
    sets = []
    for t in texts:
        row, feature = T.features(pa.array([t]))
        sets.append(set(feature.tolist()))
    monkeypatch.setattr(T, "FEATURES", 10)
    want = set()
    for label in y.T:
        g = {}
        for f in set().union(*sets):
            a, b = sum(f in s for s, x in zip(sets, label) if x), sum(f in s for s, x in zip(sets, label) if not x)
            if a + b >= 2:
                e = (a + b) * label.mean()
                g[f] = a * np.log(max(a, 0.5) / e) + b * np.log(max(b, 0.5) / (a + b - e))
        want |= set(sorted(g, key=lambda f: (-round(g[f], 9), f))[:10])
    got = T.fit(pa.array(texts), y)
    assert set(np.flatnonzero(got["index"] >= 0).tolist()) == want
    odds = np.round(rng.normal(size=300), 1) + y[:, 1]
    threshold, f1 = T.best_threshold(odds, y[:, 1])
    f = lambda x: 2 * ((odds >= x) & y[:, 1]).sum() / ((odds >= x).sum() + y[:, 1].sum())
    assert abs(f(threshold) - f1) < 1e-12 and f1 >= max(f(x) for x in odds) - 1e-12


def test_the_categories_are_the_label_columns(spark):
    labels = spark.createDataFrame([(1, 1, 0, 0, "note")], "doc_id long, toxic int, threat int, insult int, by string")
    assert T.categories(labels) == ["threat", "insult", "toxic"]
    rows = [(k, " ".join(["plain words", *(["fool"] if k % 4 == 1 else []), *(["die now"] if k % 4 == 2 else []), f"n{k}"]), "q", "t", 1) for k in range(240)]
    given = spark.createDataFrame([(k, int(k % 4 in (1, 2)), int(k % 4 == 2), int(k % 4 == 1)) for k in range(200)], "doc_id long, toxic int, threat int, insult int")
    got = T.flagged(spark.createDataFrame(rows, DOCS), given).collect()
    assert {r.doc_id for r in got} == {k for k in range(240) if k % 4 in (1, 2)}
    assert all((r.p_threat > 0.5) == (r.doc_id % 4 == 2) and (r.p_insult > 0.5) == (r.doc_id % 4 == 1) for r in got)


def test_beginnings_end_with_a_letter():
    w = X.words(pa.array(["abcé éééé a"]))
    same = X.words(pa.array(["abc ééa ab"]))
    assert X.beginnings(w, 4)[0] == X.beginnings(same, 4)[0] and X.beginnings(w, 5)[1] == X.beginnings(X.words(pa.array(["éé"])), 5)[0]


@pytest.mark.parametrize("labels", [[], [(1, 1, 0, 5)], [(99, 1, 1, 5)]])
def test_without_both_kinds_of_label(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "q", "t", 1), (2, None, "q", "t", 1), (3, "", "q", "t", 1)], DOCS)
    given = spark.createDataFrame(labels, LABELS)
    assert T.flagged(docs, given).count() == 0
    assert {(r.doc_id, r.quality_probability) for r in Q.scored(docs, given).collect()} == {(1, None), (2, None), (3, None)}
    assert Q.kept(docs, given).columns == docs.columns


def test_nulls_empty_long_and_repeated_rows(spark):
    good, bad = "The king went home. The land was glad of it and so was he.", "BUY!!! now $$$ @@@ ### !!! 000"
    rows = [(k, (good if k % 2 else bad) + f" n{k}", "q", "t", 1) for k in range(200)]
    rows += [(None, good, "q", "t", 1), (300, None, "q", "t", 1), (301, "", "q", "t", 1), (302, good * 3000, "q", "t", 1), (303, good, "q", "t", 1), (303, good, "q", "t", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(k, k % 2, (k + 1) % 2, 0) for k in range(200)] + [(None, 1, 1, 0), (5, None, None, 0), (301, 1, 1, 0)], LABELS)
    kept = sorted(((r.doc_id is None, r.doc_id or 0) for r in Q.kept(docs, labels).collect()))
    assert kept == [(False, k) for k in range(1, 200, 2)] + [(False, 302), (False, 303), (False, 303), (True, 0)]
    assert {r.doc_id for r in Q.scored(docs, labels, keep=0.0).collect() if r.quality_probability == 0} >= {300, 301}
    assert {r.doc_id for r in T.flagged(docs, labels).collect()} == set(range(0, 200, 2))


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert Q.scored(docs, labels).count() == Q.kept(docs, labels).count() == T.flagged(docs, labels).count() == 0


def test_words_are_hashed_alike_wherever_they_stand():
    long = "x" * 40
    w = X.words(pa.array([f"Ab, {long} cd", f"AB {long}"]))
    assert w.hash[0] == w.hash[3] and w.hash[1] == w.hash[4] and len(set(w.hash.tolist())) == 3
