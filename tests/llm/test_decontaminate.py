"""Decontamination: planted passages with substitutions are found, clean texts are left alone."""

from itertools import combinations

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate as D
from tessera.llm import text as X

DOCS, ITEMS = "doc_id long, text string, item_id long, similarity string", "item_id long, text string, doc_id long"


def _words(rng, n, prefix="w"):
    return [f"{prefix}{k}" for k in rng.integers(0, 5000, n)]


def _frames(spark, docs, items):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in docs], DOCS), spark.createDataFrame([(i, t, 2) for i, t in items], ITEMS)


def brute(docs, items):
    """{(doc, item)} whose words agree in a window at some offset, by trying every offset."""
    out = set()
    for d, t in docs:
        w = X.hash_words(t or "").tolist()
        for i, s in items:
            x = X.hash_words(s or "").tolist()
            if not x:
                continue
            width = min(len(x), D.WINDOW)
            for p in range(-len(x) + 1, len(w)):
                same = [0 <= p + j < len(w) and w[p + j] == x[j] for j in range(len(x))]
                if any(sum(same[j : j + width]) / width >= (D.MIN_EQUAL if len(x) >= D.EXACT else 1) for j in range(len(x) - width + 1)):
                    out.add((d, i))
                    break
    return out


def test_substituted_passages_are_found(spark):
    rng = np.random.default_rng(0)
    items = [(k, " ".join(_words(rng, int(n), "b"))) for k, n in enumerate(rng.integers(3, 60, 30))]
    docs = []
    for k in range(120):
        own = _words(rng, int(rng.integers(5, 150)))
        if k % 3 == 0:
            x = items[k % 30][1].split()
            for j in np.flatnonzero(rng.random(len(x)) < (0.06 if len(x) > 20 else 0.0)):
                x[j] = "changed"
            own[len(own) // 2 : len(own) // 2] = x
        docs.append((k, " ".join(own)))
    want = brute(docs, items)
    got = {(r.doc_id, r.item_id) for r in D.contaminated(*_frames(spark, docs, items)).collect()}
    assert got <= want and len(got) >= 0.95 * len(want) and len(want) >= 38
    kept = {r.doc_id for r in D.clean(*_frames(spark, docs, items)).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_every_single_substitution_is_tolerated(spark):
    rng = np.random.default_rng(1)
    x = _words(rng, 30, "b")
    docs = [(j, " ".join(["lead", "in", *x[:j], "other", *x[j + 1 :], "tail"])) for j in range(30)]
    got = D.contaminated(*_frames(spark, docs, [(5, " ".join(x))])).collect()
    assert {r.doc_id for r in got} == set(range(30))
    assert all((r.item_words, r.start_word, r.equal_words) == (30, 2, 29) for r in got)


def test_nulls_empty_long_short_and_repeated_rows(spark):
    rng = np.random.default_rng(2)
    p = " ".join(_words(rng, 20, "b"))
    long = " ".join(_words(rng, 50_000)) + " " + p
    items = [(1, p), (1, p), (2, None), (3, ""), (None, " ".join(_words(rng, 15, "c"))), (4, "short, but exact")]
    docs = [(1, p), (1, p), (2, None), (3, ""), (None, p), (4, long), (5, "this is short but exact too"), (8, "short or exact"), (6, " ".join(_words(rng, 200))), (7, items[4][1])]
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(*_frames(spark, docs, items)).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (None, 1), (4, 1), (5, 4), (7, None)], key=str)
    kept = D.clean(*_frames(spark, docs, items))
    assert {r.doc_id for r in kept.collect()} == {2, 3, 6, 8} and kept.columns == ["doc_id", "text", "item_id", "similarity"]


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a b c d e f g h i")]), ([(1, "a b c d e f g h i")], []), ([], [])):
        d, b = _frames(spark, docs, items)
        assert D.contaminated(d, b).count() == 0 and D.clean(d, b).count() == len(docs)


def test_a_large_benchmark_goes_slice_by_slice(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(k, " ".join(_words(rng, 25, "b"))) for k in range(40)]
    docs = [(k, items[k][1] + " and more") for k in range(40)]
    monkeypatch.setattr(D, "BROADCAST_CHARS", 1500)
    assert {(r.doc_id, r.item_id) for r in D.contaminated(*_frames(spark, docs, items)).collect()} == {(k, k) for k in range(40)}
    assert D.clean(*_frames(spark, docs, items)).count() == 0
    more = [*docs, (50, "clean text"), (50, "clean text"), (51, None), (None, "clean too"), (None, items[3][1])]
    kept = D.clean(*_frames(spark, more, items)).collect()
    assert sorted(map(str, [(r.doc_id, r.text) for r in kept])) == sorted(map(str, [(50, "clean text"), (50, "clean text"), (51, None), (None, "clean too")]))


def test_items_of_few_words_are_found_where_all_of_them_stand(spark):
    items = [(n, " ".join(f"s{n}x{k}" for k in range(n))) for n in range(1, 8)]
    docs = [(n, f"lead in {t}, and the rest") for n, t in items] + [(10 + n, f"lead {t.replace('x0', 'y0')} end") for n, t in items]
    assert {(r.doc_id, r.item_id) for r in D.contaminated(*_frames(spark, docs, items)).collect()} == {(n, n) for n in range(1, 8)}


def test_of_places_that_tie_the_first_is_reported():
    s = D.seeds(pa.table({"item_id": [7], "text": [" ".join(f"b{k}" for k in range(12))]}))
    words = [f"b{k}" for k in range(12)]
    text = " ".join(["x", *words, "y", *words, "z"])
    (row, item, start, equal, share), = D.matches(pa.array([text]), s)
    assert (row.tolist(), start.tolist(), equal.tolist()) == ([0], [1], [12])


def test_every_pattern_of_substitutions_that_is_a_hit_is_found():
    for n in range(D.EXACT, D.WINDOW + 4):
        item = [f"b{k}" for k in range(n)]
        width = min(n, D.WINDOW)
        docs = []
        for many in range(4):
            for at in combinations(range(n), many):
                same = [k not in at for k in range(n)]
                if any(sum(same[j : j + width]) / width >= D.MIN_EQUAL for j in range(n - width + 1)):
                    docs.append(" ".join(["lead", *(w if ok else "other" for w, ok in zip(item, same)), "tail"]))
        s = D.seeds(pa.table({"item_id": [7], "text": [" ".join(item)]}))
        found = {int(row) for rows, *_ in D.matches(pa.array(docs), s) for row in rows}
        assert found == set(range(len(docs))), n


def test_an_excerpt_of_a_longer_item_with_two_substitutions_is_found():
    item = [f"b{k}" for k in range(40)]
    s = D.seeds(pa.table({"item_id": [7], "text": [" ".join(item)]}))
    docs = []
    for at in combinations(range(D.WINDOW), 2):
        part = item[11 : 11 + D.WINDOW]
        for k in at:
            part[k] = "other"
        docs.append(" ".join(part))
    assert {int(row) for rows, *_ in D.matches(pa.array(docs), s) for row in rows} == set(range(len(docs)))
