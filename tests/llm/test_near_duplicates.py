"""The n-gram Jaccard join against brute force over all pairs."""

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import near_duplicates as N
from tessera.llm import text as X

SCHEMA = "doc_id long, text string, node string, band int"


def grams(text):
    w = X.hash_words(text).tolist()
    return {tuple(w[i : i + N.NGRAM]) for i in range(len(w) - N.NGRAM + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold=N.THRESHOLD):
    out = {}
    sets = [(d, grams(t)) for d, t in rows if d is not None and t is not None]
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y:
            j = len(x & y) / len(x | y)
            if j >= threshold:
                key = (min(a, b), max(a, b))
                out[key] = max(out.get(key, 0), j)
    return out


def closure(rows, pairs):
    group = {d: d for d, _ in rows if d is not None}
    for _ in rows:
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    return group


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    text = lambda n: [f"w{k}" for k in rng.integers(0, 3000, n)]
    rows = []
    for _ in range(25):
        base = text(int(rng.integers(30, 200)))
        rows.append(base)
        for share in rng.choice([0.0, 0.01, 0.03, 0.08, 0.3], int(rng.integers(0, 4))):
            copy = list(base)
            for k in np.flatnonzero(rng.random(len(copy)) < share):
                copy[k] = f"n{rng.integers(10**6)}"
            rows.append(copy)
    return [(k, " ".join(r)) for k, r in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)


def result(spark, rows, threshold=N.THRESHOLD):
    got = N.classes(frame(spark, rows), threshold).collect()
    assert len({r.doc_id for r in got}) == len(got)
    return {r.doc_id: (r.class_id, r.text_id, r.links) for r in got}


def wanted(rows, threshold=N.THRESHOLD):
    """The same by brute force; of documents of one text each."""
    want = brute(rows, threshold)
    group, words = closure(rows, want), {d: tuple(X.hash_words(t or "").tolist()) for d, t in rows}
    first = {}
    for d in sorted(words):
        first.setdefault(words[d], d)
    out = {}
    for d in group:
        if any(d in p for p in want):
            near = {words[y if x == d else x] for x, y in want if d in (x, y)}
            out[d] = (group[d], first[words[d]], len(near - {words[d]}))
    return out


def test_recall_and_exactness(spark):
    rows = corpus()
    got, want = result(spark, rows), wanted(rows)
    assert set(got) <= set(want) and len(got) >= 0.95 * len(want)
    assert all(got[d][2] <= want[d][2] and got[d][1] == want[d][1] for d in got)
    assert sum(x[2] for x in got.values()) >= 0.9 * sum(x[2] for x in want.values()) > 0
    sure = wanted(rows, 0.65)
    assert all(got[d][0] <= sure[d][0] and got[d][2] >= sure[d][2] for d in sure)


def test_thousands_of_near_copies_lose_no_link(spark, monkeypatch):
    """A band of 3,000 different texts is cut into blocks; each text is linked with all others."""
    rng = np.random.default_rng(4)
    base = [f"b{k}" for k in range(300)]
    rows = [(k, " ".join([*base[: (at := int(rng.integers(0, 300)))], f"n{k}", *base[at + 1 :]])) for k in range(3000)]
    monkeypatch.setattr(N, "BLOCK", 256)
    homes = N._blocks(_nodes(spark, rows)).groupBy("label", "part").count().collect()
    assert max(r["count"] for r in homes) < 2 * 256
    got = result(spark, rows)
    assert got == {k: (0, k, 2999) for k in range(3000)}


def _nodes(spark, rows):
    sketches = N._slim(frame(spark, rows)).mapInArrow(N._sketch, "doc_id long, node long, h2 long, size long, sig binary")
    return sketches.selectExpr("node", "size", "sig", "doc_id AS low")


def families(rng, several, size, share):
    """Texts of families, each of so many copies of one text in which that share of the words is another."""
    rows = []
    for f in range(several):
        base = [f"f{f}w{k}" for k in range(120)]
        for _ in range(size):
            copy = list(base)
            for k in np.flatnonzero(rng.random(len(copy)) < share):
                copy[k] = f"n{rng.integers(10**9)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def copies(homes):
    """How many rows go to the cells of blocks, and the blocks' sizes."""
    sizes, touching = Counter((r.label, r.part) for r in homes), {}
    for r in homes:
        for band in r.bands:
            touching.setdefault(band, set()).add((r.label, r.part))
    cells = {p for blocks in touching.values() for p in combinations(sorted(blocks), 2)}
    return sum(sizes[a] + sizes[b] for a, b in cells) + sum(n for n in sizes.values() if n > 1), sizes


def test_a_family_of_copies_is_sent_once_however_many_bands_it_has(spark):
    """Were each lowest band a block, a family would be sent once for every pair of its bands."""
    rows = families(np.random.default_rng(9), 12, 60, 0.07)
    homes = N._blocks(_nodes(spark, rows)).collect()
    sent, sizes = copies(homes)
    assert len(homes) > 0.95 * len(rows) and sent < 1.3 * len(homes) and len(sizes) < 3 * 12


def test_blocks_that_were_brought_together_are_cut_again_and_lose_no_link(spark, monkeypatch):
    """Of two families that are larger than a block, every pair that shares a band and isn't pruned is linked."""
    monkeypatch.setattr(N, "BLOCK", 32)
    rows = families(np.random.default_rng(3), 2, 150, 0.05)
    homes = sorted(N._blocks(_nodes(spark, rows)).collect(), key=lambda r: r.low)
    sizes = copies(homes)[1]
    assert max(sizes.values()) < 2 * 32 and len(sizes) < 3 * len(homes) / 32
    near = brute(rows)
    a, b = np.array([(x, y) for x, y in combinations(range(len(homes)), 2) if (homes[x].low, homes[y].low) in near and not {*homes[x].bands}.isdisjoint(homes[y].bands)]).T
    left = N.survives(N.in_steps(np.stack([np.frombuffer(r.sig, np.uint16) for r in homes])), a, b)
    assert left.mean() > 0.99
    sure = Counter(homes[x].low for x in np.concatenate((a[left], b[left])))
    got, want = result(spark, rows), wanted(rows)
    assert got.keys() == want.keys() and all(got[d][:2] == want[d][:2] and sure[d] <= got[d][2] <= want[d][2] for d in want)


def test_either_way_of_counting_gives_what_sets_have_in_common():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, int(n))) for n in rng.integers(1, 80, 40)]
    off = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    for a, b in (np.triu_indices(40, 1), (np.array([0, 3]), np.array([5, 9]))):
        got = N._common(np.concatenate(sets), off, a, b)
        assert got.tolist() == [len(np.intersect1d(sets[x], sets[y])) for x, y in zip(a, b)]


def test_pruning_keeps_what_may_reach_the_threshold():
    rng = np.random.default_rng(1)
    n = N.BANDS * N.ROWS
    for j, least, most in ((0.7, 0.99, 1), (0.5, 0.95, 1), (0.15, 0, 0.01)):
        a = rng.integers(0, 60000, (2000, n)).astype(np.uint16)
        b = np.where(rng.random((2000, n)) < j, a, a + 1).astype(np.uint16)
        assert least <= N.survives(N.in_steps(np.concatenate((a, b))), np.arange(2000), np.arange(2000, 4000)).mean() <= most


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    values = N.signatures(np.concatenate((base[:3000], base[1000:])), np.array([0, 3000, 6000]))
    assert abs((values[0] == values[1]).mean() - 0.5) < 0.12


def test_nulls_empty_short_repeated_and_equal_rows(spark):
    long = " ".join(f"v{k}" for k in range(40_000))
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "A  b, c d!"), (4, None), (5, ""), (6, "   "), (None, "a b c d"), (7, "one two"), (8, "one two"), (9, long), (10, long + " end"), (11, "a b c d"), (11, "a b c d"), (12, "?!"), (13, "?!")]
    assert result(spark, rows) == {1: (1, 1, 0), 2: (1, 1, 0), 3: (1, 1, 0), 11: (1, 1, 0), 7: (7, 7, 0), 8: (7, 7, 0), 9: (9, 9, 1), 10: (9, 10, 1)}
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in N.one_of_each_group(frame(spark, rows)).collect()), key=str)
    assert [d for none, d, _ in left if not none] == [1, 12, 13, 4, 5, 6, 7, 9] and sum(none for none, *_ in left) == 1


def test_groups_are_connected_components(spark):
    chain = [list("abcdefghijklmnopqrst")]
    for k in range(6):
        chain.append(chain[-1][2:] + [f"x{k}", f"y{k}"])
    rows = [(9 - k, " ".join(c)) for k, c in enumerate(chain)] + [(50, "quite another text of its own words")]
    left = {r.doc_id for r in N.one_of_each_group(frame(spark, rows)).collect()}
    groups = closure(rows, brute(rows))
    assert left == set(groups.values())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "only one text is here")]])
def test_empty_tables(spark, rows):
    docs = frame(spark, rows)
    assert N.classes(docs).count() == 0
    out = N.one_of_each_group(docs)
    assert out.columns == docs.columns and out.count() == len(rows)


def test_a_document_of_several_texts_is_in_one_class(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(1, a), (2, a + " end"), (3, b), (4, b + " end"), (4, a), (5, "else and other words"), (5, "something of its own here")]
    assert result(spark, rows) == {1: (1, 1, 1), 2: (1, 2, 1), 3: (1, 3, 1), 4: (1, 1, 2)}
    left = {(r.doc_id, r.text) for r in N.one_of_each_group(frame(spark, rows)).collect()}
    assert left == {(1, a), (5, "else and other words")}


def test_cells_are_whole_across_batches_and_repeated_rows_are_one():
    n = 7
    table = pa.table({"label_a": [1, 1, 1, 1, 2, 2, 3], "part_a": [0] * n, "label_b": [1, 1, 1, 1, 3, 3, 3], "part_b": [0] * n, "side": [0, 0, 0, 0, 0, 1, 0], "node": [4, 5, 5, 6, 7, 8, 9]})
    for size in (1, 2, 3, 7):
        got = [(t.column("node").to_pylist()[x:y]) for t, cells in N._whole_cells(iter(table.to_batches(size))) for x, y in zip(cells, cells[1:])]
        assert got == [[4, 5, 6], [7, 8], [9]]
