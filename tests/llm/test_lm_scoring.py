"""The hashed maximum-entropy model against brute force, numeric gradients and held-out text."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import lm_scoring as L
from tessera.llm import text as X

SCHEMA = "doc_id long, text string, word int, id long"
BITS = 12


def _words(texts, bits=BITS):
    w = X.words(pa.array(texts, pa.string()))
    return L.ids(w, bits), np.repeat(np.arange(len(texts)), np.diff(w.off))


def _vocabulary(word, bits=BITS):
    return L.vocabulary(np.bincount(word, minlength=1 << bits))


def _table(rows=64, seed=0):
    return np.random.default_rng(seed).normal(0, 0.5, (rows, L.BRANCH)).astype(np.float32)


def _way(v, x):
    """(class, member) pairs from the first level to the leaf of a word, one by one."""
    level, home, member = (int(k) for k in L.leaves(v.leaf[x]))
    out = [(int(v.first[level - 1]) + home, member)]
    while level > 1:
        level -= 1
        out.append((int(v.first[level - 1]) + home // L.LEAVES, L.LEAVES + home % L.LEAVES))
        home //= L.LEAVES
    return out[::-1]


def _brute(v, table, f, x):
    scorer, total = L.Scorer(v, table), 0.0
    for k, (cls, member) in enumerate(_way(v, x)):
        rows = [int(r[0]) for r in scorer.rows(f[:, None], np.array([cls]), k < L.WIDE)]
        z = v.base[cls].astype(float) + sum(table[r].astype(float) for r in rows)
        total += z[member] - math.log(np.exp(z).sum())
    return total


def _many(n=3000):
    return [" ".join(f"w{int(k)}" for k in np.random.default_rng(5).zipf(1.1, n) % 900)]


def test_probabilities_are_those_of_brute_force():
    word, row = _words([*_many(), "b c a"])
    v, table = _vocabulary(word), _table()
    assert len(v.first) >= 4
    got, f = L.Scorer(v, table).log_probabilities(word, row), L.features(word, row)
    for k in range(0, len(word), 7):
        assert abs(got[k] - _brute(v, table, f[:, k], word[k])) < 1e-3


def test_each_word_has_a_leaf_and_all_probabilities_sum_to_one():
    word, row = _words(_many())
    v, table = _vocabulary(word), _table()
    seen = np.unique(word)
    unseen = np.setdiff1d(np.arange(1 << BITS), seen)
    assert len(set(v.leaf[seen].tolist())) == len(seen)
    f = L.features(word, row)[:, 3]
    assert abs(sum(math.exp(_brute(v, table, f, x)) for x in [*seen, unseen[0]]) - 1) < 1e-4
    counts = np.bincount(word)
    flat = L.Scorer(v, np.zeros_like(table)).log_probabilities(word, row)
    assert np.allclose(flat, np.log(counts[word] / (len(word) + 1)), atol=1e-4)


def test_context_stays_within_a_document():
    f = L.features(*_words(["a b c", "a b c"]))
    assert (f[:, :3] == f[:, 3:]).all()


def test_gradient_is_the_numeric_one_and_a_step_follows_it():
    word, row = _words(["a b c a b", "c a", "b b c d e f g h i j k l m n o p q r s t u v w x y z a b"])
    v, table = _vocabulary(word), _table(16)
    sums = L.no_sums(16)
    L.Scorer(v, table).add_gradients(word, row, sums)
    value = lambda t: L.Scorer(v, t).log_probabilities(word, row).sum()
    for r in range(16):
        for c in (0, 3, 17):
            up, down = table.copy(), table.copy()
            up[r, c] += 1e-2
            down[r, c] -= 1e-2
            assert abs((value(up) - value(down)) / 2e-2 - sums.gradient[c, r]) < 2e-2
    level = L.leaves(v.leaf[word])[0]
    assert sums.seen.sum() == (np.minimum(level, L.WIDE) * 3 + np.maximum(level - L.WIDE, 0)).sum()
    want = table + L.RATE * sums.gradient.T / (sums.seen[:, None] + L.SHRINK)
    assert np.allclose(L.stepped(table, sums), want)


def test_a_step_over_tasks_is_that_of_brute_force(spark):
    texts = [f"a{k % 7} b{k % 3} c{k % 5} d" for k in range(60)]
    docs = spark.createDataFrame([(k, t, 0, 1) for k, t in enumerate(texts)], SCHEMA)
    word, row = _words(texts)
    v, table = _vocabulary(word), _table(5000)
    want = L.no_sums(5000)
    L.Scorer(v, table).add_gradients(word, row, want)
    for n in (1, 5):
        got = L.gradients(docs.repartition(n), v, table)
        assert np.allclose(got.gradient, want.gradient, atol=1e-4) and (got.seen == want.seen).all()


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{(s + k * 7) % 40}" for k in range(30)) for s in rng.integers(0, 40, n)]


def test_training_learns_the_order_of_words(spark):
    docs = spark.createDataFrame([(k, t, 0, 1) for k, t in enumerate(_texts(400, 1))], SCHEMA)
    v, table = L.train(docs)
    word, row = _words(_texts(20, 2), v.bits)
    right = L.Scorer(v, table).log_probabilities(word, row).mean()
    mixed = np.random.default_rng(0).permutation(word)
    assert right > L.Scorer(v, table).log_probabilities(mixed, row).mean() + 0.5
    assert right > L.Scorer(v, np.zeros_like(table)).log_probabilities(word, row).mean() + 0.5


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")


def test_held_out_text_is_likelier_than_by_counts_alone(corpus):
    docs = corpus.dropDuplicates(["text"])
    held = docs.where("pmod(xxhash64(text), 10) = 0").toArrow().column("text").combine_chunks()
    v, table = L.train(docs.where("pmod(xxhash64(text), 10) > 0"))
    w = X.words(held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks))
    word, row = L.ids(w, v.bits), np.repeat(np.arange(len(w.off) - 1), np.diff(w.off))
    got, counts = (L.Scorer(v, t).log_probabilities(word, row).mean() for t in (table, np.zeros_like(table)))
    assert got > counts + 0.03


def test_scores_do_not_depend_on_the_partitions(corpus):
    some = corpus.where("doc_id < 300")
    one, many = ({r.doc_id: r.log_prob for r in L.scored(some.repartition(n)).collect()} for n in (1, 32))
    assert set(one) == set(many)
    assert max(abs(one[d] - many[d]) for d in one if one[d] is not None) < 0.01


def test_scores_are_means_of_the_model_and_all_rows_come_back(spark):
    texts = ["a b a b", None, "", " . ", "a b a b", "x " * 30_000]
    docs = spark.createDataFrame([(k if k != 4 else None, t, 0, 1) for k, t in enumerate(texts)], SCHEMA)
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.log_prob, r.perplexity) for r in L.scored(docs).collect()))
    assert [r[2] for r in got] == [4, 0, 0, 0, 30_000, 4]
    assert [r[3] is None for r in got] == [False, True, True, True, False, False]
    assert got[0][3:] == got[-1][3:]
    v, table = L.train(docs.select("doc_id", "text"))
    assert abs(L.Scorer(v, table).log_probabilities(*_words(["a b a b"], v.bits)).mean() - got[0][3]) < 1e-4
    assert abs(np.exp(-got[0][3]) - got[0][4]) < 1e-2 * got[0][4]


def test_word_counts_are_of_the_whole_corpus(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"a b a u{k}", 0, 1) for k in range(300)], SCHEMA)
    for held in (L._HELD, 8):
        monkeypatch.setattr(L, "_HELD", held)
        counts = L.count_words(docs)
        a, b = _words(["a b"], len(counts).bit_length() - 1)[0]
        assert counts[a] >= 600 and counts[b] >= 300 and counts.sum() == 1200 and len(counts) >= 2 * 302


def test_words_that_training_never_saw_count_once():
    word, row = _words(["a a a b"])
    v = _vocabulary(word)
    new, at = _words(["never"])
    assert abs(L.Scorer(v, _table() * 0).log_probabilities(new, at)[0] - math.log(1 / 5)) < 1e-5


def test_the_model_grows_with_the_corpus():
    rows = [L.table_rows(n) for n in (10**5, 10**6, 10**7, 10**8)]
    assert all(b > 3 * a for a, b in zip(rows, rows[1:]))


def test_empty_table(spark):
    assert L.scored(spark.createDataFrame([], SCHEMA)).count() == 0
    assert L.scored(spark.createDataFrame([(1, None, 0, 1)], SCHEMA).where(F.lit(True))).first().log_prob is None
