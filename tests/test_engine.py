"""The search engine against brute force and DuckDB, at small sizes."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.config import Field, Kind, Scalar, TextParams, fields, metric
from tessera.functions import analyzers, metrics, quantize
from tessera.functions.distance import edits
from tessera.operators import filters as P
from tessera.operators import fulltext as T
from tessera.operators import ivf, queryparser, vector
from tessera.sources import index as I
from tessera.streaming.ingest import append, ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_queries_are_their_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(tuple, df.select(*columns).collect()), key=str)
    r = duck.execute(catalog.ORACLE_SQL[name])
    at = [[d[0] for d in r.description].index(c) for c in columns]
    assert got == sorted((tuple(x[i] for i in at) for x in r.fetchall()), key=str)


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_scalar_predicates_at_the_ends_of_a_type(spark):
    rows = [(0, -(2**31), -(2**63), -math.inf), (1, 0, 0, 0.0), (2, 2**31 - 1, 2**63 - 1, math.inf), (3, None, None, math.nan)]
    df = spark.createDataFrame(rows, "_row_id long, i int, l long, d double")
    on = lambda c: ids(df.where(c).select("_row_id"))
    assert on(P.lt(df, "i", -(2**31))) == on(P.gt(df, "l", 2**63 - 1)) == []
    assert on(P.lte(df, "i", -(2**31))) == [0]
    assert on(P.gte(df, "d", math.inf)) == [2] and on(P.gt(df, "d", 0.0)) == [2]
    assert on(P.neq(df, "i", 0)) == [0, 2] and on(P.not_in(df, "i", [])) == [0, 1, 2]
    assert on(P.not_exists(df, "i")) == [3]
    for bad in (2**31, 1.5):
        with pytest.raises(ValueError):
            P.eq(df, "i", bad)
    with pytest.raises(ValueError):
        P.eq(df, "i", None)


def test_any_element_of_an_array_may_match(spark):
    df = spark.createDataFrame([(0, [3, 7]), (1, [5]), (2, [7, 11]), (3, None), (4, [None])], "_row_id long, labels array<long>")
    on = lambda c: ids(df.where(c).select("_row_id"))
    assert on(P.eq(df, "labels", 7)) == [0, 2] and on(P.is_in(df, "labels", [5, 11])) == [1, 2]
    assert on(P.neq(df, "labels", 7)) == [1] and on(P.exists(df, "labels")) == [0, 1, 2]
    assert ids(P.where_in(df, "labels", list(range(7, 3000))).select("_row_id")) == [0, 2]
    keyword = spark.createDataFrame([(1, "a")], "_row_id long, k string")
    with pytest.raises(TypeError):
        P.lt(keyword, "k", "b")


def test_geo_arguments_are_checked():
    lat, lon = F.lit, F.lit
    for bad in ((91, 0, 1), (0, 181, 1), (0, 0, -1), (math.nan, 0, 1)):
        with pytest.raises(ValueError):
            P.geo_distance(None, None, *bad)
    with pytest.raises(ValueError):
        P.geo_box(lat, lon, 5, 4, 0, 1)


def test_analyzers_agree_between_columns_and_queries(spark):
    texts = ["Don't stop: e.g. 3.14, 1,000 foo_bar!", "日本 x'y  z", "", "ÑGA Ça l’été 2.0", "a" * 600, "tab\tand\nbreak "]
    for name in ("standard", "whitespace", "simple", "keyword"):
        df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
        got = {r.k: r.x for r in df.select("k", analyzers.tokens(F.col("t"), name).alias("x")).collect()}
        assert got == {k: analyzers.analyze(t, name) for k, t in enumerate(texts)}, name
    with pytest.raises(NotImplementedError):
        analyzers.analyze("x", "ik_smart")
    with pytest.raises(ValueError):
        analyzers.analyze("x", "none such")


def _brute_edits(a, b):
    d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edit_distance_counts_swaps():
    r = random.Random(0)
    for _ in range(800):
        a, b = ("".join(r.choices("ab c", k=r.randint(0, 6))) for _ in range(2))
        for most in (0, 1, 2):
            assert edits(a, b, most) == min(_brute_edits(a, b), most + 1)


DOCS = [(0, "administrator active"), (1, "viewer active"), (2, "the quick brown fox"), (3, "quick the fox brown fox"), (4, None), (5, "")]


@pytest.fixture(scope="module", params=["documents", "postings"])
def source(spark, request):
    docs = spark.createDataFrame(DOCS, "_row_id long, text string")
    if request.param == "documents":
        return T.DocRows(docs, {"text": "standard"})
    return T.PostingRows(T.PostingRows.build(docs, {"text": "standard"}), {"text": (4, 13)}, docs, {"text": "standard"})


def test_postings_are_made_in_slices_of_tokens(monkeypatch):
    rng = random.Random(4)
    tokens = [None if k % 7 == 3 else [f"w{rng.randint(0, 9)}" for _ in range(60 if k == 20 else rng.randint(0, 6))] for k in range(90)]
    batch = pa.record_batch([pa.array(range(95)), pa.array([["z"]] * 5 + tokens)], names=["_row_id", "t"]).slice(5)
    monkeypatch.setattr(T, "SLICE_TOKENS", 25)
    got = list(T._postings(iter([batch.slice(0, 0), batch])))
    assert max(sum(x.column("tf").to_pylist()) for x in got if len(set(x.column("_row_id").to_pylist())) > 1) <= 25
    want = sorted((k + 5, w, t.count(w), [j for j, x in enumerate(t) if x == w], len(t)) for k, t in enumerate(tokens) if t for w in set(t))
    assert sorted(tuple(r.values()) for x in got for r in x.to_pylist()) == want


def test_specs(source):
    found = lambda spec: ids(T.search(source, spec, 10).select("_row_id"))
    m = lambda text, **p: T.Match("text", text, TextParams(**p))
    assert found(m("administrater", fuzziness=-1)) == [0]
    assert found(m("active viewer")) == [0, 1] and found(m("active viewer", operator="AND")) == [1]
    assert found(T.Bool()) == [0, 1, 2, 3, 4, 5] and found(T.Bool(must_not=(m("administrator"),))) == [1, 2, 3, 4, 5]
    assert found(T.Phrase("text", "quick brown")) == [2] and found(T.Phrase("text", "quick brown", 3)) == [2, 3]
    assert found(T.Phrase("text", "fox quick", 1)) == [] and found(m("")) == []
    assert found(T.Boost(m("active"), m("viewer"), 0.1)) == [0, 1]
    deep = m("active")
    for _ in range(70):
        deep = T.Bool((deep,))
    with pytest.raises(ValueError):
        T.search(source, deep, 1)
    with pytest.raises(ValueError):
        T.search(source, T.Match("other", "x"), 1)
    with pytest.raises(ValueError):
        T.search(source, m("x"), 0)


def test_bm25_by_hand(source):
    got = {r._row_id: r.score for r in T.search(source, T.Match("text", "fox fox"), 5).collect()}
    idf, mean = math.log(1 + (4 - 2 + 0.5) / 2.5), 13 / 4
    want = {d: 2 * idf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / mean)) for d, tf, dl in ((2, 1, 4), (3, 2, 5))}
    assert got == pytest.approx(want)


def test_query_strings(source):
    found = lambda q: ids(T.search(source, queryparser.parse(q, "text", source.analyzer), 10).select("_row_id"))
    assert found("active AND viewer") == [1] and found("+active -viewer") == [0] and found("active NOT viewer") == [0]
    assert found('"quick brown"') == [2] and found('"quick brown"~3') == [2, 3]
    assert found("qui*") == [2, 3] and found("v?ewer") == [1] and found("viewr~1") == [1]
    assert found("text:(viewer OR administrator)^2") == [0, 1] and found("[a TO b}") == [0, 1]
    assert found("-active") == [] and found("*:*") == [0, 1, 2, 3, 4, 5]
    assert isinstance(queryparser.parse("a AND (b", "text", source.analyzer), T.Term)
    assert isinstance(queryparser.parse("none:x", "text", source.analyzer), T.Term)


def test_metrics_and_ties(spark):
    df = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.6, 0.8]), (4, [0.0, -1.0]), (5, None), (6, [1.0, 0.0])], "_row_id long, vector array<float>")
    hits = vector.knn(df, [1, 0], 2, "dot_product", [3, 0, 2, 2, 99]).collect()
    assert [r._row_id for r in hits] == [2, 3]
    assert [r._row_id for r in vector.knn(df, [1, 0], 100, "l2").collect()] == [1, 6, 2, 3, 0, 4]
    assert vector.knn(df, [1, 0], 3, "cosine", []).count() == 0
    x = np.array([[3.0, 4.0], [0.0, 0.0], [-1.0, 0.0]])
    q = np.array([1.0, 0.0])
    assert metrics.scores("l2", x, q) == pytest.approx([1 / 21, 1 / 2, 1 / 5])
    assert metrics.scores("inner_product", x, q) == pytest.approx([4, 1, 0.5])
    assert metrics.scores("cosine", x, q) == pytest.approx([0.8, 0.5, 0])
    for bad in ([1, math.nan], [[1, 2]]):
        with pytest.raises(ValueError):
            vector.knn(df, bad, 1)
    with pytest.raises(Exception, match="dimensions"):
        vector.knn(df, [1, 2, 3], 1).collect()


def test_batches_of_queries_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 5))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_row_id long, vector array<double>")
    q = df.withColumnRenamed("_row_id", "query_id")
    want = {(k, int(j)) for k in range(80) for j in np.lexsort((np.arange(80), np.square(x - x[k]).sum(1)))[:3]}
    for size in (4096, 30):
        monkeypatch.setattr(vector, "QUERIES", size)
        assert {(r.query_id, r._row_id) for r in vector.knn_batch(df, q, 3).collect()} == want


@pytest.mark.parametrize("how", ["l2", "dot_product", "inner_product", "cosine"])
def test_batches_of_queries_in_blocks_with_ties_far_and_zero_vectors(spark, monkeypatch, how):
    rng = np.random.default_rng(5)
    x = np.concatenate((rng.normal(size=(60, 4)), np.full((30, 4), 2.0), np.zeros((3, 4)), 1e6 + rng.normal(size=(20, 4))))
    x = x[rng.permutation(len(x))]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_row_id long, vector array<double>")
    asked = df.withColumnRenamed("_row_id", "query_id")
    for name, value in (("BLOCK", 7), ("ROWS", 11), ("PAIRS", 13)):
        monkeypatch.setattr(vector, name, value)
    got = {(r.query_id, r["rank"]): r._row_id for r in vector.knn_batch(df, asked, 4, how).collect()}
    score = metrics.paired(how, np.tile(x, (len(x), 1)), np.repeat(x, len(x), axis=0)).reshape(len(x), -1)
    assert got == {(k, n + 1): int(j) for k in range(len(x)) for n, j in enumerate(np.lexsort((np.arange(len(x)), -score[k]))[:4])}


def test_a_search_in_blocks_lays_few_vectors_side_by_side(spark, monkeypatch):
    """Equal rows are all promising; they were scored at once, a vector for each row of a block and each query."""
    wide = []
    one = metrics.paired
    monkeypatch.setattr(metrics, "paired", lambda how, v, q: (wide.append(len(v)), one(how, v, q))[1])
    monkeypatch.setattr(vector, "PAIRS", 100)
    x = np.ones((300, 2))
    row, j = metrics.promising("l2", x, x[:40], 3, np.full(40, -np.inf))
    assert len(row) == 300 * 40 and (vector.exact("l2", x, row, x, j) == 1).all()
    assert max(wide) == 100


def test_codes():
    x = np.random.default_rng(1).normal(size=(50, 33))
    x[0] = 0
    x[1] = 2.5
    last = np.inf
    for bits in (1, 2, 4, 7, 8):
        c = quantize.quantize(x, bits)
        assert (quantize.unpacked(quantize.packed(c.code, bits), bits, 33) == c.code).all()
        error = np.square(quantize.restored(c, bits) - x).sum(1).mean()
        assert error < last
        last = error
    r = quantize.rotation(70)
    assert np.allclose(r @ r.T, np.eye(70))


@pytest.mark.parametrize(("how", "rotate", "bits"), [("l2", False, 4), ("cosine", True, 8), ("inner_product", False, 7)])
def test_clustered_search(spark, how, rotate, bits):
    rng = np.random.default_rng(17)
    centres = rng.normal(size=(12, 16)) * 3
    x = centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_row_id long, vector array<double>")
    made = ivf.build(df, 16, how, 64, bits, rotate)
    sizes = [r.n for r in made.centroids.collect()]
    assert len(sizes) > 5 and {r._row_id for r in made.postings.select("_row_id").collect()} == set(range(900))
    recall = []
    for k in (0, 100, 250, 400):
        exact = {r._row_id for r in vector.knn(df, x[k], 10, how).collect()}
        got = ivf.search(made, x[k], 10, raw=None if how == "cosine" else df).collect()
        recall.append(len(exact & {r._row_id for r in got}) / 10)
        assert [r.score for r in got] == sorted((r.score for r in got), reverse=True)
    assert np.mean(recall) >= 0.9
    few = ivf.search(made, x[0], 10, candidates=list(range(0, 900, 10))).collect()
    assert len(few) == 10 and all(r._row_id % 10 == 0 for r in few)


def test_few_or_equal_vectors_are_one_cluster_or_part_no_further(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0]) for k in range(400)], "_row_id long, vector array<double>")
    assert ivf.build(df.limit(50), 2, vectors_per_cluster=64).centroids.count() == 1
    made = ivf.build(df, 2, vectors_per_cluster=64)
    assert [r._row_id for r in ivf.search(made, [1, 2], 3).collect()] == [0, 1, 2]
    assert ivf.search(ivf.build(df.limit(0), 2), [1, 2], 3).count() == 0


def _recalls(got, exact):
    """Of each query, and of those alone that are in exact."""
    here = {}
    for r in got.collect():
        here.setdefault(r.query_id, set()).add(r._row_id)
    want = {}
    for r in exact.collect():
        want.setdefault(r.query_id, set()).add(r._row_id)
    return np.array([len(rows & here.get(q, set())) / len(rows) for q, rows in sorted(want.items())])


@pytest.mark.parametrize(("how", "rotate", "bits", "spill"), [("l2", False, 4, True), ("l2", False, 8, False), ("cosine", True, 8, True)])
def test_batched_clustered_search_recalls_all_rows(spark, how, rotate, bits, spill):
    rng = np.random.default_rng(17)
    x = (rng.normal(size=(12, 16)) * 3)[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    x[::90] *= 4  # outliers
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_row_id long, vector array<double>")
    asked = df.select(F.col("_row_id").alias("query_id"), "vector")
    got = ivf.search_batch(ivf.build(df, 16, how, 64, bits, rotate, spill), asked, 10).cache()
    assert got.count() == 9000 and got.dropDuplicates(["query_id", "_row_id"]).count() == 9000
    recall = _recalls(got, vector.knn_batch(df, asked, 10, how))
    assert len(recall) == 900 and recall.mean() >= 0.9 and recall[::90].mean() >= 0.9
    assert got.where("query_id = 5 AND rank = 1").first()._row_id == 5


def test_tops_sort_only_what_is_above_the_floor(monkeypatch):
    """The best of each query as by a full sort, while few scores are sorted once the floors are up."""
    monkeypatch.setattr(ivf, "WAITING", 2_000)
    score = np.random.default_rng(6).normal(size=(20, 9_000))
    score[3], score[4, :50], score[5] = 0, 1e300, -np.abs(score[5])
    tops, kept = ivf._Tops(20, 6), 0
    for a in range(0, 9_000, 100):
        before = tops.waiting
        tops.add(np.arange(20), score[:, a : a + 100], a)
        kept += max(tops.waiting - before, 0)
    who, place = tops.fold()
    assert np.bincount(who).tolist() == [6] * 20 and kept < 20 * 9_000 / 10
    for q in range(20):
        assert sorted(score[q, place[who == q]]) == sorted(score[q])[-6:]


@pytest.mark.parametrize("how", ["l2", "dot_product", "inner_product"])
def test_clusters_are_ranked_by_products_as_by_scores(how):
    rng = np.random.default_rng(7)
    c, q = rng.normal(size=(40, 6)), rng.normal(size=(9, 6))
    assert (np.argsort(-ivf._order(how, c, q), axis=1, kind="stable") == np.argsort(-metrics.scores(how, c, q).T, axis=1, kind="stable")).all()


@pytest.mark.parametrize("name", ["knn_ivf", "knn_int8"])
def test_registered_approximate_searches_take_every_row_as_query(spark, name):
    folder = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").alias("_row_id"), F.col("embedding").alias("vector"))
    exact = vector.knn_batch(df, df.withColumnRenamed("_row_id", "query_id"), 10)
    recall = _recalls(catalog.QUERIES[name](spark, folder), exact)
    assert len(recall) == df.count() and recall.mean() >= 0.9


def _declared(algorithm="IVF"):
    return fields(
        Field("text", Kind.FULLTEXT), Field("n", Kind.SCALAR, Scalar.LONG), Field("tag", Kind.KEYWORD),
        Field("at", Kind.DATE), Field("vec", Kind.VECTOR, dimension=8, algorithm=algorithm, params={"metric": "l2", "vectors_per_cluster": "64"}),
    )


def _table(spark, first, n, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(first + k, None if k % 9 == 4 else f"word{k % 5} common", k, f"t{k % 3}", None, rng.normal(size=8).tolist() if k % 7 else None) for k in range(n)]
    return spark.createDataFrame(rows, "_row_id long, text string, n long, tag string, at long, vec array<float>")


@pytest.mark.parametrize("algorithm", ["IVF", "INT8_HNSW", "HNSW", None])
def test_written_index(spark, tmp_path, algorithm):
    df = _table(spark, 0, 400)
    made = I.build(df, _declared(algorithm), str(tmp_path / "x"))
    made = I.Index(spark, made.path)
    assert ids(made.all_row_ids()) == list(range(400))
    assert ids(made.filter(lambda d: P.between(d, "n", 5, 7))) == [5, 6, 7]
    same = T.search(T.DocRows(df, {"text": "standard"}), T.Match("text", "word3 common"), 7).collect()
    assert [r._row_id for r in made.full_text_search("word3 common", 7, "text").collect()] == [r._row_id for r in same]
    assert ids(made.match_filter("word1", "text")) == [k for k in range(400) if k % 5 == 1 and k % 9 != 4]
    q = df.where("_row_id = 8").first().vec
    assert made.vector_search("vec", q, 5).first()._row_id == 8
    assert [r._row_id for r in made.vector_search("vec", q, 2, [8, 9, 9, 7000]).collect()] == [8, 9]
    assert made.vector_search("vec", q, 2, []).count() == 0
    for call in (lambda: made.vector_search("vec", q[:3], 1), lambda: made.vector_search("vec", q, 0), lambda: made.vector_search("text", q, 1), lambda: made.full_text_search("x", 1, "tag")):
        with pytest.raises(ValueError):
            call()
    with pytest.raises(Exception, match="(?i)exist"):
        I.build(df, _declared(algorithm), made.path)


def test_bad_rows_and_declarations(spark, tmp_path):
    df = _table(spark, 0, 5)
    with pytest.raises(ValueError):
        I.build(df.union(df), _declared(), str(tmp_path / "a"))
    with pytest.raises(Exception, match="dimensions"):
        I.build(df, fields(Field("vec", Kind.VECTOR, dimension=9)), str(tmp_path / "b"))
    with pytest.raises(TypeError):
        I.build(df, fields(Field("n", Kind.SCALAR, Scalar.KEYWORD)), str(tmp_path / "c"))
    for bad in ({"name": ""}, {"name": "v", "kind": Kind.VECTOR}, {"name": "v", "kind": Kind.VECTOR, "dimension": 5000}, {"name": "s", "kind": Kind.SCALAR}):
        with pytest.raises(ValueError):
            Field(**{"kind": Kind.KEYWORD} | bad)
    with pytest.raises(ValueError):
        metric("manhattan")
    with pytest.raises(ValueError):
        Field("v", Kind.VECTOR, dimension=3, params={"m": "x"}).integer("m", 16)
    for bad in ({"operator": "XOR"}, {"boost": -1}, {"fuzziness": 3}, {"max_expansions": 0}, {"prefix_length": -1}):
        with pytest.raises(ValueError):
            TextParams(**bad)
    with pytest.raises(NotImplementedError):
        I.build(df, _declared("NATIVE"), str(tmp_path / "d")).vector_search("vec", [0.0] * 8, 1)


def test_gaps_are_filled(spark, tmp_path):
    df = spark.createDataFrame([(0, "a"), (3, "b")], "_row_id long, x string")
    assert sorted(map(tuple, I.with_gaps(df).collect())) == [(0, "a"), (1, None), (2, None), (3, "b")]
    assert I.with_gaps(df.limit(0)).count() == 0
    made = I.build(df, fields(Field("x", Kind.KEYWORD)), str(tmp_path / "x"))
    assert ids(made.all_row_ids()) == [0, 1, 2, 3]
    assert ids(made.filter(lambda d: P.not_exists(d, "x"))) == [1, 2]
    append(made, spark.createDataFrame([(6, "c")], "_row_id long, x string"))
    made = I.Index(spark, made.path)
    assert ids(made.all_row_ids()) == list(range(7)) and made.last == 6
    for finished in (6, 5, 2):
        with pytest.raises(ValueError, match="finished"):
            append(made, spark.createDataFrame([(finished, "d")], "_row_id long, x string"))


def test_streams_are_appended(spark, tmp_path):
    made = I.build(_table(spark, 0, 20), _declared("HNSW"), str(tmp_path / "x"))
    _table(spark, 20, 30).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_table(spark, 0, 1).schema).parquet(str(tmp_path / "in"))
    query = ingest(made, stream, str(tmp_path / "checkpoint"), availableNow=True)
    query.awaitTermination(120)
    assert query.exception() is None
    again = I.Index(spark, made.path)
    assert ids(again.all_row_ids()) == list(range(50))
    assert len(ids(again.match_filter("common", "text"))) == again.rows.where("text IS NOT NULL").count()


@pytest.mark.parametrize("broken", ["_write", "publish"])
def test_a_batch_that_fails_between_its_writes_is_whole_after_a_retry(spark, tmp_path, monkeypatch, broken):
    made = I.build(_table(spark, 0, 20), _declared("IVF"), str(tmp_path / "x"))
    before = ids(made.match_filter("common", "text"))
    real, calls = getattr(I, broken), []

    def fail(*args):
        calls.append(1)
        if broken == "publish" or len(calls) == 2:  # after the rows, before the postings
            raise OSError("lost")
        return real(*args)

    monkeypatch.setattr(I, broken, fail)
    if broken == "publish":
        monkeypatch.setattr("tessera.streaming.ingest.publish", fail)
    with pytest.raises(OSError):
        append(made, _table(spark, 20, 30, 4), batch_id="7")
    assert ids(I.Index(spark, made.path).all_row_ids()) == list(range(20))
    assert ids(I.Index(spark, made.path).match_filter("common", "text")) == before
    monkeypatch.undo()
    for _ in range(2):  # the second is the same batch once more
        append(made, _table(spark, 20, 30, 4), batch_id="7")
    again = I.Index(spark, made.path)
    assert ids(again.all_row_ids()) == list(range(50))
    assert ids(again.match_filter("common", "text")) == [k for k in range(50) if (k if k < 20 else k - 20) % 9 != 4]
    vector_rows = {r._row_id for r in again._ivf(again.fields["vec"]).postings.select("_row_id").collect()}
    assert vector_rows == {r._row_id for r in again.rows.where("vec IS NOT NULL").collect()}
    q = again.rows.where("_row_id = 25").first().vec
    assert again.vector_search("vec", q, 3).first()._row_id == 25


def test_compaction_makes_one_part(spark, tmp_path):
    made = I.build(_table(spark, 0, 200), _declared("IVF"), str(tmp_path / "x"))
    append(made, _table(spark, 200, 200, 4))
    made = I.Index(spark, made.path)
    small = I.compact(made, str(tmp_path / "y"))
    assert small.parts == ["0"] and ids(small.all_row_ids()) == list(range(400))
    spec = T.Match("text", "word3 common")
    assert small.full_text_search(spec, 9).collect() == made.full_text_search(spec, 9).collect()
    q = made.rows.where("_row_id = 332").first().vec
    assert small.vector_search("vec", q, 1).first()._row_id == 332


def test_a_vector_index_stands_alone(spark, tmp_path):
    df = _table(spark, 0, 300)
    made = ivf.build(df, 8, vectors_per_cluster=64, vector_column="vec")
    ivf.save(made, str(tmp_path / "v"), "0")
    again = ivf.load(spark, str(tmp_path / "v"))
    q = df.where("_row_id = 8").first().vec
    assert [r._row_id for r in ivf.search(again, q, 5).collect()] == [r._row_id for r in ivf.search(made, q, 5).collect()]
    with pytest.raises(ValueError):
        ivf.search(again, q, 5, oversample=0.5)


def test_centroids_beside_their_rows_give_what_a_broadcast_gives(spark, monkeypatch):
    rng = np.random.default_rng(17)
    x = (rng.normal(size=(12, 16)) * 3)[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "_row_id long, vector array<double>")
    rows = lambda: sorted((r._row_id, r.cluster_id) for r in ivf.build(df, 16, "l2", 64).postings.select("_row_id", "cluster_id").collect())
    want = rows()
    monkeypatch.setattr(ivf, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(ivf, "TASK_ROWS", 50)
    assert rows() == want


def _pushed(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.split("PushedFilters: [")[1:]]


PUSHED = {
    "scalar_eq": "EqualTo(l_linenumber,3)", "scalar_neq": "Not(EqualTo(l_linenumber,3))", "scalar_lt": "LessThan(l_quantity", "scalar_lte": "LessThanOrEqual(l_discount", "scalar_gt": "GreaterThan(o_totalprice",
    "scalar_gte": "GreaterThanOrEqual(p_size,40)", "scalar_range": "GreaterThanOrEqual(l_extendedprice", "scalar_in": "In(p_size", "scalar_not_in": "Not(In(p_size", "keyword_eq": "EqualTo(c_mktsegment", "keyword_in": "In(event_type",
    "keyword_not_in": "Not(In(event_type", "keyword_term": "EqualTo(lang,fr)", "keyword_prefix": "StringStartsWith(c_name", "keyword_wildcard": "StringStartsWith(p_brand,Brand#)", "keyword_regexp": "StringStartsWith(p_brand,Brand)",
    "date_range": "GreaterThanOrEqual(o_orderdate", "exists": "IsNotNull(quality)",
}


@pytest.mark.parametrize("name", sorted(PUSHED))
def test_predicates_reach_the_scan(spark, name):
    assert any(PUSHED[name] in x for x in _pushed(catalog.QUERIES[name](spark, SF))), _pushed(catalog.QUERIES[name](spark, SF))


def test_geo_predicates_reach_the_scan_of_stored_points(spark, tmp_path):
    spark.createDataFrame([(0, (48.0, 11.0)), (1, (10.0, 175.0)), (2, None), (3, (None, 1.0))], "_row_id long, at struct<lat:double,lon:double>").write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    lat, lon = F.col("at.lat"), F.col("at.lon")
    near, box = df.where(P.geo_distance(lat, lon, 48.1, 11.6, 100_000)), df.where(P.geo_box(lat, lon, 0, 20, 170, -170))
    assert ids(near.select("_row_id")) == [0] and ids(box.select("_row_id")) == [1]
    assert ids(df.where(P.negated(P.geo_box(lat, lon, 0, 20, 170, -170))).select("_row_id")) == [0, 2, 3]
    assert all("GreaterThanOrEqual(at.lat" in x for d in (near, box) for x in _pushed(d))


def test_an_indexs_filter_reaches_the_scan_and_comes_in_order(spark, tmp_path):
    made = I.build(_table(spark, 0, 300), _declared(None), str(tmp_path / "x"))
    found = made.filter(lambda d: P.between(d, "n", 7, 250) & P.eq(d, "tag", "t1"))
    assert any("EqualTo(tag,t1)" in x and "GreaterThanOrEqual(n,7)" in x for x in _pushed(found))
    assert [r._row_id for r in found.collect()] == [k for k in range(7, 251) if k % 3 == 1]


def test_milliseconds_on_timestamps(spark):
    for kind in ("timestamp", "timestamp_ntz"):
        df = spark.sql(f"SELECT id AS _row_id, CAST(ts AS {kind}) AS ts FROM VALUES (0L, TIMESTAMP'1970-01-01 00:00:00.001'), (1L, TIMESTAMP'1970-01-01 00:00:00.0019'), (2L, TIMESTAMP'1970-01-01 00:00:00.002'), (3L, NULL), (4L, TIMESTAMP'1969-12-31 23:59:59.9995') AS t(id, ts)")
        on = lambda c: ids(df.where(c).select("_row_id"))  # noqa: B023, E731
        assert on(P.eq(df, "ts", 1)) == [0, 1] and on(P.neq(df, "ts", 1)) == [2, 4] and on(P.between(df, "ts", 1, 1)) == [0, 1]
        assert on(P.lt(df, "ts", 1)) == [4] and on(P.lte(df, "ts", 1)) == [0, 1, 4] and on(P.gt(df, "ts", 1)) == [2] and on(P.gte(df, "ts", 2)) == [2]
        assert on(P.is_in(df, "ts", [-1, 2])) == [2, 4] and on(P.not_in(df, "ts", [-1, 2])) == [0, 1]


def test_operators_by_name(spark):
    df = spark.createDataFrame([(0, 1), (1, 5), (2, None)], "_row_id long, i int")
    on = lambda *a: ids(df.where(P.scalar_filter(df, "i", *a)).select("_row_id"))
    assert on("eq", 1) == [0] and on("range", 1, 4) == [0] and on("in", 1, 5) == [0, 1] and on("not_exists") == [2] and on("not_in", 1) == [1]
    with pytest.raises(ValueError):
        on("like", 1)


def test_long_lists_on_arrays_keep_repeated_rows(spark):
    df = spark.createDataFrame([(0, [1, 1, 5000]), (0, [1, 1, 5000]), (1, [-4]), (2, None), (3, [])], "_row_id long, labels array<long>")
    found = P.where_in(df, "labels", list(range(3000)))
    assert ids(found.select("_row_id")) == [0, 0] and found.columns == df.columns
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_a_slop_gives_each_word_a_position_of_its_own(source, spark):
    found = lambda spec: ids(T.search(source, spec, 10).select("_row_id"))
    assert found(T.Phrase("text", "fox fox", 1)) == [3] and found(T.Phrase("text", "fox fox", 0)) == []
    docs = spark.createDataFrame([(0, "one fox here"), (1, "fox fox"), (2, "fox a fox"), (3, "fox a b fox"), (4, "a b a c a"), (5, "")], "_row_id long, text string")
    own = T.DocRows(docs, {"text": "standard"})
    got = {q: ids(T.matching(own, T.Phrase("text", q, n))) for q, n in (("fox fox", 1), ("a a a", 2))}
    assert got == {"fox fox": [1, 2], "a a a": [4]}


def test_standard_queries_run_over_the_written_postings(spark, tmp_path):
    """The index and the documents give one answer, empty texts included, which count for no statistic."""
    docs = spark.createDataFrame([*DOCS, (6, "!?"), (7, "fox")], "_row_id long, text string")
    made = I.build(docs, fields(Field("text", Kind.FULLTEXT)), str(tmp_path / "x"))
    plain = T.DocRows(docs, {"text": "standard"})
    assert made._text().lengths["text"] == (5, 14)
    for spec in (T.Match("text", "fox quick"), T.Phrase("text", "quick fox", 2), T.Match("text", "foxes", TextParams(fuzziness=2)), T.Pattern("text", "prefix", "adm")):
        a, b = (sorted((r._row_id, round(r.score, 9)) for r in d.collect()) for d in (made.full_text_search(spec, 9), T.search(plain, spec, 9)))
        assert a == b and a


def test_scores_from_codes_are_those_of_restored_vectors():
    rng = np.random.default_rng(8)
    x, q, c = rng.normal(size=(40, 37)), rng.normal(size=(3, 37)), rng.normal(size=37)
    got = quantize.quantize_each(x, (1, 2, 4, 7))
    for bits, codes in got.items():
        assert np.allclose(quantize.products(codes, bits, q[0]), quantize.restored(codes, bits) @ q[0], atol=1e-4)
        asked = quantize.quantize(q, 4)
        assert np.allclose(quantize.code_products(codes, bits, asked, 4), quantize.restored(codes, bits) @ quantize.restored(asked, 4).T)
    codes = got[7]
    for how in ("l2", "inner_product", "dot_product"):
        assert np.allclose(ivf.estimated(how, codes, 7, c, q[0]), metrics.scores(how, c + x, q[0]), rtol=0.05, atol=0.1)
    s = quantize.statistics(x, c)
    assert np.allclose(s.square, np.square(x - c).sum(1)) and np.allclose(s.variance, (x - c).var(1)) and np.allclose(s.along, x @ c)


def test_statistics_of_clusters(spark):
    df = _table(spark, 0, 300)
    made = ivf.build(df, 8, vectors_per_cluster=64, vector_column="vec")
    assert np.allclose(ivf.global_centroid(made), np.mean([r.centroid for r in made.centroids.collect()], axis=0))
    squares = sorted(r.square for r in made.postings.select("square").collect())
    low, mid = ivf.quantiles(made, [0.0, 0.5])
    assert low == squares[0] and abs(mid - np.median(squares)) < 0.2 * mid


def test_other_vector_algorithms_may_be_registered(spark, tmp_path):
    I.register_vector_algorithm("first_rows", lambda index, f, query, k, candidates: index.rows.orderBy("_row_id").limit(k).select("_row_id"))
    made = I.build(_table(spark, 0, 5), _declared("first_rows"), str(tmp_path / "x"))
    assert ids(made.vector_search("vec", [0.0] * 8, 2)) == [0, 1]
    with pytest.raises(ValueError):
        Field("v", Kind.VECTOR, dimension=3, algorithm="second_rows")
