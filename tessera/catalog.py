"""Registered queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import Field, Kind, Scalar, TextParams, fields
from tessera.functions import analyzers
from tessera.operators import filters as P
from tessera.operators import fulltext as T
from tessera.operators import ivf, queryparser, vector
from tessera.plans.lineage import shared_folder
from tessera.sources import index
from tessera.streaming.ingest import append

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if it can be expressed."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("all_row_ids", "SELECT doc_id AS _row_id FROM documents")
def all_row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("_row_id"))


# filters

_LINE = "l_orderkey, l_linenumber"
_IDS = list(range(1, 200_000, 7))


def _filter(name: str, table: str, columns: str, predicate: Callable[[DataFrame], Column], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _read(spark, sf_dir, table)
        return df.where(predicate(df)).select(*columns.split(", "))

    query(name, f"SELECT {columns} FROM {table} WHERE {where}")(run)


_filter("scalar_eq", "lineitem", _LINE, lambda d: P.eq(d, "l_linenumber", 3), "l_linenumber = 3")
_filter("scalar_neq", "lineitem", _LINE, lambda d: P.neq(d, "l_linenumber", 3), "l_linenumber <> 3")
_filter("scalar_lt", "lineitem", _LINE, lambda d: P.lt(d, "l_quantity", 5), "l_quantity < 5")
_filter("scalar_lte", "lineitem", _LINE, lambda d: P.lte(d, "l_discount", 0.02), "l_discount <= 0.02")
_filter("scalar_gt", "orders", "o_orderkey", lambda d: P.gt(d, "o_totalprice", 250_000), "o_totalprice > 250000")
_filter("scalar_gte", "part", "p_partkey", lambda d: P.gte(d, "p_size", 40), "p_size >= 40")
_filter("scalar_range", "lineitem", _LINE, lambda d: P.between(d, "l_extendedprice", 1000.0, 20000.0), "l_extendedprice BETWEEN 1000 AND 20000")
_filter("scalar_in", "part", "p_partkey", lambda d: P.is_in(d, "p_size", [1, 7, 7, 49]), "p_size IN (1, 7, 49)")
_filter("scalar_not_in", "part", "p_partkey", lambda d: P.not_in(d, "p_size", [1, 7, 49]), "p_size NOT IN (1, 7, 49)")
_filter("in_empty", "part", "p_partkey", lambda d: P.is_in(d, "p_size", []), "false")
_filter("keyword_eq", "customer", "c_custkey", lambda d: P.eq(d, "c_mktsegment", "BUILDING"), "c_mktsegment = 'BUILDING'")
_filter("keyword_in", "events", "event_id", lambda d: P.is_in(d, "event_type", ["signup", "error"]), "event_type IN ('signup', 'error')")
_filter("keyword_not_in", "events", "event_id", lambda d: P.not_in(d, "event_type", ["signup", "error"]), "event_type NOT IN ('signup', 'error')")
_filter("keyword_term", "documents", "doc_id", lambda d: P.term(d, "lang", "fr"), "lang = 'fr'")
_filter("keyword_prefix", "customer", "c_custkey", lambda d: P.prefix(d, "c_name", "Customer#00000001"), "starts_with(c_name, 'Customer#00000001')")
_filter("keyword_wildcard", "part", "p_partkey", lambda d: P.wildcard(d, "p_brand", "Brand#?*2"), "p_brand LIKE 'Brand#_%2'")
_filter("keyword_regexp", "part", "p_partkey", lambda d: P.regexp(d, "p_brand", r"Brand\#[1-3]+"), "regexp_full_match(p_brand, 'Brand#[1-3]+')")


@query("keyword_fuzzy", "SELECT c_custkey FROM customer WHERE levenshtein(c_mktsegment, 'BUILDINK') <= 2")
def keyword_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("_row_id"), "c_mktsegment")
    return T.matching(T.DocRows(rows, {"c_mktsegment": "keyword"}), T.Fuzzy("c_mktsegment", "BUILDINK")).withColumnRenamed("_row_id", "c_custkey")


@query("in_large", f"SELECT o_orderkey FROM orders WHERE o_orderkey % 7 = 1 AND o_orderkey < {_IDS[-1] + 1}")
def in_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.where_in(_read(spark, sf_dir, "orders"), "o_orderkey", _IDS).select("o_orderkey")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id").join(_read(spark, sf_dir, "labels"), "doc_id", "left")


@query("exists", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    return df.where(P.exists(df, "quality")).select("doc_id")


@query("not_exists", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS NULL")
def not_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    return df.where(P.not_exists(df, "quality")).select("doc_id")


@query("neq_excludes_null", "SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality <> 1")
def neq_excludes_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _labelled(spark, sf_dir)
    return df.where(P.neq(df, "quality", 1)).select("doc_id")


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("suppliers"))


_SUPPLIERS = "SELECT l_orderkey FROM (SELECT l_orderkey, list(DISTINCT l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)"


@query("multi_value_eq", f"{_SUPPLIERS} WHERE list_contains(s, 7)")
def multi_value_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _suppliers(spark, sf_dir)
    return df.where(P.eq(df, "suppliers", 7)).select("l_orderkey")


@query("multi_value_neq", f"{_SUPPLIERS} WHERE NOT list_contains(s, 7)")
def multi_value_neq(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _suppliers(spark, sf_dir)
    return df.where(P.neq(df, "suppliers", 7)).select("l_orderkey")


@query("multi_value_range", f"{_SUPPLIERS} WHERE len(list_filter(s, lambda x: x BETWEEN 3 AND 5)) > 0")
def multi_value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _suppliers(spark, sf_dir)
    return df.where(P.between(df, "suppliers", 3, 5)).select("l_orderkey")


@query("date_range", "SELECT o_orderkey FROM orders WHERE epoch_ms(o_orderdate) BETWEEN 820454400000 AND 852076799999")
def date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders")
    return df.where(P.between(df, "o_orderdate", 820454400000, 852076799999)).select("o_orderkey")


_GEO = "(SELECT c_custkey, CAST((c_custkey * 37) % 180 AS DOUBLE) - 90 AS lat, CAST((c_custkey * 73) % 360 AS DOUBLE) - 180 AS lon FROM customer)"
_HAVERSINE = "2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin((radians({lat}) - radians(lat)) / 2), 2) + cos(radians(lat)) * cos(radians({lat})) * pow(sin((radians({lon}) - radians(lon)) / 2), 2))))"


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return _read(spark, sf_dir, "customer").select(key, ((key * 37) % 180 - 90).cast("double").alias("lat"), ((key * 73) % 360 - 180).cast("double").alias("lon"))


@query("geo_distance", f"SELECT c_custkey FROM {_GEO} WHERE {_HAVERSINE.format(lat=48.1, lon=11.6)} <= 2500000")
def geo_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).where(P.geo_distance(F.col("lat"), F.col("lon"), 48.1, 11.6, 2_500_000)).select("c_custkey")


@query("geo_bbox", f"SELECT c_custkey FROM {_GEO} WHERE lat BETWEEN -10 AND 30 AND lon BETWEEN 5 AND 60")
def geo_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).where(P.geo_box(F.col("lat"), F.col("lon"), -10, 30, 5, 60)).select("c_custkey")


@query("geo_bbox_dateline", f"SELECT c_custkey FROM {_GEO} WHERE lat BETWEEN -10 AND 30 AND (lon >= 170 OR lon <= -150)")
def geo_bbox_dateline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir).where(P.geo_box(F.col("lat"), F.col("lon"), -10, 30, 170, -150)).select("c_custkey")


# text

_MID = r"regexp_replace(regexp_replace({x}, '(\p{{L}})[''’.:·](\p{{L}})', '\1_\2', 'g'), '(\p{{L}})[''’.:·](\p{{L}})', '\1_\2', 'g')"
_NUM = r"regexp_replace(regexp_replace({x}, '(\p{{N}})[.,;''](\p{{N}})', '\1_\2', 'g'), '(\p{{N}})[.,;''](\p{{N}})', '\1_\2', 'g')"
#: The tokens of the standard analyzer, but with _ for the marks within.
_TOKENS = r"regexp_extract_all({text}, '[\p{{L}}\p{{N}}\p{{M}}_]+')".format(text=_NUM.format(x=_MID.format(x="lower(text)")))
_D = f"d AS MATERIALIZED (SELECT doc_id AS _row_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), s AS MATERIALIZED (SELECT count(*) AS n, avg(len(t)) AS mean FROM d WHERE len(t) > 0)"


def _source(spark: SparkSession, sf_dir: str) -> T.DocRows:
    return T.DocRows(_read(spark, sf_dir, "documents"), {"text": "standard"}, "doc_id")


def _idf(df: str) -> str:
    return f"ln(1 + (s.n - {df} + 0.5) / ({df} + 0.5))"


def _tfn(tf: str) -> str:
    return f"{tf} / ({tf} + 1.2 * (0.25 + 0.75 * len(t) / s.mean))"


def _scored(terms: list[str], match: str, score: str) -> str:
    """SQL over rows with tf_<k> and df_<k> of each term."""
    tf = ", ".join(f"CAST(len(list_filter(t, lambda x: x = '{w}')) AS DOUBLE) AS tf_{k}" for k, w in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (list_contains(t, '{w}')) AS df_{k}" for k, w in enumerate(terms))
    return f"WITH {_D}, f AS (SELECT {df} FROM d), r AS (SELECT *, {tf} FROM d) SELECT _row_id, round({score}, 6) AS score FROM r, s, f WHERE {match} ORDER BY {score} DESC, _row_id LIMIT 20"


def _w(k: int) -> str:
    return f"(CASE WHEN tf_{k} > 0 THEN {_idf(f'df_{k}')} * {_tfn(f'tf_{k}')} ELSE 0 END)"


def _text(name: str, spec: Callable[[], T.Spec], sql: str | None) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return T.search(_source(spark, sf_dir), spec(), 20).withColumn("score", F.round("score", 6))

    query(name, sql)(run)


_LIC = T.Match("text", "license")
_text("bm25_term", lambda: _LIC, _scored(["license"], "tf_0 > 0", _w(0)))
_MATCH_SQL = _scored(["the", "mit", "license"], "tf_0 + tf_1 + tf_2 > 0", f"{_w(0)} + {_w(1)} + {_w(2)}")
_text("bm25_match_or", lambda: T.Match("text", "The MIT License"), _MATCH_SQL)
_text("bm25_match_and", lambda: T.Match("text", "public license", TextParams("AND", 2.0)), _scored(["public", "license"], "tf_0 > 0 AND tf_1 > 0", f"({_w(0)} + {_w(1)}) * 2"))
_text("bm25_bool", lambda: T.Bool((_LIC,), (T.Match("text", "mit"), T.Match("text", "public")), (T.Match("text", "apache"),)), _scored(["license", "mit", "public", "apache"], "tf_0 > 0 AND tf_3 = 0", f"{_w(0)} + {_w(1)} + {_w(2)}"))
_text("bm25_pure_negative", lambda: T.Bool(must_not=(T.Match("text", "the"),)), _scored(["the"], "tf_0 = 0", "(1.0 + 0 * tf_0)"))
_text("bm25_boost", lambda: T.Boost(_LIC, T.Match("text", "mit"), 0.2), _scored(["license", "mit"], "tf_0 > 0", f"{_w(0)} * CASE WHEN tf_1 > 0 THEN 0.2 ELSE 1 END"))
_text(
    "bm25_fuzzy",
    lambda: T.Match("text", "lisence", TextParams(fuzziness=2)),
    f"""WITH {_D}, e AS MATERIALIZED (SELECT _row_id, len(t) AS dl, unnest(t) AS term FROM d), v AS (SELECT term, count(DISTINCT _row_id) AS df FROM e GROUP BY term),
x AS (SELECT term, df, damerau_levenshtein(term, 'lisence') AS edits FROM v WHERE edits <= 2 ORDER BY edits, term LIMIT 50),
y AS (SELECT term, CASE WHEN edits = 0 THEN 1.0 ELSE 1 - edits / least(length(term), 7) END AS boost, max(df) OVER () AS df FROM x),
f AS (SELECT _row_id, dl, term, CAST(count(*) AS DOUBLE) AS tf FROM e GROUP BY ALL)
SELECT _row_id, round(sum(boost * {_idf('df')} * tf / (tf + 1.2 * (0.25 + 0.75 * dl / s.mean))), 6) AS score FROM f JOIN y USING (term), s GROUP BY _row_id ORDER BY score DESC, _row_id LIMIT 20""",
)
_PAIR = "CAST(len(list_filter(range(1, len(t)), lambda k: t[k] = 'general' AND t[k + 1] = 'public')) AS DOUBLE)"
_text(
    "bm25_query_string",
    lambda: queryparser.parse('+license -mit "general public"^2', "text", {"text": "standard"}),
    _scored(["license", "mit", "general", "public"], "tf_0 > 0 AND tf_1 = 0", f"{_w(0)} + CASE WHEN {_PAIR} > 0 THEN 2 * ({_idf('df_2')} + {_idf('df_3')}) * {_tfn(_PAIR)} ELSE 0 END"),
)
_AT = "list_filter(range(1, len(t) + 1), lambda k: t[k] = '{w}')"
_A, _B = _AT.format(w="licensed"), f"list_transform({_AT.format(w='license')}, lambda k: k - 1)"
_NEAR = f"list_transform(list_distinct(list_concat({_A}, {_B})), lambda x: greatest(list_min(list_filter({_A}, lambda y: y >= x)) + 0 * list_min(list_filter({_B}, lambda y: y >= x)), list_min(list_filter({_B}, lambda y: y >= x)) + 0 * list_min(list_filter({_A}, lambda y: y >= x))) - x)"
_SLOPPY = f"coalesce(list_sum(list_transform(list_filter({_NEAR}, lambda e: e <= 3), lambda e: 1.0 / (1 + e))), 0.0)"
_text("bm25_phrase_slop", lambda: T.Phrase("text", "licensed license", 3), _scored(["licensed", "license"], f"{_SLOPPY} > 0", f"({_idf('df_0')} + {_idf('df_1')}) * {_tfn(_SLOPPY)}"))
_PHRASE = "CAST(len(list_filter(range(1, len(t) - 1), lambda k: t[k] = 'general' AND t[k + 1] = 'public' AND t[k + 2] = 'license')) AS DOUBLE)"
_PHRASE_SQL = _scored(["general", "public", "license"], f"{_PHRASE} > 0", f"({_idf('df_0')} + {_idf('df_1')} + {_idf('df_2')}) * {_tfn(_PHRASE)}")
_text("bm25_phrase", lambda: T.Phrase("text", "general public license"), _PHRASE_SQL)
_filter("text_term", "documents", "doc_id", lambda d: P.term(d, "text", "license", "standard"), f"list_contains({_TOKENS}, 'license')")
_filter("text_prefix", "documents", "doc_id", lambda d: P.prefix(d, "text", "licen", "standard"), f"len(list_filter({_TOKENS}, lambda x: starts_with(x, 'licen'))) > 0")
_filter("text_wildcard", "documents", "doc_id", lambda d: P.wildcard(d, "text", "l?c*se", "standard"), f"len(list_filter({_TOKENS}, lambda x: regexp_full_match(x, 'l.c.*se'))) > 0")
_filter("text_regexp", "documents", "doc_id", lambda d: P.regexp(d, "text", "(mit|apache)", "standard"), f"len(list_filter({_TOKENS}, lambda x: regexp_full_match(x, 'mit|apache'))) > 0")


@query("text_match", f"SELECT doc_id AS _row_id FROM documents WHERE list_contains({_TOKENS}, 'mit') OR list_contains({_TOKENS}, 'gnu')")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.matching(_source(spark, sf_dir), queryparser.parse("MIT gnu", "text", {"text": "standard"}))


def _analyzer(name: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(analyzers.tokens(F.col("text"), name), "|").alias("tokens"))

    query(f"analyzer_{name}", f"SELECT conv_id, turn, array_to_string({sql}, '|') AS tokens FROM conversations")(run)


def _standard_sql() -> str:
    """The tokens of the standard analyzer: each mark within a word or a number stands for itself as a private letter."""
    marks = [(m, "L") for m in "'’.:·"] + [(m, "N") for m in ".,;'"]
    text, back = "lower(text)", "x"
    for k, (m, kind) in enumerate(marks):
        q = m.replace("'", "''").replace(".", r"\.")
        for _ in range(2):
            text = rf"regexp_replace({text}, '(\p{{{kind}}}){q}(\p{{{kind}}})', '\1' || chr({0xE000 + k}) || '\2', 'g')"
        back = f"replace({back}, chr({0xE000 + k}), '{m.replace(chr(39), chr(39) * 2)}')"
    return rf"list_transform(regexp_extract_all({text}, '[\p{{L}}\p{{N}}\p{{M}}_\x{{E000}}-\x{{E00F}}]+'), lambda x: {back})"


_analyzer("standard", _standard_sql())
_analyzer("whitespace", r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')")
_analyzer("simple", r"regexp_extract_all(lower(text), '\p{L}+')")
_analyzer("keyword", "[text]")

# vectors

_DOT = "list_sum(list_transform(list_zip(v, q), lambda p: p[1] * p[2]))"
_L2 = "list_sum(list_transform(list_zip(v, q), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
_NORM = "sqrt(list_sum(list_transform({x}, lambda y: y * y)))"
_SCORE = {
    "l2": f"1 / (1 + {_L2})",
    "dot_product": f"greatest((1 + {_DOT}) / 2, 0)",
    "inner_product": f"CASE WHEN {_DOT} < 0 THEN 1 / (1 - {_DOT}) ELSE {_DOT} + 1 END",
    "cosine": f"greatest((1 + {_DOT} / ({_NORM.format(x='v')} * {_NORM.format(x='q')})) / 2, 0)",
}
_E = "SELECT vec_id AS _row_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
_Q = "SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0"


def _knn_sql(metric: str, where: str = "true") -> str:
    return f"WITH e AS ({_E}), o AS ({_Q}), r AS (SELECT _row_id, {_SCORE[metric]} AS x FROM e, o WHERE {where}) SELECT _row_id, round(x, 6) AS score FROM r ORDER BY x DESC, _row_id LIMIT 10"


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_row_id"), F.col("embedding").alias("vector"), "label")


def _first(df: DataFrame) -> list[float]:
    return df.where("_row_id = 0").first().vector  # the query


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


def _knn(name: str, metric: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = _vectors(spark, sf_dir)
        return _rounded(vector.knn(df, _first(df), 10, metric))

    query(name, _knn_sql(metric))(run)


for _name, _metric in (("knn_l2", "l2"), ("knn_dot", "dot_product"), ("knn_mip", "inner_product"), ("knn_cosine", "cosine")):
    _knn(_name, _metric)


@query("knn_filtered", _knn_sql("l2", "label = 3"))
def knn_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return _rounded(vector.knn(df, _first(df), 10, "l2", df.where(P.eq(df, "label", 3)).select("_row_id")))


@query("knn_candidates", _knn_sql("l2", "_row_id IN (3, 5, 8, 13, 21)"))
def knn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return _rounded(vector.knn(df, _first(df), 10, "l2", [3, 5, 8, 13, 21, 3, 3, 10**9]))


@query("knn_no_candidates", "SELECT CAST(0 AS BIGINT) AS _row_id, CAST(0 AS DOUBLE) AS score WHERE false")
def knn_no_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    return vector.knn(df, _first(df), 10, "l2", [])


@query("knn_batch", f"WITH e AS ({_E}), o AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings), r AS (SELECT query_id, _row_id, {_SCORE['l2']} AS x FROM e, o), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x DESC, _row_id) AS rank FROM r) SELECT query_id, _row_id, round(x, 6) AS score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def knn_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every row."""
    df = _vectors(spark, sf_dir)
    return _rounded(vector.knn_batch(df, df.select(F.col("_row_id").alias("query_id"), "vector"), 5))


@query("knn_rescored", _knn_sql("l2"))
def knn_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _vectors(spark, sf_dir)
    q = _first(df)
    hits = vector.knn(df, q, 10, "l2").select("_row_id", F.lit(0.0).alias("score"))
    return _rounded(vector.rescored(hits, df, q, "l2"))


def _ivf(spark: SparkSession, sf_dir: str, **options) -> tuple[DataFrame, ivf.Ivf]:
    df = _vectors(spark, sf_dir)
    return df, ivf.build(df, len(_first(df)), vectors_per_cluster=64, **options)


@query("knn_ivf_all_clusters", _knn_sql("l2"))
def knn_ivf_all_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters probed, all rows scored exactly."""
    df, made = _ivf(spark, sf_dir)
    return _rounded(ivf.search(made, _first(df), 10, n_probe=1 << 30, oversample=1e6, raw=df))


def _near_all(df: DataFrame, made: ivf.Ivf) -> DataFrame:
    """About the ten nearest of every row."""
    return _rounded(ivf.search_batch(made, df.select(F.col("_row_id").alias("query_id"), "vector"), 10))


@query("knn_ivf")
def knn_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_all(*_ivf(spark, sf_dir))


@query("knn_int8")
def knn_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_all(*_ivf(spark, sf_dir, bits=8, spill=False))


@query("ivf_clusters")
def ivf_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ivf(spark, sf_dir)[1].centroids.select("cluster_id", "parent_id", "n")


@query("ivf_neighbours")
def ivf_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ivf.neighbours(_ivf(spark, sf_dir)[1], 3)


@query("row_id_gaps", "SELECT i AS _row_id, c_name FROM range((SELECT max(c_custkey) * 2 + 1 FROM customer)) r(i) LEFT JOIN customer ON i = c_custkey * 2")
def row_id_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.with_gaps(_read(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("_row_id"), "c_name"))


# written indexes, in the folder that all executors share


def _home(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tessera-index-{uuid.uuid4().hex}"


_TEXTS = fields(Field("text", Kind.FULLTEXT), Field("lang", Kind.KEYWORD), Field("source", Kind.KEYWORD), Field("n_chars", Kind.SCALAR, Scalar.LONG))


def _build_texts(spark: SparkSession, sf_dir: str) -> index.Index:
    return index.build(_read(spark, sf_dir, "documents"), _TEXTS, _home(spark), "doc_id")


def _build_vectors(spark: SparkSession, sf_dir: str) -> index.Index:
    df = _read(spark, sf_dir, "embeddings")
    size = len(df.first().embedding)
    cells = {"metric": "l2", "vectors_per_cluster": "64"}
    declared = fields(Field("label", Kind.SCALAR, Scalar.INT), Field("flat", Kind.VECTOR, dimension=size), Field("ivf", Kind.VECTOR, dimension=size, algorithm="IVF", params=cells))
    return index.build(df.select("vec_id", "label", F.col("embedding").alias("flat"), F.col("embedding").alias("ivf")), declared, _home(spark), "vec_id")


def _built(spark: SparkSession, sf_dir: str, build: Callable[[SparkSession, str], index.Index]) -> index.Index:
    """An index of a session's tables, built when it is first asked for, and opened."""
    there = spark.sparkContext.__dict__.setdefault("_tessera_indexes", {})
    if (build, sf_dir) not in there:
        there[build, sf_dir] = build(spark, sf_dir).path
    return index.Index(spark, there[build, sf_dir])


@query("index_build_open", "SELECT i AS _row_id, lang, source, n_chars FROM range((SELECT max(doc_id) + 1 FROM documents)) r(i) LEFT JOIN documents ON i = doc_id")
def index_build_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of an index that is built anew and opened; ids that the table lacks are rows of nulls."""
    spark.sparkContext.__dict__.setdefault("_tessera_indexes", {}).pop((_build_texts, sf_dir), None)
    return _built(spark, sf_dir, _build_texts).rows.select("_row_id", "lang", "source", "n_chars")


@query("index_match", _MATCH_SQL)
def index_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_built(spark, sf_dir, _build_texts).full_text_search(T.Match("text", "The MIT License"), 20))


@query("index_phrase", _PHRASE_SQL)
def index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_built(spark, sf_dir, _build_texts).full_text_search('"general public license"', 20, "text"))


@query("index_match_filter", ORACLE_SQL["text_match"])
def index_match_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, _build_texts).match_filter("MIT gnu", "text")


@query("index_filter", "SELECT doc_id AS _row_id FROM documents WHERE lang = 'fr' AND n_chars BETWEEN 500 AND 5000")
def index_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _built(spark, sf_dir, _build_texts).filter(lambda d: P.eq(d, "lang", "fr") & P.between(d, "n_chars", 500, 5000))


@query("index_append", _MATCH_SQL)
def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of the first half of the ids, to which the rest is appended, searched as one."""
    docs = _read(spark, sf_dir, "documents")
    half = docs.agg(F.max("doc_id")).first()[0] // 2
    made = index.build(docs.where(F.col("doc_id") <= half), _TEXTS, _home(spark), "doc_id")
    append(made, docs.where(F.col("doc_id") > half), "doc_id")
    return _rounded(index.Index(spark, made.path).full_text_search(T.Match("text", "The MIT License"), 20))


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _first(_vectors(spark, sf_dir))


@query("index_knn", _knn_sql("l2", "label = 3"))
def index_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _built(spark, sf_dir, _build_vectors)
    return _rounded(made.vector_search("flat", _query_vector(spark, sf_dir), 10, made.filter(lambda d: P.eq(d, "label", 3))))


@query("index_ivf", _knn_sql("l2"))
def index_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All clusters probed from disk, all rows scored exactly."""
    return _rounded(_built(spark, sf_dir, _build_vectors).vector_search("ivf", _query_vector(spark, sf_dir), 10, n_probe=1 << 30, oversample=1e6))
