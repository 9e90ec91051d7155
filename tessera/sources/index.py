"""A multi-field index as a folder of ordinary Parquet tables, and its search.

rows: _row_id and the indexed columns in order of _row_id; postings: of text fields, in order of field and term;
lengths: how many rows have a token of a text field and how many tokens they hold; vectors/<field>: centroids and postings of
clustered fields, in cluster order; manifest: the declared fields as JSON. Row groups are in order, so the minima and maxima
that Parquet keeps let a search skip all others.

Each write is a part, a folder of its own in each of these, which counts only once its line in published is written, at the
end; what a failed write left is no part of the index. Row ids have no gaps: a write has a row of nulls for each id between
the last one before it and its own highest that it wasn't given. Ids up to the last are finished and can't be written again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import ALGORITHMS, Field, Kind, Scalar, top_k
from tessera.functions import metrics
from tessera.operators import fulltext, ivf, queryparser, vector
from tessera.plans.lineage import cut
from tessera.plans.spread import spread

VERSION = 2
#: Filtered searches of up to so many candidates are exact.
EXACT_CANDIDATES = 100_000

_SQL = {Scalar.INT: "int", Scalar.LONG: "bigint", Scalar.FLOAT: "float", Scalar.DOUBLE: "double", Scalar.KEYWORD: "string", Scalar.DATE: "bigint"}
#: Vector algorithms that others add: name -> search(index, field, query, k, candidates).
NATIVE: dict[str, Callable] = {}


def register_vector_algorithm(name: str, search: Callable) -> None:
    NATIVE[name.upper()] = search
    ALGORITHMS.add(name.upper())


def _typed(df: DataFrame, f: Field) -> Column:
    """The field's column in its declared type; timestamps of DATE fields become milliseconds."""
    have = df.schema[f.name].dataType.simpleString()
    c = F.col(f"`{f.name}`")
    if f.kind is Kind.VECTOR:
        wrong = F.raise_error(F.concat(F.lit(f"{f.name}: a vector doesn't have {f.dimension} dimensions: "), F.size(c).cast("string")))
        return F.when(c.isNull() | (F.size(c) == f.dimension), c.cast("array<float>")).otherwise(wrong).alias(f.name)
    if f.kind is Kind.FULLTEXT:
        want = "string"
    elif f.kind is Kind.GEO_POINT:
        want = "struct<lat:double,lon:double>"
    else:
        kind = f.scalar or (Scalar.DATE if f.kind is Kind.DATE else Scalar.KEYWORD)
        want = _SQL[kind]
        if kind is Scalar.DATE and have.startswith("timestamp"):
            return F.unix_millis(c.cast("timestamp")).alias(f.name)
        if have == f"array<{want}>":
            if not kind.multi:
                raise TypeError(f"{f.name}: a field of type {kind.name} has one value per row")
            return c
    if have != want and not (want == "bigint" and have == "int"):
        raise TypeError(f"{f.name} is declared as {want}, the column is {have}")
    return c.cast(want).alias(f.name)


def with_gaps(df: DataFrame, id_column: str = "_row_id", first: int = 0) -> DataFrame:
    """df with a row of nulls for each id from first to the highest that it doesn't have."""
    top = df.agg(F.coalesce(F.max(id_column), F.lit(first - 1))).first()[0]
    gaps = df.sparkSession.range(first, top + 1).select(F.col("id").alias(id_column)).join(df.select(id_column), id_column, "left_anti")
    return df.unionByName(gaps, allowMissingColumns=True)


def _write(df: DataFrame, path: str, *order: str) -> None:
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def clustered(f: Field) -> bool:
    return f.kind is Kind.VECTOR and (f.algorithm or "").upper() in ("IVF", "INT8_HNSW")


def write_rows(df: DataFrame, fields: dict[str, Field], path: str, part: str, first: int = 0, id_column: str = "_row_id") -> tuple[DataFrame, int]:
    """Write rows, postings and lengths of df as a part; the rows written and the last id."""
    spark = df.sparkSession
    rows = df.select(F.col(id_column).cast("long").alias("_row_id"), *(_typed(df, f) for f in fields.values()))
    bad = rows.groupBy("_row_id").count().where(f"count > 1 OR _row_id IS NULL OR _row_id < {first}").first()
    if bad:
        raise ValueError(f"row id {bad['_row_id']} is null, below {first} or not unique")
    _write(with_gaps(rows, first=first), f"{path}/rows/{part}", "_row_id")
    rows = spark.read.parquet(f"{path}/rows/{part}")
    texts = {f.name: f.analyzer for f in fields.values() if f.kind is Kind.FULLTEXT}
    if texts:
        postings = cut(fulltext.PostingRows.build(spread(rows), texts))
        _write(postings, f"{path}/postings/{part}", "field", "term", "_row_id")
        per_row = postings.groupBy("field", "_row_id").agg(F.max("dl").alias("dl"))
        per_row.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{path}/lengths/{part}")
    return rows, rows.agg(F.coalesce(F.max("_row_id"), F.lit(first - 1))).first()[0]


def publish(spark: SparkSession, path: str, part: str, last: int) -> None:
    """Make a part count."""
    line = json.dumps({"part": part, "last": last})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/published/{part}")


def build(df: DataFrame, fields: dict[str, Field], path: str, id_column: str = "_row_id") -> Index:
    """Write a new index; an index at path is an error."""
    spark = df.sparkSession
    home = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    if home.getFileSystem(spark._jsc.hadoopConfiguration()).exists(home):
        raise FileExistsError(f"an index exists at {path}")
    rows, last = write_rows(df, fields, path, "0", 0, id_column)
    for f in fields.values():
        if clustered(f):
            bits = 8 if f.algorithm.upper() == "INT8_HNSW" else f.integer("bits", 4)
            made = ivf.build(rows, f.dimension, f.metric, f.integer("vectors_per_cluster", ivf.VECTORS_PER_CLUSTER), bits, f.params.get("rotate") == "true", vector_column=f.name)
            ivf.save(made, f"{path}/vectors/{f.name}", "0")
    declared = [{"name": f.name, "kind": f.kind.name, "scalar": f.scalar and f.scalar.name, "dimension": f.dimension, "analyzer": f.analyzer, "algorithm": f.algorithm, "params": dict(f.params)} for f in fields.values()]
    spark.createDataFrame([(json.dumps({"version": VERSION, "fields": declared}),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    publish(spark, path, "0", last)
    return Index(spark, path)


def compact(index: Index, path: str) -> Index:
    """A new index at path of all rows of another, as one part, its clusters found anew."""
    return build(index.rows, index.fields, path)


class Index:
    """A written index, open for search."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        said = json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))
        if said["version"] != VERSION:
            raise ValueError(f"the index at {path} is of version {said['version']}, not {VERSION}")
        self.spark, self.path = spark, path
        self.fields = {x["name"]: Field(**x | {"kind": Kind[x["kind"]], "scalar": x["scalar"] and Scalar[x["scalar"]]}) for x in said["fields"]}
        lines = [json.loads(r.value) for r in spark.read.text(f"{path}/published/*").collect()]  # a line per write
        self.parts, self.last = sorted(x["part"] for x in lines), max(x["last"] for x in lines)
        self.rows = self._read("rows")

    def _read(self, table: str) -> DataFrame:
        """A table of all parts that count."""
        return self.spark.read.parquet(*(f"{self.path}/{table}/{p}" for p in self.parts))

    def _field(self, name: str, *kinds: Kind) -> Field:
        f = self.fields.get(name)
        if f is None or f.kind not in kinds:
            raise ValueError(f"{name} is no field of kind {', '.join(k.value for k in kinds)}")
        return f

    def all_row_ids(self) -> DataFrame:
        return self.rows.select("_row_id")

    def filter(self, predicate: Callable[[DataFrame], Column]) -> DataFrame:
        """_row_id of the rows that a predicate of operators.filters accepts, in order."""
        return self.rows.where(predicate(self.rows)).select("_row_id").orderBy("_row_id")

    # text

    def _text(self) -> fulltext.PostingRows:
        texts = {f.name: f.analyzer for f in self.fields.values() if f.kind is Kind.FULLTEXT}
        totals = self._read("lengths").groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()  # a row per field
        return fulltext.PostingRows(self._read("postings"), {r.field: (r.n, r.total) for r in totals}, self.rows, texts)

    def full_text_search(self, query: fulltext.Spec | str, k: int, field: str | None = None) -> DataFrame:
        """_row_id and score of the k best rows of a spec, or of a query string over a field."""
        top_k(k)
        source = self._text()
        if isinstance(query, str):
            query = queryparser.parse(query, self._field(field, Kind.FULLTEXT).name, source.analyzer)
        return fulltext.search(source, query, k)

    def match_filter(self, query: fulltext.Spec | str, field: str | None = None) -> DataFrame:
        """_row_id of all rows that match."""
        source = self._text()
        return fulltext.matching(source, queryparser.parse(query, field, source.analyzer) if isinstance(query, str) else query)

    # vectors

    def _ivf(self, f: Field) -> ivf.Ivf:
        return ivf.load(self.spark, f"{self.path}/vectors/{f.name}", self.parts)

    def vector_search(self, field: str, query, k: int, candidates: DataFrame | Iterable[int] | None = None, n_probe: int | None = None, ratio: float | None = None, oversample: float = 3.0) -> DataFrame:
        """_row_id and score of the k nearest rows; candidates restrict the search before it begins, none of them: no rows."""
        f = self._field(field, Kind.VECTOR)
        metrics.checked(query, f.dimension)
        top_k(k)
        name = (f.algorithm or "EXACT").upper()
        if name in NATIVE:
            return NATIVE[name](self, f, query, k, candidates)
        if name == "NATIVE":
            raise NotImplementedError("no NATIVE vector algorithm is registered")
        if candidates is not None and not isinstance(candidates, DataFrame):
            few = sorted(set(candidates))
            candidates = self.spark.createDataFrame([(int(x),) for x in few], "_row_id long")
            exact = len(few) <= EXACT_CANDIDATES
        else:
            exact = candidates is not None and candidates.limit(EXACT_CANDIDATES + 1).count() <= EXACT_CANDIDATES
        if name in ("EXACT", "HNSW") or exact:
            return vector.knn(self.rows, query, k, f.metric, candidates, vector_column=f.name)
        raw = self.rows.select("_row_id", F.col(f"`{f.name}`").alias("vector"))
        if f.metric == "cosine":
            raw = None
        return ivf.search(self._ivf(f), query, k, ratio, n_probe, candidates, oversample, raw)
