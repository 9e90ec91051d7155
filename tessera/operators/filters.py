"""Filters as Columns: scalar, keyword, text, geo and existence predicates.

A predicate on a plain column is a bare comparison, so that it reaches the scan; where the value is missing it is null, which
where() takes for false. negated() turns that into true. On an array column a predicate holds if any element meets it. DATE
values are milliseconds, on a column of milliseconds as on one of timestamps.
"""

from __future__ import annotations

import math
import re
from datetime import datetime, timedelta
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import analyzers
from tessera.functions.distance import haversine
from tessera.functions.terms import regexp_to_java, wildcard_to_java

#: Lists longer than this are joined as a table instead of written into the plan.
LONG_LIST = 1_000

_INTEGERS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}
_EARTH = 6371008.7714


def _element(df: DataFrame, field: str) -> tuple[Column, T.DataType, bool]:
    kind = df.schema[field].dataType
    many = isinstance(kind, T.ArrayType)
    return F.col(f"`{field}`"), kind.elementType if many else kind, many


def _checked(value, kind: T.DataType):
    """The value in the field's type; what would silently become another value is an error."""
    if value is None:
        raise ValueError("a predicate's value can't be null")
    name = kind.simpleString()
    if name in _INTEGERS:
        if isinstance(value, bool) or value != int(value):
            raise ValueError(f"{value!r} is no value of type {name}")
        if not -(2 ** (_INTEGERS[name] - 1)) <= value < 2 ** (_INTEGERS[name] - 1):
            raise ValueError(f"{value} is beyond type {name}")
        value = int(value)
    elif name in ("float", "double"):
        value = float(value)
    return value


def _literal(value, kind: T.DataType) -> Column:
    return F.lit(_checked(value, kind)).cast(kind)


def _time(millis: int, kind: T.DataType) -> Column:
    """The first moment of a millisecond."""
    if isinstance(kind, T.TimestampType):
        return F.timestamp_millis(F.lit(int(millis)))
    return F.lit((datetime(1970, 1, 1) + timedelta(milliseconds=int(millis))).isoformat(" ")).cast(kind)


def _bounds(value, kind: T.DataType) -> tuple[Column, Column] | None:
    """For a timestamp column: where the millisecond begins and where the next does."""
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return None
    _checked(value, T.LongType())
    return _time(value, kind), _time(value + 1, kind)


def _any(df: DataFrame, field: str, test) -> Column:
    c, _, many = _element(df, field)
    return F.coalesce(F.exists(c, test), F.lit(False)) if many else test(c)


def negated(predicate: Column) -> Column:
    """True where a predicate doesn't hold, also for want of a value."""
    return ~F.coalesce(predicate, F.lit(False))


def _ordered(df: DataFrame, field: str) -> T.DataType:
    kind = _element(df, field)[1]
    if isinstance(kind, T.StringType):
        raise TypeError(f"{field}: keywords have no order")
    return kind


def _number(x: Column, kind: T.DataType, test: Column) -> Column:
    """Nothing is above NaN in a scan, so that it must be told apart."""
    return test & ~F.isnan(x) if kind.simpleString() in ("float", "double") else test


def eq(df: DataFrame, field: str, value) -> Column:
    kind = _element(df, field)[1]
    if at := _bounds(value, kind):
        return _any(df, field, lambda x: (x >= at[0]) & (x < at[1]))
    v = _literal(value, kind)
    return _any(df, field, lambda x: x == v)


def neq(df: DataFrame, field: str, value) -> Column:
    c, kind, many = _element(df, field)
    if many or _bounds(value, kind):
        return exists(df, field) & negated(eq(df, field, value))
    return c.isNotNull() & (c != _literal(value, kind))


def lt(df: DataFrame, field: str, value) -> Column:
    kind = _ordered(df, field)
    v = (_bounds(value, kind) or [_literal(value, kind)])[0]
    return _any(df, field, lambda x: x < v)


def lte(df: DataFrame, field: str, value) -> Column:
    kind = _ordered(df, field)
    if at := _bounds(value, kind):
        return _any(df, field, lambda x: x < at[1])
    v = _literal(value, kind)
    return _any(df, field, lambda x: x <= v)


def gt(df: DataFrame, field: str, value) -> Column:
    kind = _ordered(df, field)
    if at := _bounds(value, kind):
        return _any(df, field, lambda x: x >= at[1])
    v = _literal(value, kind)
    return _any(df, field, lambda x: _number(x, kind, x > v))


def gte(df: DataFrame, field: str, value) -> Column:
    kind = _ordered(df, field)
    v = (_bounds(value, kind) or [_literal(value, kind)])[0]
    return _any(df, field, lambda x: _number(x, kind, x >= v))


def between(df: DataFrame, field: str, low, high) -> Column:
    """Both ends inclusive."""
    kind = _ordered(df, field)
    if at := _bounds(low, kind):
        end = _bounds(high, kind)[1]
        return _any(df, field, lambda x: (x >= at[0]) & (x < end))
    a, b = _literal(low, kind), _literal(high, kind)
    return _any(df, field, lambda x: (x >= a) & (x <= b))


def is_in(df: DataFrame, field: str, values: list) -> Column:
    if not values:
        return F.lit(False)
    kind = _element(df, field)[1]
    if _bounds(values[0], kind):
        times = [_bounds(v, kind) for v in dict.fromkeys(values)]
        return _any(df, field, lambda x: reduce(or_, ((x >= a) & (x < b) for a, b in times)))
    literals = [_literal(v, kind) for v in dict.fromkeys(values)]
    return _any(df, field, lambda x: x.isin(literals))


def not_in(df: DataFrame, field: str, values: list) -> Column:
    c, kind, many = _element(df, field)
    if many or not values or _bounds(values[0], kind):
        return exists(df, field) & negated(is_in(df, field, values))
    return c.isNotNull() & ~is_in(df, field, values)


def scalar_filter(df: DataFrame, field: str, operator: str, *values) -> Column:
    """The predicate of an operator by its name: eq, neq, lt, lte, gt, gte, range, in, not_in, exists or not_exists."""
    if operator in ("in", "not_in"):
        return (is_in if operator == "in" else not_in)(df, field, list(values))
    by = {"eq": eq, "neq": neq, "lt": lt, "lte": lte, "gt": gt, "gte": gte, "range": between, "exists": exists, "not_exists": not_exists}
    if operator not in by:
        raise ValueError(f"unknown operator {operator!r}")
    return by[operator](df, field, *values)


def exists(df: DataFrame, field: str) -> Column:
    c, _, many = _element(df, field)
    return F.coalesce(F.exists(c, lambda x: x.isNotNull()), F.lit(False)) if many else c.isNotNull()


def not_exists(df: DataFrame, field: str) -> Column:
    c, _, many = _element(df, field)
    return negated(exists(df, field)) if many else c.isNull()


def where_in(df: DataFrame, field: str, values: list) -> DataFrame:
    """Rows whose field is one of values; a long list becomes a table that Spark joins as its size allows."""
    if len(values) <= LONG_LIST:
        return df.where(is_in(df, field, values))
    _, kind, many = _element(df, field)
    table = df.sparkSession.createDataFrame([(_checked(v, kind),) for v in dict.fromkeys(values)], T.StructType([T.StructField("_value", kind)]))
    if not many:
        return df.join(table, F.col(f"`{field}`") == F.col("_value"), "left_semi")
    # each distinct element meets the list once; a row that has several of them is one row again
    placed = df.withColumn("_place", F.monotonically_increasing_id())
    each = placed.select("*", F.explode(F.array_distinct(F.col(f"`{field}`"))).alias("_value"))
    return each.join(table, "_value", "left_semi").dropDuplicates(["_place"]).select(*df.columns)


# text filters, on the tokens of an analysed column or on a keyword


#: Analyzers whose tokens are parts of the text, and whether they are lower case.
_PARTS = {"standard": True, "simple": True, "whitespace": False, "keyword": False}


def _any_token(df: DataFrame, field: str, analyzer: str | None, test, within=None) -> Column:
    """A token passes a test; within is what the whole text must pass for that, which is cheaper than to cut it up."""
    c, _, many = _element(df, field)
    if many:
        return F.coalesce(F.exists(c, test), F.lit(False))
    if analyzer is None:
        return test(c)
    found = F.coalesce(F.exists(analyzers.tokens(c, analyzer), test), F.lit(False))
    lower = _PARTS.get(analyzer.lower())
    return found if within is None or lower is None else within(F.lower(c) if lower else c) & found


def term(df: DataFrame, field: str, value: str, analyzer: str | None = None) -> Column:
    """A token equals value, which isn't analysed; analyzer None: the column is a keyword."""
    return _any_token(df, field, analyzer, lambda t: t == value, lambda text: text.contains(value))


def prefix(df: DataFrame, field: str, value: str, analyzer: str | None = None) -> Column:
    return _any_token(df, field, analyzer, lambda t: t.startswith(value), lambda text: text.contains(value))


def _begins(t: Column, literal: str, java: str) -> Column:
    """A pattern after the letters that it begins with, which reach the scan."""
    return t.startswith(literal) & t.rlike(java) if literal else t.rlike(java)


def wildcard(df: DataFrame, field: str, pattern: str, analyzer: str | None = None) -> Column:
    """* and ? over a whole token; a backslash escapes."""
    java = wildcard_to_java(pattern)
    literal = re.match(r"[^*?\\]*", pattern)[0]
    return _any_token(df, field, analyzer, lambda t: _begins(t, literal, java), lambda text: text.rlike(java[1:-2]))


def regexp(df: DataFrame, field: str, pattern: str, analyzer: str | None = None) -> Column:
    """The expression must cover a whole token."""
    java = regexp_to_java(pattern)
    literal = "" if "|" in pattern else re.match(r"(?:[\w ](?![*?{+]))*", pattern, re.ASCII)[0]
    return _any_token(df, field, analyzer, lambda t: _begins(t, literal, java), lambda text: text.rlike(java[1:-2]))


# geo filters, on a struct of lat and lon


def _check(lat: float, lon: float) -> None:
    if not (math.isfinite(lat) and math.isfinite(lon) and -90 <= lat <= 90 and -180 <= lon <= 180):
        raise ValueError(f"({lat}, {lon}) is no point of the earth")


def geo_distance(lat: Column, lon: Column, at_lat: float, at_lon: float, meters: float) -> Column:
    """Within meters of a point; a band of latitudes is tested first, which reaches the scan of a stored latitude."""
    _check(at_lat, at_lon)
    if not (math.isfinite(meters) and meters >= 0):
        raise ValueError("a radius must be finite and not negative")
    reach = math.degrees(meters / _EARTH) + 1e-9
    return lat.between(at_lat - reach, at_lat + reach) & (haversine(lat, lon, F.lit(at_lat), F.lit(at_lon)) <= meters)


def geo_box(lat: Column, lon: Column, min_lat: float, max_lat: float, min_lon: float, max_lon: float) -> Column:
    """Within a box, which crosses the date line if min_lon is greater than max_lon."""
    _check(min_lat, min_lon)
    _check(max_lat, max_lon)
    if min_lat > max_lat:
        raise ValueError("min_lat is greater than max_lat")
    across = lon.between(min_lon, max_lon) if min_lon <= max_lon else (lon >= min_lon) | (lon <= max_lon)
    return lat.between(min_lat, max_lat) & across
