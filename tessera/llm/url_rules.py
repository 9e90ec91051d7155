"""URL filters as a sort-merge range join.

A URL's key is its reversed host and then its path, so that a rule on a domain or a path is a prefix of the keys it
covers, and the keys with a prefix form one interval. Rules and URLs are sorted together by key; a sweep keeps the stack
of rules whose interval is still open, which nest because prefixes do. The innermost rule on top of the stack decides;
of rules with the same prefix, deny goes before allow and then the lowest rule_id.

Partitions of the sorted rows are swept apart: the rules still open where a partition begins are prefixes of its first
key, and are looked up for those first keys alone.

The key: the scheme, user, port, query and fragment go, the host is lower case and a final dot and leading `www.` go;
labels are reversed and each ends with a dot; then `/` and the path. A rule is a host pattern (`example.com` covers its
subdomains) with or without a path prefix, which ends at a path segment's end.

Defined results: a null or empty URL, or one without host, has no key, no rule and is allowed; a null page_id is carried
as it is; repeated URLs are each judged; rules without pattern are left out; a URL that no rule covers is allowed. Only
page_id and url are read, so other columns may clash; an empty table of pages gives an empty result, one of rules allows
all.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

#: (rule_id, pattern, action): the rules that the registered query applies.
RULES = (
    (1, "casino-win.example.com", "deny"),
    (2, "free-bets.example.com", "deny"),
    (3, "ads-track.example.com", "deny"),
    (4, "spam-farm.example.com", "deny"),
    (5, "cheap-pills.example.com", "deny"),
    (6, "adult-x.example.net", "deny"),
    (7, "casino-win.example.com/en", "allow"),
    (8, "casino-win.example.com/en/1", "deny"),
    (9, "example.org", "deny"),
    (10, "tionble.example.org", "allow"),
    (11, "tionble.example.org/de", "deny"),
    (12, "tionsh.example.com/fr", "deny"),
    (13, "blog.tionsh.example.com", "allow"),
    (14, "example.net/es", "deny"),
    (15, "tionsh.example.com/fr", "allow"),
)

_PARTS = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?(/[^?#]*)?"


def key(url: Column) -> Column:
    """The canonical key; null without host."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.trim(url), _PARTS, 1)), r"^www\.|\.+$", "")
    path = F.regexp_replace(F.regexp_extract(F.trim(url), _PARTS, 2), "/+$", "")
    labels = F.array_join(F.reverse(F.split(host, r"\.")), ".")
    return F.when(host != "", F.concat(labels, F.lit("."), F.when(path != "", F.concat(path, F.lit("/"))).otherwise("")))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([*rules], "rule_id long, pattern string, action string")


def _sweep(opened: dict[str, list[tuple[str, int, str]]]):
    """Judge the URLs of sorted rows (key, kind, id, url, action); opened has the rules open at a partition's first key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, int, str]] | None = None
        for batch in batches:
            at, rule, action = [], [], []
            keys, kinds, ids, actions = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            for k, (name, kind) in enumerate(zip(keys, kinds)):
                if name is None:
                    at.append(k), rule.append(None), action.append("allow")
                    continue
                if stack is None:
                    stack = list(opened.get(name, ()))
                while stack and not name.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != name:  # it may be open already where a partition begins
                        stack.append((name, ids[k], actions[k]))
                else:
                    at.append(k)
                    rule.append(stack[-1][1] if stack else None)
                    action.append(stack[-1][2] if stack else "allow")
            yield pa.record_batch([batch.column(2).take(pa.array(at, pa.int64())), batch.column(3).take(pa.array(at, pa.int64())), pa.array(rule, pa.int64()), pa.array(action, pa.string())], names=["page_id", "url", "rule_id", "action"])

    return run


def _first_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chain(batches):
        first = next((k for k in batch.column(0).to_pylist() if k is not None), None)
        if first is not None:
            yield pa.record_batch([pa.array([first])], names=["key"])
            return


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url, rule_id of the innermost rule or null, action (allow or deny)."""
    urls = pages.select(key(F.col("url").cast("string")).alias("key"), F.lit(1).alias("kind"), F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.lit(None).cast("string").alias("action"))
    laws = rules.select(key(F.col("pattern").cast("string")).alias("key"), F.struct(F.when(F.lower("action") == "deny", 0).otherwise(1).alias("rank"), F.col("rule_id").cast("long").alias("id"), F.lower("action").alias("action")).alias("law")).where("key IS NOT NULL")
    best = laws.groupBy("key").agg(F.min("law").alias("law"))
    rows = urls.unionByName(best.select("key", F.lit(0).alias("kind"), "law.id", F.lit(None).cast("string").alias("url"), "law.action"))
    # the sort is laid down, as the range bounds are drawn from a sample and must be the same for both passes
    swept = cut(rows.repartitionByRange("key", "kind", "id").sortWithinPartitions("key", "kind", "id"))
    first = swept.select("key").mapInArrow(_first_keys, "key string")
    # the rules open at a first key: every prefix of it that ends a label or a segment
    begins = first.select("key", F.explode(F.filter(F.sequence(F.lit(1), F.length("key")), lambda k: F.col("key").substr(k, F.lit(1)).isin(".", "/"))).alias("n")).select(F.col("key").alias("first"), F.col("key").substr(F.lit(1), F.col("n")).alias("key"))
    opened: dict[str, list[tuple[str, int, str]]] = {}
    for r in begins.join(best, "key").select("first", "key", "law").collect():  # a few per partition
        opened.setdefault(r["first"], []).append((r["key"], r["law"]["id"], r["law"]["action"]))
    for found in opened.values():
        found.sort(key=lambda x: len(x[0]))
    return swept.mapInArrow(_sweep(opened), "page_id long, url string, rule_id long, action string")


def oracle_sql(rules=RULES) -> str:
    """The innermost rule by comparing every key with every rule's prefix."""

    def sql_key(url: str) -> str:
        parts = _PARTS.replace("'", "''")
        host = f"regexp_replace(lower(regexp_extract(trim({url}), '{parts}', 1)), '^www\\.|\\.+$', '', 'g')"
        path = f"regexp_replace(regexp_extract(trim({url}), '{parts}', 2), '/+$', '')"
        return f"CASE WHEN {host} <> '' THEN array_to_string(list_reverse(string_split({host}, '.')), '.') || '.' || CASE WHEN {path} <> '' THEN {path} || '/' ELSE '' END END"

    values = ", ".join(f"({n}, '{p}', '{a}')" for n, p, a in rules)
    return f"""
WITH r AS (SELECT CAST(rule_id AS BIGINT) AS rule_id, action, {sql_key("pattern")} AS k FROM (VALUES {values}) AS v(rule_id, pattern, action)),
p AS (SELECT page_id, url, {sql_key("url")} AS k, row_number() OVER () AS n FROM pages),
j AS (SELECT p.page_id, p.url, r.rule_id, r.action,
    row_number() OVER (PARTITION BY p.n ORDER BY length(r.k) DESC NULLS LAST, r.action DESC, r.rule_id) AS best
  FROM p LEFT JOIN r ON starts_with(p.k, r.k))
SELECT page_id, url, rule_id, coalesce(action, 'allow') AS action FROM j WHERE best = 1"""
