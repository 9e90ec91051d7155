"""Quality rules whose cutoffs adapt to each language and source.

Per document seven measures are taken: the shares of symbols, upper-case letters and digits among the characters other than
white space; of words that repeat the word before them among the words; of lines that repeat an earlier line among the lines
with words; the mean length of a word; and the logarithm of the number of words. For each language and source a mergeable
quantile sketch of each gives its quartiles; a group of fewer than MIN_GROUP documents takes those of its language's merged
sketches, and a language of fewer those of all. A document breaks a rule if its measure, drawn to the group's median as if
SMOOTH more units had been seen, lies beyond the quartile by FENCE interquartile ranges (of at least the rule's spread): above
the upper one, or below the lower one, as the rule says. Documents that break none are kept, by joining each with its group's
thresholds.

Defined results: a null, empty or blank text is rejected and not part of any sketch; null languages and sources are groups of
their own; a null doc_id is kept or rejected like any other; repeated rows count each; texts of any length are read whole. Ties
in a sketch give the lower value. Only doc_id, text, lang and source are read, so other columns may clash; an empty table gives
an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as X
from tessera.plans.lineage import cut

MIN_GROUP = 20
FENCE = 4.0
SMOOTH = 60.0
#: Sketches are exact up to about so many values and within 0.1 % of the rank beyond.
SKETCH_K = 4096
BROADCAST_GROUPS = 200_000


class Rule(NamedTuple):
    """A measure is count / units; spread is the least interquartile range; above and below: on which sides a fence stands."""

    units: str
    spread: float
    above: bool = True
    below: bool = False
    smooth: float = SMOOTH


RULES = {
    "symbols": Rule("chars", 0.02),
    "upper": Rule("chars", 0.02),
    "digits": Rule("chars", 0.02),
    "repeats": Rule("words", 0.02),
    "again": Rule("lines", 0.05),
    "letters": Rule("words", 0.3, below=True),
    "length": Rule("one", 0.5, above=False, below=True, smooth=0.0),
}
_UNITS = ("chars", "words", "lines", "one")
_SCHEMA = ", ".join(["doc_id long", "lang string", "source string", *(f"{r}_count double" for r in RULES), *(f"{u} double" for u in _UNITS)])


@cache
def _kinds() -> np.ndarray:
    """Of each code point: 1 letter or number, 2 upper-case letter as well, 4 digit as well."""
    out = np.zeros(0x110000, np.uint8)
    for k in range(0x110000):
        c = unicodedata.category(chr(k))
        if c[0] in "LN":
            out[k] = 1 + 2 * (c == "Lu") + 4 * (48 <= k < 58)
    return out


def counts(text: pa.Array) -> np.ndarray:
    """The counts of RULES and the units of each row, a column for each."""
    w = X.words(text, strip=False)
    n, words = len(w.off) - 1, np.diff(w.off).astype(float)
    first = (w.data & 0xC0) != 0x80  # of each character
    code = w.data if first.all() else np.frombuffer(w.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    row = np.searchsorted(np.flatnonzero(first), w.row)
    ink = (code > 32) | ~np.isin(code, (9, 10, 11, 12, 13, 32))
    kind = _kinds()[code]
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[row]).astype(float)
    owner = np.repeat(np.arange(n), np.diff(w.off))
    same = np.zeros(len(w.hash), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (owner[1:] == owner[:-1])
    lines, again = _lines(w, n)
    chars = total(ink)
    columns = {
        "symbols": total(ink & (kind == 0)), "upper": total((kind & 2) > 0), "digits": total((kind & 4) > 0),
        "repeats": np.bincount(owner[same], minlength=n).astype(float), "again": again, "letters": chars, "length": np.log(np.maximum(words, 1)),
    }
    return np.column_stack([*(columns[r] for r in RULES), chars, words, lines, np.ones(n)])


def _lines(w: X.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of lines with words of each row, and of those that are equal to an earlier one, byte for byte."""
    breaks = np.flatnonzero(w.data == 10)
    begin = np.unique(np.concatenate((w.row[:-1], breaks + 1)))
    begin = begin[begin < len(w.data)]
    end = np.append(begin[1:], len(w.data))
    end = end - (w.data[end - 1] == 10)
    some = np.searchsorted(w.begin, begin) < np.searchsorted(w.begin, end)
    begin, end = begin[some], end[some]
    owner = np.searchsorted(w.row, begin, "right") - 1
    h = X._hashed(w.data, begin, end) if len(begin) else np.zeros(0, np.uint64)
    order = np.lexsort((h, owner))
    equal = np.zeros(len(order), bool)
    equal[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    return np.bincount(owner, minlength=n).astype(float), np.bincount(owner[order][equal], minlength=n).astype(float)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, each rule's count and the units, of the rows that have words; one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in X.slices(batch.column(3)):
                part = batch.slice(a, b - a)
                x = counts(part.column(3))
                some = x[:, len(RULES) + 1] > 0
                keys = [part.column(k).filter(pa.array(some)) for k in range(3)]
                yield pa.record_batch([*keys, *(pa.array(c) for c in x[some].T)], names=["doc_id", "lang", "source", *(f"{r}_count" for r in RULES), *_UNITS])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")))
    return slim.mapInArrow(run, _SCHEMA)


def thresholds(measures: DataFrame) -> DataFrame:
    """lang, source, and per rule the median, the floor and the limit."""
    sketches = cut(measures.groupBy("lang", "source").agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(F.col(f"{r}_count") / F.col(rule.units), SKETCH_K).alias(r) for r, rule in RULES.items())))
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(r, SKETCH_K).alias(r) for r in RULES)]
    of_lang = sketches.groupBy("lang").agg(*merged).select("lang", F.col("n").alias("lang_n"), *(F.col(r).alias(f"lang_{r}") for r in RULES))
    of_all = sketches.agg(*merged).select(*(F.col(r).alias(f"all_{r}") for r in RULES))  # one row
    at = sketches.alias("s").join(of_lang.alias("l"), F.col("s.lang").eqNullSafe(F.col("l.lang"))).crossJoin(F.broadcast(of_all)).drop(F.col("l.lang"))
    out = []
    for r, rule in RULES.items():
        chosen = F.when(F.col("n") >= MIN_GROUP, F.col(r)).when(F.col("lang_n") >= MIN_GROUP, F.col(f"lang_{r}")).otherwise(F.col(f"all_{r}"))
        low, mid, high = (F.kll_sketch_get_quantile_double(chosen, F.lit(q)) for q in (0.25, 0.5, 0.75))
        reach = FENCE * F.greatest(high - low, F.lit(rule.spread))
        out += [mid.alias(f"{r}_median"), (low - reach).alias(f"{r}_floor"), (high + reach).alias(f"{r}_limit")]
    return at.select("lang", "source", *out)


def _smooth(r: str) -> Column:
    rule = RULES[r]
    return (F.col(f"{r}_count") + rule.smooth * F.col(f"{r}_median")) / (F.col(rule.units) + rule.smooth)


def kept(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the smoothed measures of the documents that break no rule."""
    measures = cut(measured(docs))
    limits = cut(thresholds(measures)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    small = limits.count() <= BROADCAST_GROUPS
    joined = measures.join(F.broadcast(limits) if small else limits, measures["lang"].eqNullSafe(limits["_lang"]) & measures["source"].eqNullSafe(limits["_source"]))
    ok = F.lit(True)
    for r, rule in RULES.items():
        if rule.above:
            ok &= _smooth(r) <= F.col(f"{r}_limit")
        if rule.below:
            ok &= _smooth(r) >= F.col(f"{r}_floor")
    return joined.where(ok).select("doc_id", "lang", "source", *(F.round(_smooth(r), 6).alias(r) for r in RULES))


def oracle_sql() -> str:
    """The same in DuckDB, with exact quantiles in place of sketches, which are exact too up to SKETCH_K values."""

    def quantiles(prefix: str) -> str:
        return ", ".join(f"quantile_disc({r}_count / {rule.units}, {q}) AS {prefix}{r}_{int(100 * q)}" for r, rule in RULES.items() for q in (0.25, 0.5, 0.75))

    pick = ", ".join(f"CASE WHEN n >= {MIN_GROUP} THEN g.{r}_{q} WHEN lang_n >= {MIN_GROUP} THEN lang_{r}_{q} ELSE all_{r}_{q} END AS {r}_{q}" for r in RULES for q in (25, 50, 75))
    smooth = {r: f"(({r}_count + {rule.smooth} * {r}_50) / ({rule.units} + {rule.smooth}))" for r, rule in RULES.items()}
    reach = {r: f"{FENCE} * greatest({r}_75 - {r}_25, {rule.spread})" for r, rule in RULES.items()}
    where = [f"{smooth[r]} <= {r}_75 + {reach[r]}" for r, rule in RULES.items() if rule.above] + [f"{smooth[r]} >= {r}_25 - {reach[r]}" for r, rule in RULES.items() if rule.below]
    count = {
        "symbols": "length(regexp_replace(ink, '[\\p{L}\\p{N}]', '', 'g'))", "upper": "length(regexp_replace(ink, '[^\\p{Lu}]', '', 'g'))", "digits": "length(regexp_replace(ink, '[^0-9]', '', 'g'))",
        "repeats": "len(list_filter(list_zip(w[:len(w) - 1], w[2:]), lambda p: p[1] = p[2]))", "again": "len(l) - len(list_distinct(l))", "letters": "length(ink)", "length": "ln(len(w))",
    }
    return f"""
WITH m AS (
  SELECT doc_id, lang, source, {", ".join(f"CAST({count[r]} AS DOUBLE) AS {r}_count" for r in RULES)},
    CAST(length(ink) AS DOUBLE) AS chars, CAST(len(w) AS DOUBLE) AS words, CAST(len(l) AS DOUBLE) AS lines, 1.0::DOUBLE AS one
  FROM (SELECT *, regexp_replace(text, '\\s+', '', 'g') AS ink, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S')) AS l FROM documents)
  WHERE length(ink) > 0),
g AS (SELECT lang, source, count(*) AS n, {quantiles("")} FROM m GROUP BY lang, source),
l AS (SELECT lang, count(*) AS lang_n, {quantiles("lang_")} FROM m GROUP BY lang),
a AS (SELECT {quantiles("all_")} FROM m),
t AS (SELECT g.lang, g.source, {pick} FROM g JOIN l ON g.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a)
SELECT doc_id, m.lang, m.source, {", ".join(f"round({smooth[r]}, 6) AS {r}" for r in RULES)}
FROM m JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
WHERE {" AND ".join(where)}"""
