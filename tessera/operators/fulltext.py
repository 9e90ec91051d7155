"""Full-text queries, scored by BM25.

A query is a tree of the specs below. It is compiled into two Columns over one row per document, whether it matches and
its score, so that a whole tree costs one pass and no join. What a row knows of its terms comes from a source: DocRows
looks into the tokens of each document; PostingRows reads only the postings of the query's terms.

Matches of phrases with slop: the words' positions, each less its place in the phrase, spread over at most slop; every
lowest position that starts such a spread d counts 1 / (1 + d). A word that the phrase has twice needs two positions.

The number of rows with a field and their mean length count rows with at least one token.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import TextParams, top_k
from tessera.functions import analyzers
from tessera.functions.distance import edits
from tessera.functions.terms import regexp_to_java, wildcard_to_java
from tessera.plans.lineage import cut
from tessera.plans.spread import spread

K1, B = 1.2, 0.75
MAX_DEPTH = 64
#: Tokens whose postings are made at once; a longer text is a slice of its own.
SLICE_TOKENS = 1 << 18


@dataclass(frozen=True)
class Spec:
    pass


@dataclass(frozen=True)
class Match(Spec):
    field: str
    text: str
    params: TextParams = field(default_factory=TextParams)


@dataclass(frozen=True)
class Term(Spec):
    field: str
    value: str


@dataclass(frozen=True)
class Fuzzy(Spec):
    field: str
    value: str
    max_edits: int = 2
    prefix_length: int = 0
    max_expansions: int = 50


@dataclass(frozen=True)
class Phrase(Spec):
    field: str
    text: str
    slop: int = 0

    def __post_init__(self) -> None:
        if self.slop < 0:
            raise ValueError("slop must not be negative")


@dataclass(frozen=True)
class Pattern(Spec):
    """Tokens that a test accepts, all with score 1: kind prefix, wildcard, regexp or range (low, high, with ends)."""

    field: str
    kind: str
    value: str | tuple

    def test(self, t: Column) -> Column:
        if self.kind == "prefix":
            return t.startswith(self.value)
        if self.kind == "wildcard":
            return t.rlike(wildcard_to_java(self.value))
        if self.kind == "regexp":
            return t.rlike(regexp_to_java(self.value))
        low, high, with_low, with_high = self.value
        out = F.lit(True)
        if low is not None:
            out &= (t >= low) if with_low else (t > low)
        if high is not None:
            out &= (t <= high) if with_high else (t < high)
        return out


@dataclass(frozen=True)
class Bool(Spec):
    """All of must, none of must_not, and, if must is empty, one of should; without positive clauses all rows match."""

    must: tuple[Spec, ...] = ()
    should: tuple[Spec, ...] = ()
    must_not: tuple[Spec, ...] = ()


@dataclass(frozen=True)
class Boost(Spec):
    """The rows of positive; the score times negative_boost where negative matches too."""

    positive: Spec
    negative: Spec
    negative_boost: float = 0.5

    def __post_init__(self) -> None:
        if not 0 <= self.negative_boost <= 1:
            raise ValueError("negative_boost must be from 0 to 1")


@dataclass(frozen=True)
class Weighted(Spec):
    of: Spec
    boost: float


def children(spec: Spec) -> tuple[Spec, ...]:
    if isinstance(spec, Bool):
        return spec.must + spec.should + spec.must_not
    return (spec.positive, spec.negative) if isinstance(spec, Boost) else (spec.of,) if isinstance(spec, Weighted) else ()


def leaves(spec: Spec, depth: int = 0) -> list[Spec]:
    if depth >= MAX_DEPTH:
        raise ValueError(f"a query may be nested {MAX_DEPTH} deep")
    below = children(spec)
    return [x for c in below for x in leaves(c, depth + 1)] if below else [spec]


def _found(tokens: Column, terms: list[str]) -> Column:
    """The tokens that are among terms, with their positions."""
    return F.filter(F.transform(tokens, lambda x, k: F.struct(x.alias("t"), k.alias("at"))), lambda x: x["t"].isin(terms))


class DocRows:
    """Rows of documents without an index: their texts are cut into tokens once for a query, of which a narrow table of the
    query's own terms is kept."""

    def __init__(self, docs: DataFrame, fields: dict[str, str], id_column: str = "_row_id") -> None:
        """fields: the analyzer of each text column."""
        self.analyzer = dict(fields)
        self.docs = docs.select(F.col(id_column).alias("_row_id"), *(F.col(f"`{f}`") for f in fields))
        self.rows: DataFrame | None = None
        self.number = {f: k for k, f in enumerate(fields)}
        self.patterns: list[Pattern] = []

    def _tokens(self, fields: Iterable[str]) -> DataFrame:
        tokens = F.struct(*(analyzers.tokens(F.col(f"`{f}`"), self.analyzer[f]).alias(f) for f in fields))
        # behind a generator, so that a text isn't cut up once per use
        return spread(self.docs).select("_row_id", F.explode(F.array(tokens)).alias("_tokens")).select("_row_id", "_tokens.*")

    def gather(self, terms: dict[str, set[str]], patterns: list[Pattern]) -> None:
        """Look through the documents for these terms and patterns."""
        self.patterns = list(dict.fromkeys(patterns))
        fields = dict.fromkeys([*terms, *(p.field for p in patterns)])
        if not fields:
            self.rows = self.docs.select("_row_id")
            return
        columns = []
        for f in fields:
            t = F.col(f"`{f}`")
            columns += [F.size(t).alias(f"n{self.number[f]}"), _found(t, sorted(terms.get(f, ()))).alias(f"at{self.number[f]}")]
        columns += [F.coalesce(F.exists(F.col(f"`{p.field}`"), p.test), F.lit(False)).alias(f"p{k}") for k, p in enumerate(self.patterns)]
        self.rows = cut(self._tokens(fields).select("_row_id", *columns))

    def dl(self, f: str) -> Column:
        return F.col(f"n{self.number[f]}")

    def _at(self, f: str, term: str) -> Column:
        return F.filter(F.col(f"at{self.number[f]}"), lambda x: x["t"] == term)

    def tf(self, f: str, term: str) -> Column:
        return F.coalesce(F.size(self._at(f, term)), F.lit(0))

    def positions(self, f: str, term: str) -> Column:
        return F.transform(self._at(f, term), lambda x: x["at"])

    def any_token(self, f: str, spec: Pattern) -> Column:
        return F.col(f"p{self.patterns.index(spec)}")

    def prepare(self, terms: dict[str, set[str]], patterns: list[Pattern], every_row: bool) -> DataFrame:
        return self.rows

    def statistics(self, terms: dict[str, set[str]]) -> dict[str, tuple[int, float, dict[str, int]]]:
        """Of each field: the rows that have it, their mean length, and the rows of each term; over the narrow table."""
        asked = [(f, t) for f, ts in terms.items() for t in sorted(ts)]
        aggregates = [x for f in terms for x in (F.count(F.when(self.dl(f) > 0, 1)), F.sum(F.when(self.dl(f) > 0, self.dl(f))))]
        aggregates += [F.count(F.when(self.tf(f, t) > 0, 1)) for f, t in asked]
        got = self.rows.agg(*(a.alias(f"a{k}") for k, a in enumerate(aggregates))).first() if aggregates else ()
        out = {}
        for k, f in enumerate(terms):
            n, total = got[2 * k], got[2 * k + 1] or 0
            out[f] = (n, total / n if n else 0.0, {t: got[2 * len(terms) + i] for i, (g, t) in enumerate(asked) if g == f})
        return out

    def dictionary(self, f: str) -> DataFrame:
        """The terms."""
        return self._tokens([f]).select(F.explode(F.array_distinct(F.col(f"`{f}`"))).alias("term")).distinct()


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_row_id, term, tf, positions, dl) of rows (_row_id, tokens), slice by slice of a batch."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < batch.num_rows:
            before = int(ends[a - 1]) if a else 0
            b = max(a + 1, int(np.searchsorted(ends, before + SLICE_TOKENS, "right")))
            yield _posted(batch.slice(a, b - a), np.diff(ends[a:b], prepend=before))
            a = b
        del batch
        pa.default_memory_pool().release_unused()


def _posted(batch: pa.RecordBatch, dl: np.ndarray) -> pa.RecordBatch:
    """The postings of rows of dl tokens each."""
    coded = batch.column(1).flatten().dictionary_encode()
    row, code = np.repeat(np.arange(len(dl)), dl), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.arange(len(row)) - np.repeat(np.cumsum(dl) - dl, dl)
    order = np.argsort(row * np.int64(len(coded.dictionary) + 1) + code, kind="stable")
    row, code, at = row[order], code[order], at[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    ends = np.append(new, len(row))
    positions = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(at, pa.int32()))
    return pa.record_batch([batch.column(0).take(pa.array(row[new])), coded.dictionary.take(pa.array(code[new])), pa.array(np.diff(ends), pa.int32()), positions, pa.array(dl[row[new]], pa.int32())], names=["_row_id", "term", "tf", "positions", "dl"])


class PostingRows:
    """Rows made of postings (field, term, _row_id, tf, positions, dl); lengths: field, n, total, all rows: _row_id."""

    def __init__(self, postings: DataFrame, lengths: dict[str, tuple[int, float]], all_rows: DataFrame, fields: dict[str, str]) -> None:
        self.postings, self.lengths, self.all_rows, self.analyzer = postings, lengths, all_rows, dict(fields)

    @staticmethod
    def build(docs: DataFrame, fields: dict[str, str], id_column: str = "_row_id") -> DataFrame:
        """The postings of a table; a row's are made where its text is, nothing is shuffled."""
        parts = []
        for f, a in fields.items():
            tokens = docs.select(F.col(id_column).cast("long").alias("_row_id"), F.col(f"`{f}`").alias("text")).where("text IS NOT NULL").select("_row_id", analyzers.tokens(F.col("text"), a).alias("t"))
            each = tokens.mapInArrow(_postings, "_row_id long, term string, tf int, positions array<int>, dl int")
            parts.append(each.select(F.lit(f).alias("field"), "term", "_row_id", "tf", "positions", "dl"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def gather(self, terms: dict[str, set[str]], patterns: list[Pattern]) -> None:
        """All of it is there."""

    def _of(self, f: str, term: str) -> Column:
        return F.col("terms")[F.lit(f"{f}\0{term}")]

    def dl(self, f: str) -> Column:
        return F.col("lengths")[F.lit(f)]

    def tf(self, f: str, term: str) -> Column:
        return F.coalesce(self._of(f, term)["tf"], F.lit(0))

    def positions(self, f: str, term: str) -> Column:
        return F.coalesce(self._of(f, term)["positions"], F.array().cast("array<int>"))

    def any_token(self, f: str, spec: Pattern) -> Column:
        return F.coalesce(F.exists(F.col("patterns"), lambda p: p == repr(spec)), F.lit(False))

    def prepare(self, terms: dict[str, set[str]], patterns: list[Pattern], every_row: bool) -> DataFrame:
        wanted = F.lit(False)
        for f, ts in terms.items():
            if ts:
                wanted |= (F.col("field") == f) & F.col("term").isin(sorted(ts))
        hit = lambda p: (F.col("field") == p.field) & p.test(F.col("term"))
        needed = wanted
        for p in patterns:
            needed |= hit(p)
        entry = F.when(wanted, F.struct(F.concat_ws("\0", "field", "term").alias("key"), F.struct("tf", "positions").alias("value")))
        marks = [F.when(hit(p), F.lit(repr(p))) for p in patterns]
        rows = self.postings.where(needed).select("_row_id", entry.alias("entry"), F.array_compact(F.array(*marks)).alias("marks") if marks else F.array().cast("array<string>").alias("marks"), F.struct("field", "dl").alias("length"))
        out = rows.groupBy("_row_id").agg(
            F.map_from_entries(F.collect_list("entry")).alias("terms"),
            F.flatten(F.collect_set("marks")).alias("patterns"),
            F.map_from_entries(F.collect_set("length")).alias("lengths"),
        )
        return self.all_rows.select("_row_id").join(out, "_row_id", "left") if every_row else out

    def statistics(self, terms: dict[str, set[str]]) -> dict[str, tuple[int, float, dict[str, int]]]:
        out = {}
        for f, ts in terms.items():
            n, total = self.lengths.get(f, (0, 0))
            found = self.postings.where((F.col("field") == f) & F.col("term").isin(sorted(ts))).groupBy("term").count().collect() if ts else []  # the query's terms
            out[f] = (n, total / n if n else 0.0, {t: 0 for t in ts} | {r["term"]: r["count"] for r in found})
        return out

    def dictionary(self, f: str) -> DataFrame:
        return self.postings.where(F.col("field") == f).select("term").distinct()


def expand(source, f: str, word: str, max_edits: int, prefix_length: int, max_expansions: int) -> list[tuple[str, float]]:
    """The terms within max_edits of word and their boosts, the nearest first; executors find them, max_expansions of each
    task at most are sorted."""
    if not max_edits:
        return [(word, 1.0)]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, str]] = []
        for batch in batches:
            best += [(d, t) for t in batch.column(0).to_pylist() if (d := edits(t, word, max_edits)) <= max_edits]
            best = sorted(best)[:max_expansions]
        yield pa.record_batch([pa.array([d for d, _ in best], pa.int32()), pa.array([t for _, t in best], pa.string())], names=["d", "term"])

    t = F.col("term")
    near = (F.abs(F.length(t) - len(word)) <= max_edits) & t.startswith(word[:prefix_length]) & (F.levenshtein(t, F.lit(word), 2 * max_edits) >= 0)
    best = source.dictionary(f).where(near).select("term").mapInArrow(nearest, "d int, term string").orderBy("d", "term").limit(max_expansions).collect()
    return [(r.term, 1.0 if r.d == 0 else 1.0 - r.d / min(len(r.term), len(word))) for r in best]


class Compiler:
    def __init__(self, source, spec: Spec) -> None:
        self.source, self.spec = source, spec
        self.patterns: list[Pattern] = []
        self.terms: dict[str, set[str]] = {}
        self.expanded: dict[tuple, list[tuple[str, float]]] = {}
        for leaf in leaves(spec):
            if isinstance(leaf, Bool):
                continue
            if leaf.field not in source.analyzer:
                raise ValueError(f"{leaf.field} is no text field")
            if isinstance(leaf, Pattern):
                self.patterns.append(leaf)
                continue
            self.terms.setdefault(leaf.field, set()).update(t for group in self.groups(leaf) for t, _ in group)
        source.gather(self.terms, self.patterns)
        self.stats = source.statistics(self.terms)

    def groups(self, leaf: Spec) -> list[list[tuple[str, float]]]:
        """For each word of a leaf the terms that stand for it."""
        if isinstance(leaf, Term):
            return [[(leaf.value, 1.0)]]
        if isinstance(leaf, Fuzzy):
            return [self._expanded(leaf.field, leaf.value, leaf.max_edits, leaf.prefix_length, leaf.max_expansions)]
        words = analyzers.analyze(leaf.text, self.source.analyzer[leaf.field])
        if isinstance(leaf, Phrase):
            return [[(w, 1.0)] for w in words]
        p = leaf.params
        return [self._expanded(leaf.field, w, p.edits(w), p.prefix_length, p.max_expansions) for w in words]

    def _expanded(self, *key) -> list[tuple[str, float]]:
        if key not in self.expanded:
            self.expanded[key] = expand(self.source, *key)
        return self.expanded[key]

    def idf(self, f: str, df: int) -> float:
        n = self.stats[f][0]
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def bm25(self, f: str, freq: Column, idf: float) -> Column:
        mean = self.stats[f][1] or 1.0
        return F.lit(idf) * freq / (freq + F.lit(K1) * (F.lit(1 - B) + F.lit(B / mean) * self.source.dl(f)))

    def word(self, f: str, group: list[tuple[str, float]]) -> tuple[Column, Column]:
        """Any term of a group, with the document frequency of the most frequent one."""
        if not group:
            return F.lit(False), F.lit(0.0)
        idf = self.idf(f, max(self.stats[f][2][t] for t, _ in group))
        match, score = F.lit(False), F.lit(0.0)
        for t, boost in group:
            tf = self.source.tf(f, t)
            match |= tf > 0
            score += F.when(tf > 0, F.lit(boost) * self.bm25(f, tf, idf)).otherwise(0.0)
        return match, score

    def phrase(self, leaf: Phrase) -> tuple[Column, Column]:
        words = analyzers.analyze(leaf.text, self.source.analyzer[leaf.field])
        if len(words) < 2:
            return self.word(leaf.field, [(words[0], 1.0)]) if words else (F.lit(False), F.lit(0.0))
        lists = [_shifted(self.source.positions(leaf.field, w), k) for k, w in enumerate(words)]
        if leaf.slop == 0:
            common = lists[0]
            for other in lists[1:]:
                common = F.array_intersect(common, other)
            freq = F.size(common).cast("double")
        else:
            starts = F.array_distinct(F.flatten(F.array(*lists)))
            spreads = F.filter(F.transform(starts, lambda x: self._spread(leaf.field, words, x)), lambda d: d <= leaf.slop)
            freq = F.aggregate(F.transform(spreads, lambda d: 1.0 / (1 + d)), F.lit(0.0), lambda a, b: a + b)
        freq = F.coalesce(F.when(F.size(lists[0]) >= 0, freq), F.lit(0.0))
        idf = sum(self.idf(leaf.field, self.stats[leaf.field][2][w]) for w in words)
        return freq > 0, F.when(freq > 0, self.bm25(leaf.field, freq, idf)).otherwise(0.0)

    def _spread(self, f: str, words: list[str], x: Column) -> Column:
        """How far the nearest places of the words from x on, each less its place in the phrase, reach beyond x; null if a
        word has none or none is at x. Of equal words each takes a position after the one before it."""

        def from_word(k: int, least: Column, most: Column, taken: dict[str, Column]) -> Column:
            if k == len(words):
                return F.when(least == x, most - x)
            begin = F.greatest(x + k, taken[words[k]] + 1) if words[k] in taken else x + k
            place = F.array_min(F.filter(self.source.positions(f, words[k]), lambda y: y >= begin))
            # bound once, as an array of one
            bound = lambda p: F.when(p.isNotNull(), from_word(k + 1, F.least(least, p - k), F.greatest(most, p - k), taken | {words[k]: p}))
            return F.transform(F.array(place), bound)[0]

        return from_word(0, F.lit(1 << 30), F.lit(-(1 << 30)), {})

    def columns(self, spec: Spec) -> tuple[Column, Column]:
        """Whether a row matches, and its score if it does."""
        if isinstance(spec, Pattern):
            return self.source.any_token(spec.field, spec), F.lit(1.0)
        if isinstance(spec, Phrase):
            return self.phrase(spec)
        if isinstance(spec, (Match, Term, Fuzzy)):
            parts = [self.word(spec.field, g) for g in self.groups(spec)]
            if not parts:
                return F.lit(False), F.lit(0.0)
            every = isinstance(spec, Match) and spec.params.operator.upper() == "AND"
            match = parts[0][0]
            for m, _ in parts[1:]:
                match = match & m if every else match | m
            score = sum((s for _, s in parts[1:]), parts[0][1])
            boost = spec.params.boost if isinstance(spec, Match) else 1.0
            return match, score if boost == 1 else score * boost
        if isinstance(spec, Weighted):
            match, score = self.columns(spec.of)
            return match, score * spec.boost
        if isinstance(spec, Boost):
            match, score = self.columns(spec.positive)
            lowered, _ = self.columns(spec.negative)
            return match, F.when(lowered, score * spec.negative_boost).otherwise(score)
        must, should, must_not = (tuple(map(self.columns, x)) for x in (spec.must, spec.should, spec.must_not))
        match, score = F.lit(True), F.lit(0.0)
        if not must and not should:
            score = F.lit(1.0)
        for m, s in must:
            match, score = match & m, score + s
        some = F.lit(bool(must) or not should)
        for m, s in should:
            some, score = some | m, score + F.when(m, s).otherwise(0.0)
        match &= some
        for m, _ in must_not:
            match &= ~m
        return match, score

    def scored(self) -> DataFrame:
        """_row_id and score of all rows that match."""
        match, score = self.columns(self.spec)
        rows = self.source.prepare(self.terms, self.patterns, matches_without_terms(self.spec))
        return rows.where(match).select("_row_id", score.alias("score"))


def _shifted(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda p: p - F.lit(by))


def matches_without_terms(spec: Spec) -> bool:
    """Whether rows may match that have none of the query's terms."""
    if isinstance(spec, Bool):
        if spec.must:
            return all(map(matches_without_terms, spec.must))
        return not spec.should or any(map(matches_without_terms, spec.should))
    return matches_without_terms(spec.positive) if isinstance(spec, Boost) else matches_without_terms(spec.of) if isinstance(spec, Weighted) else False


def search(source, spec: Spec, k: int) -> DataFrame:
    """The k best rows: _row_id, score; the lower row of equal ones."""
    return Compiler(source, spec).scored().orderBy(F.desc("score"), F.asc("_row_id")).limit(top_k(k))


def matching(source, spec: Spec) -> DataFrame:
    """_row_id of all rows that match, unscored."""
    return Compiler(source, spec).scored().select("_row_id")
