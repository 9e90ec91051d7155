"""Analyzers: text to tokens, as a Column for tables and as a function for the words of a query."""

from __future__ import annotations

from collections.abc import Callable

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by the usual word boundaries: marks such as ' . : join letters, and . , ; ' join digits; ideographs stand alone.
#: Nothing is tried twice (++), and what is ASCII is told by a table before any property of a letter is looked up.
_WORD = r"{inner}++(?:(?:(?<=\p{{L}})['’.:·](?=\p{{L}})|(?<=\p{{N}})[.,;'](?=\p{{N}})){inner}++)*+|(?=[^\x00-\x7F]){single}"
_JAVA = _WORD.format(inner=r"[a-z0-9_[\p{L}\p{N}\p{M}&&[^\p{IsHan}\p{IsHiragana}]]]", single=r"[\p{IsHan}\p{IsHiragana}]")
_PYTHON = regex.compile(_WORD.format(inner=r"[[\p{L}\p{N}\p{M}_]--[\p{Han}\p{Hiragana}]]", single=r"[\p{Han}\p{Hiragana}]"), regex.V1)
MAX_TOKEN = 255

Tokenizer = tuple[Callable[[Column], Column], Callable[[str], list[str]]]


def _java(pattern: str, lower: bool = True) -> Callable[[Column], Column]:
    return lambda c: F.regexp_extract_all(F.lower(c) if lower else c, F.lit(pattern), F.lit(0))


def _split_long(tokens: Column) -> Column:
    pieces = lambda t: F.transform(F.sequence(F.lit(0), F.floor((F.length(t) - 1) / MAX_TOKEN)), lambda k: F.substring(t, (k * MAX_TOKEN + 1).cast("int"), F.lit(MAX_TOKEN)))
    return F.when(F.exists(tokens, lambda t: F.length(t) > MAX_TOKEN), F.flatten(F.transform(tokens, pieces))).otherwise(tokens)


def _python_standard(text: str) -> list[str]:
    return [t[k : k + MAX_TOKEN] for t in _PYTHON.findall(text.lower()) for k in range(0, len(t), MAX_TOKEN)]


def _missing(name: str) -> Tokenizer:
    def fail(_):
        raise NotImplementedError(f"analyzer {name} needs a segmenter: register one with register()")

    return fail, fail


_ANALYZERS: dict[str, Tokenizer] = {
    "standard": (lambda c: _split_long(_java(_JAVA)(c)), _python_standard),
    "whitespace": (lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != ""), str.split),
    "simple": (_java(r"\p{L}+"), lambda text: regex.findall(r"\p{L}+", text.lower())),
    "keyword": (lambda c: F.when(c.isNotNull(), F.array(c)), lambda text: [text]),
    "ik_smart": _missing("ik_smart"),
    "ik_max_word": _missing("ik_max_word"),
}


def register(name: str, column: Callable[[Column], Column], words: Callable[[str], list[str]]) -> None:
    """Add or replace an analyzer: column gives the tokens of a text column, words those of one text."""
    _ANALYZERS[name.lower()] = (column, words)


def _get(name: str | None) -> Tokenizer:
    got = _ANALYZERS.get((name or "standard").lower())
    if not got:
        raise ValueError(f"unknown analyzer {name!r}")
    return got


def tokens(text: Column, analyzer: str | None = None) -> Column:
    return _get(analyzer)[0](text)


def analyze(text: str, analyzer: str | None = None) -> list[str]:
    return _get(analyzer)[1](text)
