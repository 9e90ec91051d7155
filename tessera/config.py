"""Declared fields of an index and the parameters of its queries, all validated when they are made."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from enum import Enum
from types import MappingProxyType


class Kind(Enum):
    VECTOR = "vector"
    FULLTEXT = "fulltext"
    SCALAR = "scalar"
    KEYWORD = "keyword"
    GEO_POINT = "geo_point"
    DATE = "date"


class Scalar(Enum):
    INT = "int"
    LONG = "bigint"
    FLOAT = "float"
    DOUBLE = "double"
    KEYWORD = "string"
    DATE = "epoch"

    @property
    def multi(self) -> bool:
        """Whether a row may have several values."""
        return self in (Scalar.INT, Scalar.LONG, Scalar.KEYWORD)


METRICS = {
    "l2": "l2", "euclidean": "l2",
    "dot_product": "dot_product", "dp": "dot_product",
    "inner_product": "inner_product", "mip": "inner_product", "maximum_inner_product": "inner_product",
    "cosine": "cosine",
}
#: sources.index.register_vector_algorithm adds others.
ALGORITHMS = {"EXACT", "HNSW", "INT8_HNSW", "IVF", "NATIVE"}
MAX_DIMENSION = 4096


def metric(name: str | None) -> str:
    got = METRICS.get((name or "l2").lower())
    if not got:
        raise ValueError(f"unknown metric {name!r}")
    return got


@dataclass(frozen=True)
class Field:
    """One indexed column: its kind, and what that kind needs."""

    name: str
    kind: Kind
    scalar: Scalar | None = None
    dimension: int = 0
    analyzer: str = "standard"
    algorithm: str | None = None
    params: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.name:
            raise ValueError("a field needs a name")
        if self.kind is Kind.VECTOR and not 0 < self.dimension <= MAX_DIMENSION:
            raise ValueError(f"dimension {self.dimension} is not from 1 to {MAX_DIMENSION}")
        if self.kind is Kind.SCALAR and self.scalar is None:
            raise ValueError("a scalar field needs its type")
        if self.algorithm is not None and self.algorithm.upper() not in ALGORITHMS:
            raise ValueError(f"unknown vector algorithm {self.algorithm!r}")
        object.__setattr__(self, "params", MappingProxyType(dict(self.params)))
        metric(self.params.get("metric"))

    def integer(self, name: str, default: int) -> int:
        value = self.params.get(name)
        try:
            return default if value is None else int(value)
        except ValueError:
            raise ValueError(f"{self.name}: {name} is not an integer: {value!r}") from None

    @property
    def metric(self) -> str:
        return metric(self.params.get("metric"))


def fields(*given: Field) -> dict[str, Field]:
    out = {f.name: f for f in given}
    if len(out) < len(given):
        raise ValueError("two fields have one name")
    return out


@dataclass(frozen=True)
class TextParams:
    """How the words of a match are joined, weighed and loosened; fuzziness AUTO is -1."""

    operator: str = "OR"
    boost: float = 1.0
    fuzziness: int | None = None
    max_expansions: int = 50
    prefix_length: int = 0

    def __post_init__(self) -> None:
        if self.operator.upper() not in ("OR", "AND"):
            raise ValueError(f"operator {self.operator!r} is neither OR nor AND")
        if not (math.isfinite(self.boost) and self.boost >= 0):
            raise ValueError("boost must be finite and not negative")
        if self.fuzziness not in (None, -1, 0, 1, 2):
            raise ValueError("fuzziness must be none, AUTO (-1), 0, 1 or 2")
        if self.max_expansions <= 0 or self.prefix_length < 0:
            raise ValueError("max_expansions must be positive and prefix_length not negative")

    def edits(self, term: str) -> int:
        if self.fuzziness is None:
            return 0
        return self.fuzziness if self.fuzziness >= 0 else 0 if len(term) <= 2 else 1 if len(term) <= 5 else 2


def top_k(k: int) -> int:
    if k <= 0:
        raise ValueError("top_k must be positive")
    return k
