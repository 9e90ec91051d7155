"""Similarity of vectors, the higher the better, in double precision."""

from __future__ import annotations

import numpy as np


def scores(metric: str, vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """The score of each row of vectors for a query, or for each of several queries (one column each)."""
    many = query.ndim == 2
    q = np.atleast_2d(query).astype(np.float64)
    dot = vectors @ q.T
    if metric == "l2":
        # differences, not the expanded square, so that equal vectors are at distance 0
        d = np.stack([np.square(vectors - x).sum(1) for x in q], axis=1)
        out = 1 / (1 + d)
    elif metric == "dot_product":
        out = np.maximum((1 + dot) / 2, 0)
    elif metric == "inner_product":
        out = np.where(dot < 0, 1 / (1 - np.minimum(dot, 0)), dot + 1)
    else:
        norm = np.sqrt(np.square(vectors).sum(1))[:, None] * np.sqrt(np.square(q).sum(1))[None]
        out = np.maximum((1 + np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)) / 2, 0)
    return out if many else out[:, 0]


def of_product(metric: str, dot: np.ndarray) -> np.ndarray:
    """The score that a product gives; of unit vectors for cosine."""
    if metric == "inner_product":
        return np.where(dot < 0, 1 / (1 - np.minimum(dot, 0)), dot + 1)
    return np.maximum((1 + dot) / 2, 0)


def paired(metric: str, vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """The score of each row of vectors for the query of the same row."""
    if metric == "l2":
        return 1 / (1 + np.square(vectors - queries).sum(1))
    dot = np.einsum("ij,ij->i", vectors, queries)
    if metric == "dot_product":
        return np.maximum((1 + dot) / 2, 0)
    if metric == "inner_product":
        return np.where(dot < 0, 1 / (1 - np.minimum(dot, 0)), dot + 1)
    norm = np.sqrt(np.square(vectors).sum(1)) * np.sqrt(np.square(queries).sum(1))
    return np.maximum((1 + np.divide(dot, norm, out=np.zeros_like(dot), where=norm > 0)) / 2, 0)


def promising(metric: str, vectors: np.ndarray, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of all pairs that may be among a query's k best, whose k-th best was least so far.

    Distances go by the expanded square, in one product of matrices; what rounding may hide is let through.
    """
    if metric == "l2":
        a, b = np.square(vectors).sum(1), np.square(queries).sum(1)
        about = queries @ vectors.T
        about *= 2
        about -= a[None]
        about -= b[:, None]  # less the squared distance
        least, slack = np.where(least > 0, 1 - 1 / np.where(least > 0, least, 1), -np.inf), 1e-9 * (1 + a.max(initial=0) + b.max(initial=0))
    else:
        about = scores(metric, vectors, queries).T
        slack = 1e-9 * (1 + np.abs(about).max(initial=0))
    some = about >= least[:, None] - slack
    many = np.flatnonzero(np.count_nonzero(some, axis=1) > 4 * k) if len(vectors) > k else np.zeros(0, np.int64)
    if len(many):
        near = about[many]
        some[many] &= near >= np.partition(near, len(vectors) - k, axis=1)[:, len(vectors) - k, None] - slack
    query, row = np.nonzero(some)
    return row, query


def normalized(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; a zero vector stays."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=vectors.copy(), where=norm > 0)


def checked(query, dimension: int | None = None) -> np.ndarray:
    q = np.asarray(query, np.float64)
    if q.ndim != 1 or not np.isfinite(q).all():
        raise ValueError("a query vector must be a list of finite numbers")
    if dimension is not None and len(q) != dimension:
        raise ValueError(f"the query has {len(q)} dimensions, the field {dimension}")
    return q
