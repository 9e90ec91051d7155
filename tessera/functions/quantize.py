"""Optimised scalar quantisation of vectors around a centroid.

Each vector, less its centroid, gets an interval of its own: first a multiple of its spread that suits normal values,
then a few steps of coordinate descent on the error, weighted so that the error along the vector counts more.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

import numpy as np

BITS = (1, 2, 4, 7, 8)
LAMBDA, STEPS = 0.1, 5


class Statistics(NamedTuple):
    """Of each vector: mean, variance, squared length, least and greatest value, and product with a centroid."""

    mean: np.ndarray
    variance: np.ndarray
    square: np.ndarray
    least: np.ndarray
    most: np.ndarray
    along: np.ndarray


def statistics(vectors: np.ndarray, centroid: np.ndarray) -> Statistics:
    """Of vectors less a centroid; the product is that of the vectors themselves."""
    r = vectors - centroid
    return Statistics(r.mean(1), r.var(1), np.square(r).sum(1), r.min(1), r.max(1), vectors @ centroid)


class Codes(NamedTuple):
    """Integer codes of each vector, the ends of its interval and its squared length."""

    code: np.ndarray
    low: np.ndarray
    high: np.ndarray
    square: np.ndarray


@cache
def _reach(bits: int) -> float:
    """The half width, in standard deviations, that loses least of normal values."""
    x = np.linspace(-5, 5, 4001)
    p = np.exp(-x * x / 2)
    levels = (1 << bits) - 1
    grid = np.linspace(0.5, 5, 181)
    loss = [(p * (x - (np.round((np.clip(x, -r, r) + r) * levels / (2 * r)) * 2 * r / levels - r)) ** 2).sum() for r in grid]
    return float(grid[int(np.argmin(loss))])


def quantize(residual: np.ndarray, bits: int) -> Codes:
    if bits not in BITS:
        raise ValueError(f"bits must be one of {BITS}")
    levels = (1 << bits) - 1
    mean, std = residual.mean(1), residual.std(1)
    low = np.maximum(mean - _reach(bits) * std, residual.min(1))
    high = np.minimum(mean + _reach(bits) * std, residual.max(1))
    square = np.square(residual).sum(1)
    flat = high <= low
    high = np.where(flat, low + 1e-9, high)

    def coded(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return np.round((np.clip(residual, low[:, None], high[:, None]) - low[:, None]) * (levels / (high - low))[:, None])

    def loss(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        e = residual - (low[:, None] + coded(low, high) * ((high - low) / levels)[:, None])
        along = (e * residual).sum(1)
        return (1 - LAMBDA) * np.divide(along * along, square, out=np.zeros_like(along), where=square > 0) + LAMBDA * np.square(e).sum(1)

    error = loss(low, high)
    for _ in range(STEPS):
        s = coded(low, high) / levels
        # the least weighted square error over both ends, with the codes held
        u, v = 1 - s, s
        unit = np.divide(residual, np.sqrt(square)[:, None], out=np.zeros_like(residual), where=square[:, None] > 0)
        dot = lambda a, b: LAMBDA * (a * b).sum(1) + (1 - LAMBDA) * (a * unit).sum(1) * (b * unit).sum(1)  # noqa: E731, B023
        uu, uv, vv, ux, vx = dot(u, u), dot(u, v), dot(v, v), dot(u, residual), dot(v, residual)
        det = uu * vv - uv * uv
        ok = np.abs(det) > 1e-12
        new_low = np.where(ok, (ux * vv - vx * uv) / np.where(ok, det, 1), low)
        new_high = np.where(ok, (vx * uu - ux * uv) / np.where(ok, det, 1), high)
        ok &= new_high > new_low
        new_low, new_high = np.where(ok, new_low, low), np.where(ok, new_high, high)
        new_error = loss(new_low, new_high)
        better = new_error < error - 1e-12
        if not better.any():
            break
        low, high, error = np.where(better, new_low, low), np.where(better, new_high, high), np.where(better, new_error, error)
    return Codes(coded(low, high).astype(np.uint8), low, high, square)


def quantize_each(residual: np.ndarray, bits: Iterable[int]) -> dict[int, Codes]:
    """Codes of several widths of the same vectors."""
    return {b: quantize(residual, b) for b in bits}


def _step(c: Codes, bits: int) -> np.ndarray:
    return (c.high - c.low) / ((1 << bits) - 1)


def products(c: Codes, bits: int, query: np.ndarray) -> np.ndarray:
    """The product of each coded vector with a query, without restoring the vectors."""
    return c.low * query.sum() + _step(c, bits) * (c.code.astype(np.float32) @ query.astype(np.float32))


def code_products(c: Codes, bits: int, q: Codes, query_bits: int) -> np.ndarray:
    """The products of coded vectors (rows) with coded queries (columns), of integers alone but for the corrections:
    a b n + b s sum(x) + a t sum(y) + s t x.y of vectors a + s x and queries b + t y of n values."""
    a, s, b, t = c.low[:, None], _step(c, bits)[:, None], q.low[None], _step(q, query_bits)[None]
    x, y = c.code.astype(np.int64), q.code.astype(np.int64)
    return a * b * x.shape[1] + b * s * x.sum(1)[:, None] + a * t * y.sum(1)[None] + s * t * integer_products(c.code, bits, q.code, query_bits)


def integer_products(x: np.ndarray, bits: int, y: np.ndarray, query_bits: int) -> np.ndarray:
    """x.y of integer codes: bit plane by bit plane, as the number of bits that both have, where x has one or two bits."""
    if bits > 2:
        return x.astype(np.int64) @ y.astype(np.int64).T
    planes = lambda z, n: [np.packbits(z >> k & 1, axis=1) for k in range(n)]
    out = np.zeros((len(x), len(y)), np.int64)
    for i, a in enumerate(planes(x, bits)):
        for j, b in enumerate(planes(y, query_bits)):
            for k, row in enumerate(b):
                out[:, k] += np.bitwise_count(a & row).sum(axis=1, dtype=np.int64) << (i + j)
    return out


def restored(c: Codes, bits: int) -> np.ndarray:
    return c.low[:, None] + c.code * ((c.high - c.low) / ((1 << bits) - 1))[:, None]


def packed(code: np.ndarray, bits: int) -> np.ndarray:
    """Codes as bytes: eight, four or two in each for one, two or four bits."""
    if bits == 1:
        return np.packbits(code, axis=1)
    if bits not in (2, 4):
        return code
    per = 8 // bits
    wide = np.pad(code, ((0, 0), (0, -code.shape[1] % per))).reshape(len(code), -1, per).astype(np.uint16)
    return (wide << (np.arange(per)[::-1] * bits)).sum(2).astype(np.uint8)


def unpacked(data: np.ndarray, bits: int, dimension: int) -> np.ndarray:
    if bits == 1:
        return np.unpackbits(data, axis=1)[:, :dimension]
    if bits not in (2, 4):
        return data
    per = 8 // bits
    return ((data[:, :, None] >> (np.arange(per)[::-1] * bits).astype(np.uint8)) & ((1 << bits) - 1)).reshape(len(data), -1)[:, :dimension]


def rotation(dimension: int, block: int = 32, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix of blocks after a random order of the dimensions; rows of vectors times it are rotated."""
    rng = np.random.default_rng(seed)
    out = np.zeros((dimension, dimension))
    order = rng.permutation(dimension)
    for a in range(0, dimension, block):
        n = min(block, dimension - a)
        out[order[a : a + n, None], np.arange(a, a + n)] = np.linalg.qr(rng.normal(size=(n, n)))[0]
    return out
