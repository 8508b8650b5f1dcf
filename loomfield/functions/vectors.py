"""Distances, scores and representations of vectors, as column expressions and as numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = {"cosine-normalized": "cosine-normalized", "cosine": "cosine", "inner-product": "inner-product", "dot-product": "inner-product", "l2": "l2", "euclidean": "l2", "hamming": "hamming"}
PRECISIONS = {"float32": "float32", "fp32": "float32", "float16": "float16", "fp16": "float16", "bfloat16": "bfloat16", "bfp16": "bfloat16", "bf16": "bfloat16", "int8": "int8", "i8": "int8", "uint8": "int8", "binary": "binary", "bit": "binary", "ubinary": "binary"}


def metric(name: str | None, precision: str = "float32") -> tuple[str, str]:
    """Metric and precision by their plain names; the metric's default depends on the precision, and hamming goes with binary only."""
    p = PRECISIONS[precision]
    m = METRICS[name] if name else ("hamming" if p == "binary" else "cosine-normalized")
    if (m == "hamming") != (p == "binary"):
        raise ValueError(f"metric {m} doesn't go with precision {p}")
    return m, p


def rerank_metric(name: str) -> str:
    return "cosine" if name == "hamming" else name


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(name: str, a: Column, b: Column) -> Column:
    if name in ("cosine-normalized", "inner-product"):
        return 1 - dot(a, b)
    if name == "cosine":
        n = norm(a) * norm(b)
        return F.when(n == 0, 1.0).otherwise(1 - dot(a, b) / n)
    if name == "l2":
        return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(F.zip_with(bits(a), bits(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x).cast("double")


def score(name: str, d: Column, dims: int = 1) -> Column:
    return {"l2": 1 / (1 + d), "inner-product": -d, "hamming": 1 - d / dims}.get(name, 1 - d)


def bits(a: Column) -> Column:
    """Signs as bits, 32 to a number, the first in the lowest bit."""
    starts = F.sequence(F.lit(1), F.size(a), F.lit(32))
    return F.transform(starts, lambda s: F.aggregate(F.transform(F.slice(a, s, F.lit(32)), lambda x, i: F.when(x > 0, F.expr("shiftleft(1L, 0)") * F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda t, x: t + x))


def truncated(a: Column, dims: int | None = None, normalized: bool = True) -> Column:
    """The first dims values, then scaled to length 1 (a zero vector stays)."""
    a = F.slice(a, 1, dims) if dims else a
    if not normalized:
        return a
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n).cast("float"))


def rounded(x: Column, digits: int) -> Column:
    """x to so many decimals; what is below 0 and comes to 0 keeps its sign, as in SQL."""
    x = x.cast("double")
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)


def quantized(x: np.ndarray, precision: str) -> np.ndarray:
    """What a representation keeps of the rows of x, as float64; signs (0 and 1) for binary."""
    if precision == "float16":
        return x.astype(np.float16).astype(np.float64)
    if precision == "bfloat16":
        u = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
        u = ((u + 0x7FFF + ((u >> 16) & 1)) & 0xFFFF0000).astype(np.uint32)
        return u.view(np.float32).astype(np.float64)
    if precision == "int8":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.clip(np.rint(x / np.where(n == 0, 1, n) * 127), -127, 127) / 127 * np.where(n == 0, 1, n)
    if precision == "binary":
        if x.shape[1] % 8:
            raise ValueError("binary vectors need a multiple of 8 dimensions")
        return (x > 0).astype(np.float64)
    return x.astype(np.float64)


def _score(name: str, s: np.ndarray, qq: np.ndarray, xx: np.ndarray, dims: int) -> np.ndarray:
    """Scores by products and squared lengths."""
    if name == "l2":
        return 1 / (1 + np.maximum(0, qq + xx - 2 * s))
    if name == "hamming":
        return 1 - (qq + xx - 2 * s) / max(1, dims)
    if name == "cosine":
        n = np.sqrt(qq) * np.sqrt(xx)
        return np.where(n == 0, 0.0, s / np.where(n == 0, 1, n))
    return s - 1 if name == "inner-product" else s


def scores(name: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of each row of q with each of x."""
    return _score(name, q @ x.T, (q * q).sum(1)[:, None], (x * x).sum(1)[None], q.shape[1])


def paired(name: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Scores of each row of q with the same row of x."""
    return _score(name, np.einsum("ij,ij->i", q, x), (q * q).sum(1), (x * x).sum(1), q.shape[1])


def rough(name: str, x: np.ndarray, query: bool) -> np.ndarray:
    """Rows in single precision, of queries and of vectors, whose products grow with the score."""
    if name in ("l2", "hamming"):
        x = np.c_[2 * x, np.ones(len(x))] if query else np.c_[x, -(x * x).sum(1)]
    elif name == "cosine":
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)
    return np.ascontiguousarray(x, np.float32)


def needed(name: str, q: np.ndarray, score: np.ndarray) -> np.ndarray:
    """The product of rough rows that a score of each row of q takes."""
    if name == "l2":
        return np.where(score > 0, (q * q).sum(1) + 1 - 1 / np.where(score > 0, score, 1), -np.inf)
    if name == "hamming":
        return q.sum(1) - (1 - score) * max(1, q.shape[1])
    return score + 1 if name == "inner-product" else score
