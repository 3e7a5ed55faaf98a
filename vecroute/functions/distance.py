"""Distances between array columns, accumulated in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def _same_width(a: Column, b: Column, value: Column) -> Column:
    """``value``, or an error where the two vectors have different widths; null if either is null."""
    wrong = F.raise_error(F.concat(F.lit("vectors of width "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return F.when(F.size(a) == F.size(b), value).when(a.isNotNull() & b.isNotNull(), wrong.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _same_width(a, b, _fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    """L2 norm of the difference, not squared."""
    return F.sqrt(_same_width(a, b, _fold(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))))))


def angular(a: Column, b: Column) -> Column:
    """1 - cosine; a vector of norm 0 has similarity 0 to all."""
    length = norm(a) * norm(b)
    return F.when(length > 0, 1 - dot(a, b) / length).otherwise(F.lit(1.0))


def inner_product(a: Column, b: Column) -> Column:
    """Negated, so that less is nearer."""
    return -dot(a, b)


def hamming(a: Column, b: Column) -> Column:
    """Share of places where exactly one of the two is 0."""
    differ = F.zip_with(a, b, lambda x, y: ((x != 0) != (y != 0)).cast("double"))
    return F.when(F.size(a) > 0, _same_width(a, b, _fold(differ) / F.size(a)))


def jaccard(a: Column, b: Column) -> Column:
    """Of id arrays, not of floats: lengths count repeats, the intersection doesn't; 1 if both are empty."""
    wrong = F.raise_error(F.lit("jaccard is for arrays of ids, not of floats"))
    real = F.typeof(a).rlike("float|double|decimal") | F.typeof(b).rlike("float|double|decimal")
    both = F.when(real, wrong.cast("int")).otherwise(F.size(F.array_intersect(a, b)))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ > 0, 1 - both / all_).otherwise(F.lit(1.0))


def l2_normalize(a: Column) -> Column:
    """Unit length; a vector of norm 0 stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: (x.cast("double") / F.when(length > 0, length).otherwise(F.lit(1.0))))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "euclidean": euclidean,
    "angular": angular,
    "cosine": angular,
    "inner_product": inner_product,
    "hamming": hamming,
    "jaccard": jaccard,
}

#: Metrics of nearest-neighbour mining and block-wise reranking.
DENSE = ("euclidean", "angular", "cosine", "inner_product")


def metric(name: str) -> Callable[[Column, Column], Column]:
    if name not in METRICS:
        raise KeyError(f"unknown metric {name!r}; one of {', '.join(METRICS)}")
    return METRICS[name]


def matrix_of(lists: pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix in double precision; null or ragged vectors are an error."""
    sizes = lists.value_lengths()
    if lists.null_count or len(sizes.unique()) > 1:
        raise ValueError("vectors must all have one width, and none may be null")
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)
