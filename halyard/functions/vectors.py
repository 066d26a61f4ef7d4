"""Column expressions on vectors and on sorted arrays of squared distances (ascending, as `knn` returns them)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance, summed from the first dimension to the last in double precision."""
    parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def need(dists: Column, k: int) -> Column:
    """The array, or an error if it holds fewer than k distances."""
    return F.when(F.size(dists) >= k, dists).otherwise(F.raise_error(F.lit(f"fewer than {k} distances")).cast("array<double>"))


def knn_distance(dists: Column, k: int) -> Column:
    return F.sqrt(F.element_at(need(dists, k), k))


def concentration(dists: Column, k: int) -> Column:
    """Nearest over k-th distance; 1 if the k-th is 0."""
    d = knn_distance(dists, k)
    return F.when(d == 0, F.lit(1.0)).otherwise(F.sqrt(F.element_at(dists, 1)) / d)


def local_dimension(dists: Column, k: int) -> Column:
    """Maximum-likelihood local intrinsic dimension; 0 if a distance is 0, infinite if all are equal."""
    if k < 2:
        raise ValueError("local_dimension: k must be at least 2")
    d = knn_distance(dists, k)
    logs = F.aggregate(F.slice(dists, 1, k - 1), F.lit(0.0), lambda s, x: s + F.ln(F.sqrt(x) / d))
    return (F.when((d == 0) | F.exists(F.slice(dists, 1, k - 1), lambda x: x == 0), F.lit(0.0))
            .when(logs == 0, F.lit(float("inf"))).otherwise(-F.lit(float(k - 1)) / logs))


def recall(found: Column, truth: Column, k: int) -> Column:
    """Share of the true k ids among the first k found."""
    return F.size(F.array_intersect(F.slice(found, 1, k), F.slice(truth, 1, k))) / F.lit(float(k))


def tie_recall(found_dists: Column, truth_dists: Column, k: int) -> Column:
    """Share of found distances within the true k-th one, widened by one in a million, in single precision."""
    limit = F.element_at(truth_dists, k).cast("float") * F.lit(1.000001).cast("float")
    return F.size(F.filter(F.slice(found_dists, 1, k), lambda d: d.cast("float") <= limit)) / F.lit(float(k))


def passes(recall_column: Column) -> Column:
    return recall_column >= 1 - 1e-9


def centroid_columns(vectors, column: str = "embedding"):
    """One row: the element-wise mean of all vectors, by partial sums of (dimension, value)."""
    parts = vectors.select(F.posexplode(column).alias("dim", "x"))
    means = parts.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"))
