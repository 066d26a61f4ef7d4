"""Descriptions of tables: summaries of columns, dense bin counts, profiles of groups, matrices of ranks, wide curves, report text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats


def describe(df: DataFrame, names: list[str]) -> DataFrame:
    """(column, n, mean, std, least, q25, median, q75, most) of numeric columns in one pass; nulls don't count, std is the sample's."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in names])).alias("e")
    quarter = lambda p: F.percentile("v", F.lit(p))
    return df.select(each).select("e.column", "e.v").groupBy("column").agg(
        F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("least"),
        quarter(0.25).alias("q25"), quarter(0.5).alias("median"), quarter(0.75).alias("q75"), F.max("v").alias("most"))


def bin_counts(df: DataFrame, column: str, size: int) -> DataFrame:
    """(bin, n, share) for every bin from 0 to size - 1, empty ones with 0; of an empty table the shares are null.  A value outside raises."""
    found = df.groupBy(F.col(column).cast("bigint").alias("bin")).agg(F.count("*").alias("_n"))
    inside = F.col("bin").between(0, size - 1)
    n = found.agg(F.sum(F.when(F.coalesce(inside, F.lit(False)), F.col("_n")).otherwise(F.raise_error(F.concat(F.lit("no such bin: "), F.coalesce(F.col("bin").cast("string"), F.lit("null")))))).alias("_t"))
    dense = df.sparkSession.range(size).withColumnRenamed("id", "bin").join(found, "bin", "left").crossJoin(F.broadcast(n))
    return dense.select("bin", F.coalesce("_n", F.lit(0)).cast("bigint").alias("n"), (F.coalesce("_n", F.lit(0)) / F.col("_t")).alias("share"))


def group_profile(df: DataFrame, group: str, label: str, classes: tuple[str, ...], medians: tuple[str, ...] = (), means: tuple[Column, ...] = ()) -> DataFrame:
    """One row a group: n, the share of each class, and named means and exact medians of numeric columns."""
    share = [(F.count(F.when(F.col(label) == c, 1)) / F.count("*")).alias(f"share_{c}") for c in classes]
    return df.groupBy(group).agg(F.count("*").alias("n"), *share, *means, *[F.median(c).alias(f"median_{c}") for c in medians])


def follows_grid(df: DataFrame, key: str, column: str, grid: list[int]) -> DataFrame:
    """(key, same): whether the values of a key are exactly the grid, each once; compared by counts, so that no list is built."""
    points = set(grid)
    right = F.col(column).isin(*points) & (F.col("_n") == 1)
    return df.groupBy(key, column).agg(F.count("*").alias("_n")).groupBy(key).agg(((F.count("*") == len(points)) & (F.count(F.when(right, 1)) == len(points))).alias("same"))


def wide(df: DataFrame, key: str, column: str, grid: list[int], value: str) -> DataFrame:
    """One row a key, one column for each point of the grid (named value_point); a missing point is null.  One aggregate, no pivot's extra pass."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(column) == g, F.col(value))).alias(f"{value}_{g}") for g in grid])


def rank_matrix(df: DataFrame, names: list[str], digits: int = 4) -> DataFrame:
    """(a, b, rho) for every ordered pair of columns: rank correlations, rounded; a column that is constant has null."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, a in enumerate(names) for b in names[i:]])).alias("e")
    half = stats.spearman(df.select(pairs).select("e.*"), "x", "y", "a", "b").select("a", "b", F.round("rho", digits).alias("rho"))
    return half.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(F.struct("a", "b", "rho"))).otherwise(
        F.array(F.struct("a", "b", "rho"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "rho")))).alias("e")).select("e.*")


def markdown(df: DataFrame, digits: int = 4, most: int = 1000) -> str:
    """A report's table as Markdown; more than `most` rows raise, as a report is no place for a data table."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows in a report")
    text = lambda v: "" if v is None else f"{v:.{digits}g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(map(text, r)) + " |" for r in rows]])
