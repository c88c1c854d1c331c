"""Fusion of ranked lists. A list is (id, score) with a ``path`` name; lists are unioned, never joined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stack(paths: dict[str, DataFrame]) -> DataFrame:
    """(path, id, score) of several lists."""
    parts = [df.select(F.lit(name).alias("path"), "id", F.col("score").cast("double")) for name, df in paths.items()]
    return reduce(DataFrame.unionByName, parts)


def _weight(weights: dict[str, float]):
    return F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("path"))


def rrf(paths: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of weight / (k + rank + 1) with ranks from 0. The lists are short (top-k), one window per list."""
    order = Window.partitionBy("path").orderBy(F.col("score").desc(), "id")
    ranked = paths.withColumn("rank", F.row_number().over(order) - 1)
    part = _weight(weights) / (F.col("rank") + (k + 1))
    return ranked.groupBy("id").agg(F.round(F.sum(part), 6).alias("fused"), F.count("*").cast("long").alias("n_paths"))


def weighted_sum(paths: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Sum of weight * score."""
    return paths.groupBy("id").agg(F.round(F.sum(_weight(weights) * F.col("score")), 6).alias("fused"), F.count("*").cast("long").alias("n_paths"))


def maximum(paths: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Largest weight * score."""
    return paths.groupBy("id").agg(F.round(F.max(_weight(weights) * F.col("score")), 6).alias("fused"), F.count("*").cast("long").alias("n_paths"))


FUSIONS = {"rrf": rrf, "weighted_sum": weighted_sum, "max": maximum, "adaptive": rrf}
