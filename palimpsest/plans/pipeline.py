"""Composable retrieval: stages that map a frame of hits (id, score, ...) to another, with a path text that explains a hit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def run(hits: DataFrame, stages: list[Stage | tuple[bool, Stage]]) -> DataFrame:
    """Apply stages in order; a pair (condition, stage) is skipped where the condition is false."""
    for stage in stages:
        if isinstance(stage, tuple):
            if not stage[0]:
                continue
            stage = stage[1]
        hits = hits.transform(stage)
    return hits


def at_least(score: float) -> Stage:
    return lambda df: df.filter(F.col("score") >= score)


def best(limit: int) -> Stage:
    return lambda df: df.orderBy(F.col("score").desc(), "id").limit(limit)


def once_per(column: str) -> Stage:
    """The best hit of each value of a column; rows with a null value count as one value."""
    return lambda df: df.groupBy(column).agg(F.max_by(F.struct(*df.columns), F.struct("score", "id")).alias("r")).select("r.*")


def path_text(relations: DataFrame, entity: DataFrame) -> DataFrame:
    """(from_id, to_id, path): ``A --[type:0.900]--> B`` of each relation, ids where there is no name."""
    a, b = entity.select(F.col("id").alias("from_id"), F.col("name").alias("a")), entity.select(F.col("id").alias("to_id"), F.col("name").alias("b"))
    r = relations.join(a, "from_id", "left").join(b, "to_id", "left")
    return r.select("from_id", "to_id", "relation_type", F.format_string("%s --[%s:%.3f]--> %s", F.coalesce("a", "from_id"), F.col("relation_type"), F.coalesce("strength", F.lit(0.0)), F.coalesce("b", "to_id")).alias("path"))
