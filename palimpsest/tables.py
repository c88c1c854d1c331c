"""Tables of the data model: their keys and how they are loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Key columns of the three versioned relations.
KEYS = {
    "entity": ["id"],
    "observation": ["id"],
    "relationship": ["from_id", "to_id", "relation_type"],
}

#: The reserved entity that stands for the user of the memory.
USER_PROFILE = "global_user_profile"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
