"""Semi- and anti-joins that no hot key can slow down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key counts as hot if it holds more than this share of all rows, so there are at most 200.
HOT_SHARE = 1 / 200


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the non-null rows: at most ``1 / share`` of them.

    Counted with map-side aggregation; the result is small whatever the data.
    """
    n = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = n.agg((F.sum("_n") * F.lit(share)).alias("_least"))
    return n.join(F.broadcast(total), F.col("_n") > F.col("_least")).select(key)


def semi_join_hot(left: DataFrame, right: DataFrame, on: list[str], how: str, hot: DataFrame, condition: Column | None = None) -> DataFrame:
    """``left`` LEFT SEMI or LEFT ANTI JOIN ``right`` on the columns ``on``, safe under skew.

    ``condition`` may compare further columns, as ``l.x`` and ``r.y``. ``hot``
    (the columns ``on``; at most 200 rows, see ``hot_keys``) is broadcast, and so
    are the rows of ``right`` that have a hot key (``right`` has few rows a key);
    rows of ``left`` with a hot key are never shuffled, the others have no hot
    key among them. ``left`` should be stored, since it is read twice.
    """

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        a, b = a.alias("l"), b.alias("r")
        both = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in on]
        return a.join(b, [*both, condition] if condition is not None else both, how)

    few = F.broadcast(hot)
    often = join(left.join(few, on, "left_semi"), F.broadcast(right.join(few, on, "left_semi")))
    return often.unionByName(join(left.join(few, on, "left_anti"), right.join(few, on, "left_anti")))
