"""Validity-versioned relations: as-of reads, history, retraction, evolution.

A row of a versioned relation is one version ``(key..., valid_from, asserted)``.
The record of a key at time ``t`` is its version with the largest
``valid_from <= t``; at equal times a retraction wins. A key whose latest
version is a retraction has no record. Rows without ``valid_from`` take no
part. Versions equal in key, time and flag are taken as one; if they differ
otherwise, a fixed one of them is kept (smallest hash of the other columns).
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_as_of(text: str | None) -> datetime | None:
    """Argument of an as-of read: ``None`` means now.

    Empty or ``NOW``: now. Digits: epoch milliseconds, or microseconds from 15
    digits on. Otherwise an ISO time, UTC if it names no zone. Anything else
    raises ``ValueError``.
    """
    text = (text or "").strip()
    if not text or text.upper() == "NOW":
        return None
    if text.isdigit():
        micros = int(text) * (1 if len(text) >= 15 else 1000)
        return datetime.fromtimestamp(micros / 1e6, UTC).replace(tzinfo=None)
    try:
        at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    except ValueError:
        raise ValueError("Invalid as_of format") from None
    return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at


def as_of(df: DataFrame, keys: list[str], at: datetime | str | Column | None = None) -> DataFrame:
    """The records that are valid at ``at`` (now, if None), with all columns of ``df``.

    One shuffle by key. Spark keeps one row per key already before the shuffle
    (group limit of the window), so a key with very many versions is no
    hot spot. An empty table gives an empty table.
    """
    df = df.filter(F.col("valid_from").isNotNull())
    if at is not None:
        df = df.filter(F.col("valid_from") <= (at if isinstance(at, Column) else F.lit(at).cast("timestamp_ntz" if dict(df.dtypes)["valid_from"] == "timestamp_ntz" else "timestamp")))
    rest = [c for c in df.columns if c not in (*keys, "valid_from", "asserted", "ingested_at")]
    order = [F.col("valid_from").desc(), F.col("asserted").asc()] + ([F.xxhash64(*rest).asc()] if rest else [])
    latest = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_version", F.row_number().over(latest)).filter("_version = 1 AND asserted").drop("_version")


def current(df: DataFrame, keys: list[str]) -> DataFrame:
    """The records valid now."""
    return as_of(df, keys)


def history(df: DataFrame, keys: list[str]) -> DataFrame:
    """All versions, retractions included, each delivered version once, with its number per key."""
    once = df.dropDuplicates([*keys, "valid_from", "asserted"])
    order = Window.partitionBy(*keys).orderBy(F.col("valid_from"), F.col("asserted").desc())
    return once.withColumn("version_no", F.row_number().over(order))


def assert_rows(log: DataFrame, rows: DataFrame, at: Column) -> DataFrame:
    """The log with ``rows`` asserted at ``at``; columns missing in ``rows`` become null."""
    return log.unionByName(rows.withColumn("valid_from", at).withColumn("asserted", F.lit(True)), allowMissingColumns=True)


def retract(log: DataFrame, keys: list[str], which: DataFrame, at: Column) -> DataFrame:
    """The log with a retraction at ``at`` for each current key of ``which`` (soft delete)."""
    gone = current(log, keys).join(which.select(*keys).distinct(), keys, "left_semi")
    return log.unionByName(gone.withColumn("valid_from", at).withColumn("asserted", F.lit(False)))


def purge(df: DataFrame, which: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Remove all versions whose columns match ``which`` (hard delete); ``pairs`` maps column to column."""
    right = which.select(*[F.col(b).alias(f"_{b}") for b in pairs.values()]).distinct()
    on = [df[a] == right[f"_{b}"] for a, b in pairs.items()]
    return df.join(right, on, "left_anti")


def evolution(df: DataFrame, keys: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Version log of relations with ``op`` ASSERTED or RETRACTED, limited to [since, until]."""
    out = history(df, keys).withColumn("op", F.when(F.col("asserted"), "ASSERTED").otherwise("RETRACTED"))
    if since:
        out = out.filter(F.col("valid_from") >= F.lit(since).cast("timestamp"))
    if until:
        out = out.filter(F.col("valid_from") <= F.lit(until).cast("timestamp"))
    return out


def merge_metadata(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects of scalars; keys of ``new`` win, null counts as empty."""
    kind = "map<string,string>"
    a, b = (F.coalesce(F.from_json(c, kind), F.create_map().cast(kind)) for c in (old, new))
    kept = F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k))
    return F.to_json(F.map_concat(kept, b))
