"""Batches of new records checked against what is there, as set operations: each row gets an outcome, the accepted ones become versions.

Rows of a batch are checked against each other as well: of several equal ones
the first (smallest id) is taken and the others count as known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.versioned import assert_rows, current

#: Metadata status values that exclude each other.
CLASH = {"active", "archived"}


def _name_key(column: str = "name"):
    return F.lower(F.trim(column))


def create_entities(log: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, outcome, entity_id) of new entities (id, name, type, metadata).

    ``blank``: no name or no type; ``conflict``: metadata that is both
    ``active`` and ``archived``; ``exists``: an entity of that name (any case)
    is there or comes earlier in the batch; ``created`` else. ``entity_id`` is
    the entity that stands for the row, null if none does.
    """
    known = current(log.select("id", "valid_from", "asserted", "name"), ["id"]).filter("trim(name) <> ''")
    known = known.groupBy(_name_key().alias("k")).agg(F.min("id").alias("known_id"))
    flags = [F.coalesce(F.get_json_object("metadata", f"$.{f}").cast("boolean"), F.lit(False)) for f in ("active", "archived")]
    b = batch.withColumn("k", _name_key())
    blank = F.coalesce(F.col("k") == "", F.lit(True)) | F.coalesce(F.trim("type") == "", F.lit(True))
    b = b.withColumn("bad", F.when(blank, "blank").when(flags[0] & flags[1], "conflict"))
    first = b.filter("bad IS NULL").groupBy("k").agg(F.min("id").alias("first_id"))
    b = b.join(known, "k", "left").join(first, "k", "left")
    outcome = F.coalesce(F.col("bad"), F.when(F.col("known_id").isNotNull() | (F.col("first_id") != F.col("id")), "exists").otherwise("created"))
    entity = F.when(F.col("bad").isNull(), F.coalesce("known_id", "first_id"))
    return b.select("id", outcome.alias("outcome"), entity.alias("entity_id"))


def add_notes(entity: DataFrame, log: DataFrame, batch: DataFrame) -> DataFrame:
    """(id, outcome, entity_id, same_as) of new notes (id, entity_id or entity_name, text).

    The entity is found by id, then by name (any case); ``new_entity``: named,
    but not there, so it is created with the note (``entity_id`` is derived from
    the name); ``no_entity``: neither; ``blank``: no text; ``duplicate``: the
    entity has a current note of exactly that text, or the batch has it earlier
    (``same_as``); ``added`` else. Similar texts are the near-duplicate operator's work.
    """
    live = current(entity.select("id", "valid_from", "asserted", "name"), ["id"])
    by_id = live.select(F.col("id").alias("entity_id"), F.lit(True).alias("there"))
    by_name = live.filter("trim(name) <> ''").groupBy(_name_key().alias("k")).agg(F.min("id").alias("named_id"))
    b = batch.withColumn("k", _name_key("entity_name")).join(by_id, "entity_id", "left").join(by_name, "k", "left")
    fresh = F.when(F.col("k") != "", F.concat(F.lit("entity:"), F.md5("k")))
    b = b.withColumn("e", F.coalesce(F.when(F.col("there"), F.col("entity_id")), F.col("named_id"), fresh))
    new = ~F.coalesce("there", F.lit(False)) & F.col("named_id").isNull()
    bad = F.when(F.col("e").isNull(), "no_entity").when(F.coalesce(F.trim("text") == "", F.lit(True)), "blank")
    b = b.select("id", F.col("e").alias("entity_id"), F.md5("text").alias("h"), new.alias("new"), bad.alias("bad"))
    notes = current(log.select("id", "valid_from", "asserted", "entity_id", "text"), ["id"])
    had = notes.filter("entity_id IS NOT NULL AND text IS NOT NULL").groupBy("entity_id", F.md5("text").alias("h")).agg(F.min("id").alias("had_id"))
    first = b.filter("bad IS NULL").groupBy("entity_id", "h").agg(F.min("id").alias("first_id"))
    b = b.join(had, ["entity_id", "h"], "left").join(first, ["entity_id", "h"], "left")
    same = F.coalesce("had_id", F.when(F.col("first_id") != F.col("id"), F.col("first_id")))
    outcome = F.coalesce(F.col("bad"), F.when(same.isNotNull(), "duplicate").when(F.col("new"), "new_entity").otherwise("added"))
    return b.select("id", outcome.alias("outcome"), "entity_id", F.when(F.col("bad").isNull(), same).alias("same_as"))


def create_relations(entity: DataFrame, log: DataFrame, batch: DataFrame) -> DataFrame:
    """(from_id, to_id, relation_type, outcome) of new relations.

    ``self_loop``: both ends are the same; ``no_entity``: an end is missing or
    has no current record; ``new_version``: the relation is there already;
    ``created`` else. Repeated rows of the batch count once.
    """
    keys = ["from_id", "to_id", "relation_type"]
    live = current(entity.select("id", "valid_from", "asserted"), ["id"]).select("id")
    b = batch.select(*keys).distinct()
    for end in ("from_id", "to_id"):
        b = b.join(live.select(F.col("id").alias(end), F.lit(True).alias(f"has_{end}")), end, "left")
    known = current(log.select(*keys, "valid_from", "asserted"), keys).select(*keys, F.lit(True).alias("known"))
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"k.{k}")) for k in keys]
    b = b.alias("b").join(known.alias("k"), on, "left")
    outcome = F.when(F.col("b.from_id") == F.col("b.to_id"), "self_loop").when(F.col("has_from_id").isNull() | F.col("has_to_id").isNull(), "no_entity")
    return b.select(*[f"b.{k}" for k in keys], outcome.when(F.col("known"), "new_version").otherwise("created").alias("outcome"))


def accepted(log: DataFrame, batch: DataFrame, outcome: DataFrame, keys: list[str], which: list[str], at: str) -> DataFrame:
    """The log with the rows of a batch asserted whose outcome is one of ``which``."""
    good = batch.join(outcome.filter(F.col("outcome").isin(which)).select(*keys).distinct(), keys, "left_semi")
    return assert_rows(log, good, F.lit(at).cast(dict(log.dtypes)["valid_from"]))


def change_status(states: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """(key, status) after changes (key, at, status): the latest change wins, what has none keeps its status; equal times by status."""
    latest = changes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("at", "status")).alias("c")).select(key, F.col("c.status").alias("_new"))
    old = states.filter(F.col(key).isNotNull() & (F.trim(key) != "")).groupBy(key).agg(F.max(F.lower("status")).alias("_old"))
    return old.join(latest, key, "full").select(key, F.coalesce("_new", "_old").alias("status"))


def touched(observation: DataFrame, accesses: DataFrame) -> DataFrame:
    """(id, access_count, last_accessed_at): accesses (id, at) added to what the metadata of the current notes say; only notes that were accessed."""
    count = F.coalesce(F.get_json_object("metadata", "$.access_count").cast("long"), F.lit(0))
    n = accesses.groupBy("id").agg(F.count("*").alias("_n"), F.max("at").alias("last_accessed_at"))
    return observation.join(n, "id").select("id", (count + F.col("_n")).alias("access_count"), "last_accessed_at")


def newest_per(df: DataFrame, group: str, limit: int, at: str = "valid_from", key: str = "id") -> DataFrame:
    """The ``limit`` newest rows of each group, cut before the shuffle."""
    order = Window.partitionBy(group).orderBy(F.col(at).desc(), key)
    return df.withColumn("_no", F.row_number().over(order)).filter(F.col("_no") <= limit).drop("_no")
