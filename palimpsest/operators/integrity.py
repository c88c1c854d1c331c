"""References to records that do not exist, and what depends on them.

``orphan_cascade`` finds direct orphans - references whose parent is missing,
deleted or begins only after the referring record - by semi-joins that compare
the period of the parent with the time of the record, and then follows the
foreign keys by further semi-joins: a record whose parent record is an orphan
is an orphan too, inherited instead of direct, to the fixpoint.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import skew, versioned
from palimpsest.session import dropped, stored
from palimpsest.tables import KEYS


def norm_id(c: Column | str) -> Column:
    """Ids are compared trimmed (any outer white space) and in lower case; empty ones are null."""
    c = F.col(c) if isinstance(c, str) else c
    trimmed = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(trimmed != "", trimmed)


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def entity_state(entity: DataFrame) -> DataFrame:
    """Per normalised id (ref_id, alive, first_at): is its latest version asserted, and when was it first asserted.

    Aggregated before the shuffle, so many versions of one id cost nothing.
    """
    rows = entity.select(norm_id("id").alias("ref_id"), micros("valid_from").alias("at"), "asserted").filter("ref_id IS NOT NULL AND at IS NOT NULL")
    # one number orders the versions: later wins, at equal times the retraction
    return rows.groupBy("ref_id").agg(
        (F.max(F.col("at") * 2 + F.when(F.col("asserted"), 0).otherwise(1)) % 2 == 0).alias("alive"),
        F.min(F.when(F.col("asserted"), F.col("at"))).alias("first_at"),
    )


def plain_state(table: DataFrame, column: str) -> DataFrame:
    """(ref_id, alive, first_at) of a table without versions: its keys, alive from the beginning."""
    ids = table.select(norm_id(column).alias("ref_id")).filter("ref_id IS NOT NULL").distinct()
    return ids.select("ref_id", F.lit(True).alias("alive"), F.lit(None).cast("long").alias("first_at"))


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` names a key of ``parent``; null and empty values are no reference."""

    child: str
    column: str
    parent: str


REFERENCE = ["src_table", "src_key", "ref_field", "ref_id", "ref_month", "kind"]


def references(children: dict[str, DataFrame], keys: list[ForeignKey]) -> DataFrame:
    """(src_table, src_key, ref_field, ref_id, at, ref_month, parent): one row per reference of a record; null and empty ones are left out.

    ``children``: per table a frame with ``key`` (of the record, as it is
    reported), ``valid_from`` and a column per foreign key. One pass over each table.
    """
    parts = []
    for name in dict.fromkeys(fk.child for fk in keys):
        own = [fk for fk in keys if fk.child == name]
        each = F.explode(F.array(*[F.struct(F.lit(fk.column).alias("ref_field"), norm_id(fk.column).alias("ref_id"), F.lit(fk.parent).alias("parent")) for fk in own]))
        rows = children[name].filter("key IS NOT NULL").select("key", "valid_from", each.alias("r"))
        parts.append(
            rows.select(
                F.lit(name).alias("src_table"), F.col("key").alias("src_key"), "r.ref_field", "r.ref_id",
                micros("valid_from").alias("at"), F.date_format("valid_from", "yyyy-MM").alias("ref_month"), "r.parent",
            ).filter("ref_id IS NOT NULL")
        )
    return functools.reduce(DataFrame.unionByName, parts)


def orphan_cascade(children: dict[str, DataFrame], parents: dict[str, DataFrame], keys: list[ForeignKey], max_rounds: int | None = None) -> DataFrame:
    """Orphans (src_table, src_key, ref_field, ref_id, ref_month, kind, depth, how), one row per record, field and referred id.

    ``children``: per table a frame with ``key``, ``valid_from`` and a column
    per foreign key, one row per current record. ``parents``: per table the
    state of its keys (ref_id, alive, first_at), as from ``entity_state`` or
    ``plain_state``; a null ``first_at`` begins before everything.

    Round 0, ``how`` direct: an anti-join with the parents that are alive and
    begin no later than the referring record leaves the orphan references; three
    disjoint semi- and anti-joins with the states tell their ``kind``:
    ``missing`` if no row of the parent exists, ``deleted`` if its latest row is
    a retraction, ``late`` if it is alive but begins after the referring record
    (a record without a time is never late). Round n, ``how`` inherited and
    ``kind`` inherited: a semi-join of the references with the orphans of the
    round before, on the foreign key; records that are orphans already are left
    out. It ends when a round adds no record, so cycles end as well, or raises
    after ``max_rounds``, if given; it never stops short in silence.

    Keys that hold more than a two-hundredth of the references are joined apart
    (``skew.semi_join_hot``), so one id may hold any share of the rows. Each
    round is stored in the shared folder, which cuts the lineage. Null keys,
    repeated rows and empty tables give no rows of their own.
    """
    refs = stored(references(children, keys), "refs")
    states = functools.reduce(DataFrame.unionByName, [s.select(F.lit(t).alias("parent"), "ref_id", "alive", "first_at") for t, s in parents.items()])
    states = stored(states, "states")
    hot = skew.hot_keys(refs.select(F.struct("parent", "ref_id").alias("k")), "k").select("k.parent", "k.ref_id")
    hot = stored(hot, "hot")
    on = ["parent", "ref_id"]

    def semi(left: DataFrame, right: DataFrame, how: str, later: Column | None = None) -> DataFrame:
        return skew.semi_join_hot(left, right, on, how, hot, later)

    begun = F.col("r.first_at").isNull() | F.col("l.at").isNull() | (F.col("r.first_at") <= F.col("l.at"))
    lost = stored(semi(refs, states.filter("alive"), "left_anti", begun), "lost")
    dead, alive = states.filter("NOT alive"), states.filter("alive")
    kinds = [
        semi(lost, states, "left_anti").withColumn("kind", F.lit("missing")),
        semi(lost, dead, "left_semi").withColumn("kind", F.lit("deleted")),
        semi(lost, alive, "left_semi").withColumn("kind", F.lit("late")),
    ]
    names = [*REFERENCE, "depth"]
    frontier = functools.reduce(DataFrame.unionByName, kinds).withColumn("depth", F.lit(0)).select(names).distinct()
    frontier = stored(frontier, "orphans")
    dropped(lost)
    rounds = [frontier]
    inner = {fk.parent for fk in keys}  # only orphans of these can have children
    for depth in itertools.count(1):
        up = frontier.filter(F.col("src_table").isin(*inner)).select(F.col("src_table").alias("parent"), norm_id("src_key").alias("ref_id")).distinct()
        new = semi(refs, up, "left_semi")
        for seen in rounds:
            new = new.join(seen.select("src_table", "src_key").distinct(), ["src_table", "src_key"], "left_anti")
        new = new.withColumn("kind", F.lit("inherited")).withColumn("depth", F.lit(depth)).select(names).distinct()
        frontier = stored(new, "orphans")
        if frontier.isEmpty():
            break
        if max_rounds is not None and depth >= max_rounds:
            raise RuntimeError(f"the cascade has not ended after {max_rounds} rounds")
        rounds.append(frontier)
        if len(rounds) == 10:  # keeps the plan of long chains small
            whole = stored(functools.reduce(DataFrame.unionByName, rounds), "orphans")
            dropped(*rounds[:-1])
            rounds = [whole]
    out = functools.reduce(DataFrame.unionByName, rounds)
    return out.withColumn("how", F.when(F.col("depth") == 0, "direct").otherwise("inherited"))


def memory_orphans(
    entity: DataFrame, observation: DataFrame, relationship: DataFrame, session: DataFrame | None = None, task: DataFrame | None = None
) -> DataFrame:
    """``orphan_cascade`` over the tables of a memory.

    Observations refer to entities, and relationships at both ends; with
    ``session`` and ``task`` observations refer to these as well, and tasks to
    sessions. Keys of relationships are ``from_id|to_id|relation_type`` as stored.
    """
    extra = ["session_id", "task_id"] if session is not None and task is not None else []
    o = versioned.current(observation.select("id", "valid_from", "asserted", "entity_id", *extra), KEYS["observation"])
    r = versioned.current(relationship.select(*KEYS["relationship"], "valid_from", "asserted"), KEYS["relationship"])
    r_key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in KEYS["relationship"]])
    children = {"observation": o.withColumnRenamed("id", "key"), "relationship": r.withColumn("key", r_key)}
    parents = {"entity": entity_state(entity)}
    keys = [ForeignKey("observation", "entity_id", "entity"), ForeignKey("relationship", "from_id", "entity"), ForeignKey("relationship", "to_id", "entity")]
    if extra:
        children["task"] = task.select(norm_id("task_id").alias("key"), F.lit(None).cast("timestamp").alias("valid_from"), "session_id")
        parents |= {"session": plain_state(session, "session_id"), "task": plain_state(task, "task_id")}
        keys += [ForeignKey("observation", "session_id", "session"), ForeignKey("observation", "task_id", "task"), ForeignKey("task", "session_id", "session")]
    return orphan_cascade(children, parents, keys)
