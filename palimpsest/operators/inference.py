"""Inferred relations: rules, logical edges, suggestions, status conflicts.

An inferred relation is (from_id, to_id, relation_type, confidence); self-loops
are dropped, and of several for the same ends and type the surest stays.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.session import stored

COLUMNS = ["from_id", "to_id", "relation_type", "confidence"]
#: What says that something is active, and that it no longer is.
ACTIVE = r"(?i)(\bactive\b|\brunning\b|\bongoing\b|in\s+operation|continues|continued|not\s+discontinued)"
INACTIVE = r"(?i)(discontinued|cancelled|stopped|shut\s+down|closed|shutdown|deprecated|archived|terminated|abandoned)"
#: Base of the hashes of word sequences (odd, so that it has an inverse modulo 2^64).
BASE = 0x9FB21C651E98DF25


def surest(found: DataFrame) -> DataFrame:
    """One row per (from_id, to_id, relation_type), without self-loops."""
    return found.filter("from_id <> to_id").groupBy("from_id", "to_id", "relation_type").agg(F.max("confidence").alias("confidence"))


def _edge(a: str, b: str, kind: str, confidence: Column | float) -> list[Column]:
    c = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return [F.col(a).alias("from_id"), F.col(b).alias("to_id"), F.lit(kind).alias("relation_type"), c.alias("confidence")]


def co_occurrence(entity: DataFrame, observation: DataFrame) -> DataFrame:
    """Entities whose name stands, as a sequence of words, in a note of another entity: ``related_to`` 0.7.

    Every sequence of words of a note that is as long as some name is hashed in
    place; those that a Bloom filter of all names lets through meet the names
    whole, so nothing but likely hits leaves the notes. Names of any length
    take part; blank ones match nothing.
    """
    named = entity.select(F.col("id").alias("to_id"), tx.words(F.col("name")).alias("w")).filter(F.size("w") > 0)
    phrase = F.array_join("w", " ").alias("phrase")
    names = stored(named.select("to_id", phrase, F.size("w").alias("k"), _hashes("w").alias("h")), "names")
    bloom = Bloom(names.select("phrase", "k", "h"))
    notes = observation.filter("entity_id IS NOT NULL AND text IS NOT NULL").select("entity_id", tx.words(F.col("text")).alias("w"))
    met = notes.select("entity_id", "w", _hashes("w").alias("h")).mapInArrow(bloom.sequences, "from_id string, phrase string")
    found = met.distinct().join(names.select("to_id", "phrase"), "phrase").filter("from_id <> to_id")
    return found.select(*_edge("from_id", "to_id", "related_to", 0.7))


def _hashes(words: str) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


class Bloom:
    """A Bloom filter of word sequences (columns k, number of words, and h, their hashes): 16 to 32 bits for each, gathered in slices."""

    #: Places of a sequence in the filter, and bits of a slice.
    PLACES, SLICE = 4, 1 << 20

    def __init__(self, sequences: DataFrame):
        n = sequences.select("phrase").distinct().count()
        bits = self.bits = max(10, math.ceil(math.log2(16 * n + 1)))
        self.lengths = sorted(r["k"] for r in sequences.select("k").distinct().collect())

        def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ends, hashes = _flat(batch.column("h"))
                    whole = _sequences(hashes, ends[:-1], np.diff(ends))
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(Bloom.places(whole, bits).ravel()))], ["bit"])

        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            part = np.zeros(Bloom.SLICE, bool)
            part[pdf["bit"].to_numpy() % Bloom.SLICE] = True
            return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "data": [np.packbits(part).tobytes()]})

        set_ = sequences.select("h").mapInArrow(set_bits, "bit long").distinct().withColumn("slice", F.floor(F.col("bit") / self.SLICE))
        self.data = np.zeros(max(1 << bits, self.SLICE) // 8, np.uint8)
        for row in set_.groupBy("slice").applyInPandas(pack, "slice long, data binary").toLocalIterator():
            self.data[row["slice"] * self.SLICE // 8 :][: self.SLICE // 8] = np.frombuffer(row["data"], np.uint8)

    @staticmethod
    def places(h: np.ndarray, bits: int) -> np.ndarray:
        """(PLACES, n): the bits of hashes."""
        turns = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
        mixed = h ^ (h >> np.uint64(31))
        return ((mixed[None, :] * turns[:, None]) >> np.uint64(64 - bits)).astype(np.int64)

    def sequences(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(from_id, phrase) of the sequences of words of notes (entity_id, w, h) that may be in the filter, each once in a batch."""
        for batch in batches:
            if not batch.num_rows:
                continue
            ends, hashes = _flat(batch.column("h"))
            words, ids = batch.column("w").flatten().to_pylist(), batch.column("entity_id").to_pylist()
            left = np.repeat(ends[1:], np.diff(ends)) - np.arange(len(hashes))  # words from here to the end of the note
            note = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            out: set[tuple[str, str]] = set()
            for k in self.lengths:
                at = np.flatnonzero(left >= k)
                if not len(at):
                    break
                bit = self.places(_sequences(hashes, at, np.full(len(at), k)), self.bits)
                at = at[((self.data[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).all(axis=0)]
                out.update((ids[n], " ".join(words[i : i + k])) for i, n in zip(at.tolist(), note[at].tolist(), strict=True))
            some = list(out)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in some], pa.string()) for i in (0, 1)], ["from_id", "phrase"])


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the lists of an array in its flat values, with 0 before, and these."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64), lists.flatten().to_numpy().astype(np.int64).view(np.uint64)


def _sequences(hashes: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of the sequences of ``length`` words from ``at`` on, the same wherever they stand: polynomials modulo 2^64."""
    n = len(hashes)
    power, inverse = np.full(n + 1, BASE, np.uint64), np.full(n + 1, pow(BASE, -1, 1 << 64), np.uint64)
    power[0] = inverse[0] = 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * np.cumprod(power)[:n], dtype=np.uint64)])
    return (sums[at + length] - sums[at]) * np.cumprod(inverse)[at] + length.astype(np.uint64)


def transitive(e: DataFrame, start: DataFrame) -> DataFrame:
    """A to B to C, from the given nodes (column node): ``potentially_related`` 0.5, unless A and C are linked already."""
    a = e.join(start.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("src").alias("from_id"), F.col("dst").alias("mid"))
    out = a.join(e, F.col("mid") == e["src"]).select("from_id", F.col("dst").alias("to_id")).distinct()
    known = e.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    return surest(out.join(known, ["from_id", "to_id"], "left_anti").select(*_edge("from_id", "to_id", "potentially_related", 0.5)))


def expertise(relationship: DataFrame) -> DataFrame:
    """Who works on something that uses a technology is expert in it: ``expert_in`` 0.7.

    Pairs of person and technology are made distinct before they leave the
    join's reducers, so a hub project yields each pair once.
    """
    works = relationship.filter("relation_type = 'works_on'").select(F.col("from_id").alias("who"), F.col("to_id").alias("what")).distinct()
    uses = relationship.filter("relation_type = 'uses_tech'").select(F.col("from_id").alias("what"), F.col("to_id").alias("tech")).distinct()
    return surest(works.join(uses, "what").select(*_edge("who", "tech", "expert_in", 0.7)))


def logical_links(entity: DataFrame, e: DataFrame, start: DataFrame) -> DataFrame:
    """Logical edges from the given entities (column id) by their metadata: the surest per ends and type.

    ``same_category`` 0.8, ``same_type`` 0.7, ``hierarchical`` 0.9 (parent or
    child by ``parent_id``), ``contextual`` 0.75 (same ``domain``), and
    ``transitive_logical``: entities of the category (0.6) or type (0.55) of
    another entity that the given one has a relation (``e``) to. Attributes are
    joined by equality, null ones match nothing; common attributes are split by
    the adaptive join.
    """
    field = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    x = entity.select(F.col("id").alias("to_id"), field("category"), F.lower("type").alias("kind"), field("parent_id"), field("domain"))
    s = x.join(start.select(F.col("id").alias("to_id")), "to_id", "left_semi").withColumnRenamed("to_id", "from_id")
    parts = []
    for column, kind, sure in (("category", "same_category", 0.8), ("kind", "same_type", 0.7), ("domain", "contextual", 0.75)):
        parts.append(s.select("from_id", column).join(x.select("to_id", column), column).select(*_edge("from_id", "to_id", kind, sure)))
    parts.append(s.select("from_id", F.col("parent_id").alias("to_id")).join(x.select("to_id"), "to_id").select(*_edge("from_id", "to_id", "hierarchical", 0.9)))
    parts.append(s.select("from_id").join(x.select("to_id", F.col("parent_id").alias("from_id")), "from_id").select(*_edge("from_id", "to_id", "hierarchical", 0.9)))
    mid = e.join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
    mid = mid.join(x.select("to_id", "category", "kind"), "to_id").withColumnRenamed("to_id", "mid")
    for column, sure in (("category", 0.6), ("kind", 0.55)):
        other = mid.select("from_id", "mid", column).join(x.select("to_id", column), column).filter("to_id <> mid")
        parts.append(other.select(*_edge("from_id", "to_id", "transitive_logical", sure)))
    return surest(functools.reduce(DataFrame.unionByName, parts))


def logical_link_counts(entity: DataFrame, e: DataFrame, start: DataFrame) -> DataFrame:
    """(from_id, relation_type, confidence, n_edges): how many ``logical_links`` there are, counted without making them.

    Ids are unique. Entities are counted by attribute once; what the counts hold
    too much (the given entity itself, and the entities it has relations to,
    which no way through themselves reaches) is put right one by one.
    """
    field = lambda name: F.get_json_object("metadata", f"$.{name}").alias(name)
    x = entity.select("id", field("category"), F.lower("type").alias("kind"), field("parent_id"), field("domain"))
    s = x.join(start.select("id").distinct(), "id", "left_semi").withColumnRenamed("id", "from_id")
    parts = []
    for column, kind, sure in (("category", "same_category", 0.8), ("kind", "same_type", 0.7), ("domain", "contextual", 0.75)):
        n = x.groupBy(column).agg((F.count("*") - 1).alias("n"))
        parts.append(s.select("from_id", column).join(n, column).select("from_id", F.lit(kind).alias("relation_type"), F.lit(sure).alias("confidence"), "n"))
    up = s.select("from_id", F.col("parent_id").alias("id")).join(x.select("id"), "id")
    down = s.select("from_id").join(x.select("id", F.col("parent_id").alias("from_id")), "from_id")
    near = up.select("from_id", "id").unionByName(down.select("from_id", "id")).filter("from_id <> id").distinct().groupBy("from_id").agg(F.count("*").alias("n"))
    parts.append(near.select("from_id", F.lit("hierarchical").alias("relation_type"), F.lit(0.9).alias("confidence"), "n"))
    # ways through an entity that the given one has a relation to
    mid = e.join(start.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("from_id"), F.col("dst").alias("id")).distinct()
    mid = mid.join(x.select("id", "category", "kind"), "id")
    c = mid.filter("category IS NOT NULL").groupBy("from_id", "category").agg(F.count("*").alias("nc"))
    k = mid.filter("kind IS NOT NULL").groupBy("from_id", "kind").agg(F.count("*").alias("nk"))
    both = x.groupBy("category", "kind").agg(F.count("*").alias("n"))
    zero = F.lit(0).cast("long")
    sums = [
        c.join(both, "category").select("from_id", F.col("n").alias("six"), zero.alias("five")),
        k.join(both, "kind").select("from_id", zero.alias("six"), F.col("n").alias("five")),
        c.join(both, "category").join(k, ["from_id", "kind"]).select("from_id", zero.alias("six"), (-F.col("n")).alias("five")),
    ]
    own = mid.select("from_id", "id", "category", "kind").unionByName(s.select("from_id", F.col("from_id").alias("id"), "category", "kind")).distinct()
    own = own.join(c, ["from_id", "category"], "left").join(k, ["from_id", "kind"], "left")
    has = lambda n, least: F.coalesce(F.col(n) >= least, F.lit(False))
    other = F.col("id") != F.col("from_id")
    six = (other & has("nc", 2)).cast("long") - has("nc", 1).cast("long")
    five = (other & has("nk", 2) & ~has("nc", 2)).cast("long") - (has("nk", 1) & ~has("nc", 1)).cast("long")
    sums.append(own.select("from_id", six.alias("six"), five.alias("five")))
    total = functools.reduce(DataFrame.unionByName, sums).groupBy("from_id").agg(F.sum("six").alias("six"), F.sum("five").alias("five"))
    for n, sure in (("six", 0.6), ("five", 0.55)):
        parts.append(total.select("from_id", F.lit("transitive_logical").alias("relation_type"), F.lit(sure).alias("confidence"), F.col(n).alias("n")))
    return functools.reduce(DataFrame.unionByName, parts).filter("n > 0").withColumnRenamed("n", "n_edges")


def materialise(relations: DataFrame, found: DataFrame, at: str) -> DataFrame:
    """Relations (from_id, to_id, relation_type, valid_from, strength, metadata) with inferred ones added, marked ``logical_edge`` in their metadata."""
    new = found.select(
        "from_id", "to_id", "relation_type", F.lit(at).cast(dict(relations.dtypes)["valid_from"]).alias("valid_from"), F.col("confidence").alias("strength"),
        F.to_json(F.struct(F.lit(True).alias("logical_edge"), "confidence")).alias("metadata"),
    )
    return relations.select(new.columns).unionByName(new)


#: Types of relations that hold in both directions.
SYMMETRIC = ["colleague_of", "related_to", "similar_to", "connected_to"]


def inferred_suggestions(relationship: DataFrame, start: DataFrame, entity: DataFrame, limit: int = 10) -> DataFrame:
    """(from_id, to_id, relation_type, confidence): suggestions for the given entities (column id), the ``limit`` best of each.

    A relation of a relation suggests ``<first>_via_<second>`` with 0.7 times both
    strengths, a symmetric relation itself with 0.8 times its strength; targets
    must exist (``entity``). The best per target and type stays.
    """
    s = F.coalesce("strength", F.lit(0.0))
    own = relationship.join(start.select(F.col("id").alias("from_id")), "from_id", "left_semi").filter("to_id IS NOT NULL")
    a = own.select("from_id", F.col("to_id").alias("mid"), F.col("relation_type").alias("first"), s.alias("s1"))
    b = relationship.select(F.col("from_id").alias("mid"), "to_id", F.col("relation_type").alias("second"), s.alias("s2"))
    via = F.concat_ws("_via_", "first", "second")
    two = a.join(b, "mid").select("from_id", "to_id", via.alias("relation_type"), (0.7 * F.col("s1") * F.col("s2")).alias("confidence"))
    one = own.filter(F.col("relation_type").isin(SYMMETRIC)).select("from_id", "to_id", "relation_type", (0.8 * s).alias("confidence"))
    found = surest(two.unionByName(one)).join(entity.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    found = found.withColumn("confidence", F.round("confidence", 6))
    order = Window.partitionBy("from_id").orderBy(F.col("confidence").desc(), "to_id", "relation_type")
    return found.withColumn("no", F.row_number().over(order)).filter(F.col("no") <= limit).select(*COLUMNS)


def in_words(found: DataFrame, names: DataFrame) -> DataFrame:
    """The relations with ``says``: both ends by name (id, where there is none) and how sure they are."""
    out = found.join(names.select(F.col("id").alias("from_id"), F.col("name").alias("_a")), "from_id", "left").join(names.select(F.col("id").alias("to_id"), F.col("name").alias("_b")), "to_id", "left")
    hint = F.when(F.col("confidence") >= 0.8, " (likely)").when(F.col("confidence") >= 0.6, " (possible)").otherwise(" (uncertain)")
    says = F.concat(F.coalesce("_a", "from_id"), F.lit(" --["), "relation_type", F.lit("]--> "), F.coalesce("_b", "to_id"), hint)
    return out.select(*COLUMNS, says.alias("says"))


def common_neighbours(two: DataFrame, start: DataFrame) -> DataFrame:
    """(node, n_common, confidence) of nodes that share neighbours with the start nodes and are none of them."""
    near = two.join(start.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("mid")).distinct()
    far = two.join(near, two["src"] == near["mid"]).groupBy(F.col("dst").alias("node")).agg(F.countDistinct("mid").alias("n_common"))
    out = far.join(start.select("node"), "node", "left_anti").join(near.select(F.col("mid").alias("node")), "node", "left_anti")
    return out.select("node", "n_common", F.round(F.least(F.lit(0.95), 0.5 + 0.15 * F.col("n_common")), 6).alias("confidence"))


def proximity(hops: DataFrame) -> DataFrame:
    """(node, confidence) of nodes two or three hops away: max(0.5, 1 - 0.25 hops)."""
    return hops.filter("hops BETWEEN 2 AND 3").select("node", F.greatest(F.lit(0.5), 1 - 0.25 * F.col("hops")).alias("confidence"))


def merge_suggestions(lists: list[tuple[DataFrame, float]], least: float = 0.5, limit: int = 10) -> DataFrame:
    """(node, confidence, level) of several lists (node, confidence), in order of precedence.

    The first list that has a node keeps its raw confidence; later ones count
    times their weight. At least ``least``; the ``limit`` best.
    """
    parts = None
    for i, (df, weight) in enumerate(lists):
        one = df.select("node", F.lit(i).alias("i"), F.col("confidence").cast("double").alias("raw"), (F.col("confidence") * weight).alias("weighted"))
        parts = one if parts is None else parts.unionByName(one)
    # the first list's raw value, the others' weighted values
    g = parts.groupBy("node").agg(F.min(F.struct("i", "raw")).alias("first"), F.collect_list(F.struct("i", "weighted")).alias("all"))  # one entry per list
    later = F.array_max(F.transform(F.filter("all", lambda x: x["i"] > F.col("first.i")), lambda x: x["weighted"]))
    sure = F.round(F.greatest(F.col("first.raw"), F.coalesce(later, F.lit(0.0))), 6)
    out = g.select("node", sure.alias("confidence")).filter(F.col("confidence") >= least).orderBy(F.col("confidence").desc(), "node").limit(limit)
    return out.withColumn("level", F.when(F.col("confidence") >= 0.75, "HIGH").otherwise("MEDIUM"))


def status_conflicts(observation: DataFrame) -> DataFrame:
    """(entity_id, year, active_id, inactive_id): the latest note that says active and the latest that says not, in the same year.

    The fixed patterns look for ``continued`` anywhere, so a note that says
    ``discontinued`` counts as both.
    """
    o = observation.filter("entity_id IS NOT NULL AND entity_id <> '' AND text IS NOT NULL").withColumn("year", F.year("valid_from"))
    pick = lambda c: F.max(F.when(c, F.struct("valid_from", "id")))
    g = o.groupBy("entity_id", "year").agg(pick(F.col("text").rlike(ACTIVE)).alias("a"), pick(F.col("text").rlike(INACTIVE)).alias("b"))
    return g.filter("a IS NOT NULL AND b IS NOT NULL").select("entity_id", "year", F.col("a.id").alias("active_id"), F.col("b.id").alias("inactive_id"))


def custom_rule(spark: SparkSession, views: dict[str, DataFrame], sql: str, **args) -> DataFrame:
    """A user's rule: SQL text over named views with parameters, checked to return the five columns of a relation."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    out = spark.sql(sql, args=args)
    missing = {*COLUMNS, "reason"} - set(out.columns)
    if missing:
        raise ValueError(f"the rule lacks the columns {sorted(missing)}")
    return out.select(*COLUMNS, "reason").filter("from_id <> to_id")
