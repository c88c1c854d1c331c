"""Near-duplicate texts: all pairs of texts whose word sets are similar, exactly.

Rare-first prefix filtering. The words of a text are ordered from rare to
frequent; two sets of sizes n and m with Jaccard similarity t or more share at
least a = ceil(t/(1+t) (n+m)) words, so they share one among the first n-a+1 of
the one and m-a+1 of the other. Texts meet in one shuffled join on two kinds of
keys made from that prefix:

* each rare word in it by itself (a word is frequent if more than
  ``frequent_share`` of all texts hold it);
* n-grams of its frequent words, for pairs that share no rare word. Such a pair
  differs in at most D = e_x + e_y frequent words, where e = (frequent words of
  the text) - 2t/(1+t) n. The frequent words are dealt into more than D parts;
  at least one part holds the same words on both sides, and the words of a part
  are the n-gram. Texts come in size classes of e, so that few parts do.

Before a pair leaves the join it passes the length filter, the positional
filter (rare words) and a suffix filter: 128 parity bits of each set, whose
difference is a lower bound of the difference of the sets. What is left is made
distinct and verified once per pair on the whole word sets. Equal word sets
form classes first, so a text saved a million times enters the join once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.components import connected_components
from palimpsest.session import stored

#: A word in more than this share of the texts is joined in n-grams only. At most (mean words of a text) / share words are that frequent.
FREQUENT_SHARE = 0.01
#: Words in more than this share of the texts are ordered by their count, all rarer ones count as equally rare. This bounds the broadcast in the same way.
RANKED_SHARE = 0.0005
EPS = 1e-9


def words(text: Column) -> Column:
    """Distinct words of the lower-cased text: maximal runs of letters and digits (categories L and N)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (multiply and shift)."""
    x = x.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class Sets:
    """A batch of word sets, each ordered from rare to frequent."""

    def __init__(self, batch: pa.RecordBatch, known: np.ndarray, counts: np.ndarray, frequent: int, t: float):
        lists = batch.column("tokens")
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        self.n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        self.cid = batch.column("cid").to_numpy()
        doc = np.repeat(np.arange(len(self.n)), self.n)
        at = np.minimum(np.searchsorted(known, flat), max(len(known) - 1, 0))
        count = np.where(known[at] == flat, counts[at], 0) if len(known) else np.zeros(len(flat), np.int64)
        order = np.lexsort((flat, count, doc))
        self.doc, self.token, self.count = doc[order], flat[order], count[order]
        self.start = np.cumsum(self.n) - self.n
        self.pos = np.arange(len(flat)) - self.start[self.doc]
        self.frequent = self.count > frequent
        held = np.bincount(self.doc[self.frequent], minlength=len(self.n))
        self.t = t
        self.e = held - 2 * t / (1 + t) * self.n

    def sketch(self) -> tuple[np.ndarray, np.ndarray]:
        """128 parity bits of each set."""
        bit = (mix(self.token.view(np.uint64)) >> np.uint64(57)).astype(np.uint64)
        one = np.uint64(1) << (bit & np.uint64(63))
        out = []
        for half in (0, 1):
            part = np.where((bit >> np.uint64(6)) == half, one, np.uint64(0))
            out.append(np.bitwise_xor.reduceat(part, self.start).view(np.int64))
        return out[0], out[1]


def classes(top: float) -> list[float]:
    """Upper ends of the classes of e: ``top`` and what is left after taking 45 % off, down to 1."""
    ends = [max(top, 1.0)]
    while ends[-1] > 1.5:
        ends.append(max(1.0, ends[-1] * 0.55))
    return ends[::-1]


def key_rows(s: Sets, rank: np.ndarray, ends: list[float], left: bool) -> pa.RecordBatch:
    """Join keys of a batch. Left: texts as the smaller of a pair, and in their own class; right: all."""
    t, n = s.t, s.n
    need = np.ceil((2 * t / (1 + t) if left else t) * n - EPS).astype(np.int64)
    use = ~s.frequent & (s.pos < (n - need + 1)[s.doc])
    doc, key, pos = [s.doc[use]], [mix(s.token[use].view(np.uint64))], [s.pos[use]]
    own = np.searchsorted(np.array(ends) - EPS, s.e)  # the class of each text
    f_doc, f_rank, f_hash = s.doc[s.frequent], rank[s.frequent], mix(s.token[s.frequent].view(np.uint64) + np.uint64(7))
    for k, end in enumerate(ends):
        parts = int(2 * end + EPS) + 1
        emit = np.minimum(parts, np.floor(end + s.e + EPS).astype(np.int64) + 1)
        emit[(own != k) if left else (own > k)] = 0
        if not (emit > 0).any():
            continue
        gram = np.zeros(len(n) * parts, np.uint64)
        take = emit[f_doc] > 0
        np.add.at(gram, f_doc[take] * parts + f_rank[take] % parts, f_hash[take])
        row, part = np.nonzero(np.arange(parts)[None, :] < emit[:, None])
        doc.append(row)
        key.append(mix(gram[row * parts + part] ^ mix(np.uint64(1 + k * 100_003) + part.astype(np.uint64))))
        pos.append(np.where(own[row] == k, -1, -2))
    doc, key, pos = np.concatenate(doc), np.concatenate(key), np.concatenate(pos)
    a, b = s.sketch()
    return pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (key.view(np.int64), s.cid[doc], n[doc].astype(np.int32), pos.astype(np.int32), a[doc], b[doc])],
        ["key", "cid", "n", "pos", "s1", "s2"],
    )


class NearDuplicates:
    """The classes, pairs and membership of near-duplicate texts.

    ``texts`` has a unique string column ``id`` and ``text``. Null and blank
    texts and texts without a word take part in nothing. Texts of any length
    are used whole. An empty table gives empty results. Words are compared by
    64-bit hashes.
    """

    def __init__(self, texts: DataFrame, threshold: float = 0.8, frequent_share: float = FREQUENT_SHARE):
        self.t = threshold
        sets = texts.select("id", F.array_sort(F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).alias("tokens")).filter(F.size("tokens") > 0)
        self.sets = stored(
            sets.select(F.monotonically_increasing_id().alias("cid"), "id", F.xxhash64("tokens").alias("h1"), F.xxhash64("tokens", F.lit(1)).alias("h2"), "tokens"),
            "wordsets",
        )
        named = self.sets.select("cid", "id", "h1", "h2")
        many = named.groupBy("h1", "h2").agg(F.min("cid").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
        #: members of classes of more than one text: (rep, id); the member that stands for the class is among them
        self.copies = stored(named.join(many, ["h1", "h2"]).select("rep", "cid", "id"), "copies")
        self.frequent_share = frequent_share
        self._pairs: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """Pairs of classes: (cid_a, cid_b, similarity), one row per pair."""
        if self._pairs is None:
            self._pairs = stored(self._find(), "pairs")
        return self._pairs

    def _find(self) -> DataFrame:
        spark, t = self.sets.sparkSession, self.t
        total = self.sets.count()
        least = max(2, int(total * min(RANKED_SHARE, self.frequent_share)))
        frequent = max(2, int(total * self.frequent_share))
        counted = self.sets.select(F.explode("tokens").alias("w")).groupBy("w").count().filter(F.col("count") > least).toPandas()
        by_hash = counted.sort_values("w")
        known, counts = by_hash["w"].to_numpy(np.int64), by_hash["count"].to_numpy(np.int64)
        # frequent words are dealt into parts by their place in the order of counts
        place = np.empty(len(known), np.int64)
        place[np.lexsort((known, -counts))] = np.arange(len(known))
        shared = spark.sparkContext.broadcast((known, counts, place))
        extra = self.copies.filter("rep <> cid").select("cid")
        sets = self.sets.select("cid", "tokens").join(extra, "cid", "left_anti")

        def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[Sets]:
            known, counts, _ = shared.value
            for batch in rows:
                if batch.num_rows:
                    yield Sets(batch, known, counts, frequent, t)

        def largest(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = [float(s.e.max()) for s in batches(rows)]
            yield pa.RecordBatch.from_arrays([pa.array([max(top)] if top else [], pa.float64())], ["e"])

        top = sets.mapInArrow(largest, "e double").agg(F.max("e")).first()[0]
        if top is None:
            return spark.createDataFrame([], "cid_a bigint, cid_b bigint, similarity double")
        ends = classes(math.ceil(top * 2) / 2)

        def keys(left: bool) -> DataFrame:
            def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known, _, place = shared.value
                for s in batches(rows):
                    at = np.minimum(np.searchsorted(known, s.token), max(len(known) - 1, 0))
                    rank = np.where(s.frequent, place[at], 0) if len(known) else np.zeros(len(s.token), np.int64)
                    yield key_rows(s, rank, ends, left)

            return sets.mapInArrow(run, "key bigint, cid bigint, n int, pos int, s1 bigint, s2 bigint")

        a, b = keys(True).alias("a"), keys(False).alias("b")
        col = F.col
        both = col("a.n") + col("b.n")
        overlap = F.ceil(both * F.lit(t / (1 + t)) - EPS)
        rare = (
            (col("a.pos") >= 0)
            & (col("b.pos") >= 0)
            & ((col("a.n") < col("b.n")) | ((col("a.n") == col("b.n")) & (col("a.cid") < col("b.cid"))))
            & (F.least(col("a.n") - col("a.pos"), col("b.n") - col("b.pos")) >= overlap)
        )
        gram = (col("a.pos") == -1) & ((col("b.pos") == -2) | ((col("b.pos") == -1) & (col("a.cid") < col("b.cid"))))
        length = F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * F.lit(t) - EPS
        differ = F.bit_count(col("a.s1").bitwiseXOR(col("b.s1"))) + F.bit_count(col("a.s2").bitwiseXOR(col("b.s2")))
        met = a.join(b, (col("a.key") == col("b.key")) & (rare | gram) & length & (differ <= both - 2 * overlap))
        found = met.select(F.least("a.cid", "b.cid").alias("cid_a"), F.greatest("a.cid", "b.cid").alias("cid_b")).distinct()
        x = self.sets.select(col("cid").alias("cid_a"), col("tokens").alias("ta"))
        y = self.sets.select(col("cid").alias("cid_b"), col("tokens").alias("tb"))
        common = F.size(F.array_intersect("ta", "tb"))
        scored = found.join(x, "cid_a").join(y, "cid_b").withColumn("common", common)
        similarity = col("common") / (F.size("ta") + F.size("tb") - col("common"))
        return scored.select("cid_a", "cid_b", similarity.alias("similarity")).filter(col("similarity") >= F.lit(t))

    def members(self) -> DataFrame:
        """(cid, id): the class of every text; ``cid`` is the class's representative."""
        moved = self.copies.filter("rep <> cid").select("cid", "rep")
        out = self.sets.select("cid", "id").join(moved, "cid", "left")
        return out.select(F.coalesce("rep", "cid").alias("cid"), "id")

    def groups(self) -> DataFrame:
        """(id, class_id, group_id, n_copies, n_links): one row per text that has words.

        ``class_id`` and ``group_id`` are the smallest ids of the class of equal
        word sets and of the connected group of similar classes; ``n_copies``
        counts the other texts of the class, ``n_links`` the other classes that
        are similar to it. Copies are not expanded into pairs.
        """
        pairs = self.pairs()
        links = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
        of = connected_components(pairs.select(F.col("cid_a").alias("src"), F.col("cid_b").alias("dst"))).withColumnRenamed("node", "cid")
        m = self.members()
        classes = m.groupBy("cid").agg(F.min("id").alias("class_id"), (F.count("*") - 1).alias("n_copies")).join(links, "cid", "left").join(of, "cid", "left")
        classes = stored(classes.withColumn("component", F.coalesce("component", "cid")).withColumn("n_links", F.coalesce("n_links", F.lit(0))), "classes")
        first = classes.groupBy("component").agg(F.min("class_id").alias("group_id"))
        named = classes.join(first, "component").select("cid", "class_id", "group_id", "n_copies", "n_links")
        return m.join(named, "cid").select("id", "class_id", "group_id", "n_copies", "n_links")

    def id_pairs(self) -> DataFrame:
        """All pairs of ids (id_a < id_b), also those within classes of equal word sets.

        The classes hold few texts each where this is asked for; where one may
        be large, ``pairs`` with ``members`` tells the same without expanding it.
        """
        pairs = self.pairs()
        ends = pairs.select(F.explode(F.array("cid_a", "cid_b")).alias("cid")).distinct()
        m = self.members().join(ends, "cid", "left_semi")
        a, b = m.select(F.col("cid").alias("cid_a"), F.col("id").alias("ia")), m.select(F.col("cid").alias("cid_b"), F.col("id").alias("ib"))
        out = pairs.select("cid_a", "cid_b").join(a, "cid_a").join(b, "cid_b").select("ia", "ib")
        c = self.copies
        same = c.select("rep", F.col("id").alias("ia")).join(c.select("rep", F.col("id").alias("ib")), "rep").filter("ia < ib").select("ia", "ib")
        out = out.unionByName(same)
        return out.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"))
