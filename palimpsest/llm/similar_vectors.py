"""The k most similar vectors of every vector, by cells and space-filling curves.

Each pass orders all vectors by cells, the nearest of all axes of a random
rotation of its own and within such a cell those of a second one, and in a cell
along a Hilbert curve through a random projection (with a random shift). It
range-partitions them by the place in that order and compares every vector with
its own block of the order and the blocks beside it; the product of two blocks
serves both. Near vectors share a cell more often than a stretch of a curve of
the same width, the more so the more vectors there are. Rows near the border of a range travel to the
neighbouring range too, as guests that are compared but not kept there, so
windows reach across borders. The best so far travel with the vector into the
next pass, so passes merge without a join. From the second pass on, the place in
the order is that of the mean of a vector and the neighbours it already has:
members of a cluster then lie far closer together than they do themselves.

Vectors travel as 16-bit components of the normalised vector: similarities are
exact to about 1e-5. MARGIN slots beyond the k best are kept, and wherever the
order at the k-th place or the threshold is closer than that, the similarity is
computed again in double precision from the given vectors. Equal vectors form
classes first; one of each class takes part in the passes, and the result is
expanded to all members, smallest ids first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import vectors as vx
from palimpsest.session import dropped, stored

#: Rows of a block; a row is compared with its own block and REACH blocks before and after it.
BLOCK, REACH = 1024, 1
#: Rows of a tile of the product of two blocks.
TILE = 128
#: Rotations whose axes make the cells, dimensions of the projection and bits of each on the curve within a cell, and bits of a place.
LEVELS, DIMS, BITS, PLACE = 2, 16, 2, 48
#: Bits of the uid below the place.
TIE = 12
PASSES = 8
#: Rows of a range of the order, which one task handles block by block, and how many keys of a range are sampled to cut ranges.
PART, SAMPLED = 40_000, 200
#: Neighbours kept beyond the k best, and the error of a similarity of 16-bit components.
MARGIN, ERROR = 6, 2e-5
#: Members of a class of equal vectors that one task expands.
MEMBERS = 20_000


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``grid``, ``bits`` bits a coordinate).

    The coordinates are walked from the highest bit down; each level's flips
    and exchanges undo the turn of the curve in the cells above, then the Gray
    code is resolved and the bits are interleaved.
    """
    x = grid.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            up = (x[i] & bit) != 0
            swap = np.where(up, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= turn
    place = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            place = (place << 1) | ((x[i] >> level) & 1)
    return place


@cache
def drawn(turn: int, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """What is random in the order of pass ``turn``: its rotations, the axes of its projection and their shift; drawn once a process."""
    rng = np.random.default_rng(1000 + turn)
    turns = [np.linalg.qr(rng.standard_normal((size, size)))[0].astype(np.float32) for _ in range(LEVELS)]
    axes = np.linalg.qr(rng.standard_normal((size, min(DIMS, size))))[0].astype(np.float32)
    return turns, axes, rng.uniform(-0.25, 0.25, axes.shape[1]).astype(np.float32)


def place(vectors: np.ndarray, turn: int) -> np.ndarray:
    """Keys of unit vectors in the order of pass ``turn``: the nearest axis (either end) of each of LEVELS random rotations, then the place on the curve."""
    n, size = vectors.shape
    turns, axes, shift = drawn(turn, size)
    cell = np.zeros(n, np.int64)
    for rotation in turns:
        turned = vectors @ rotation
        axis = np.abs(turned).argmax(1)
        cell = cell * (2 * size) + 2 * axis + (turned[np.arange(n), axis] > 0)
    spread = vectors @ axes * np.float32(np.sqrt(size))  # about one unit a dimension
    shifted = (spread + shift) / 5 + 0.5
    return (cell << (DIMS * BITS)) + hilbert(np.clip(shifted * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64), BITS)


class Block:
    """Consecutive vectors of the order with the best neighbours known for each."""

    def __init__(self, batch: pa.RecordBatch, size: int, k: int):
        self.field = batch.column("field").to_numpy()
        self.uid = batch.column("uid").to_numpy()
        self.guest = batch.column("guest").to_numpy(zero_copy_only=False)
        self.k = k
        n, wide = len(self.uid), 2 * size
        state = batch.column("state")
        ends = np.frombuffer(state.buffers()[1], np.int32)[state.offset : state.offset + n + 1].astype(np.int64)
        # whole words are gathered, several times fewer than bytes; the parts of a row begin at words
        self.word = np.dtype(np.int16 if size % 2 else np.int32)
        per, near, sim = (x // self.word.itemsize for x in (wide, 8, 4))
        data = np.frombuffer(state.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(self.word)
        ends = (ends - ends[0]) // self.word.itemsize
        self.raw = data[ends[:-1, None] + np.arange(per)].view(np.uint8)
        x = self.raw.view(np.int16).astype(np.float32)
        self.x = x / np.linalg.norm(x, axis=1, keepdims=True)
        # neighbours known from earlier passes stand behind the vector: their uids, then their similarities
        self.sim = np.full((n, k), -2, np.float32)
        self.near = np.zeros((n, k), np.int64)
        have = (np.diff(ends) - per) // (near + sim)
        row = np.repeat(np.arange(n), have)
        col = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
        at = ends[row] + per
        self.near[row, col] = data[(at + near * col)[:, None] + np.arange(near)].view(np.int64).ravel()
        self.sim[row, col] = data[(at + near * have[row] + sim * col)[:, None] + np.arange(sim)].view(np.float32).ravel()
        self.mean = self.x.copy()
        self.noted: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.worst: np.ndarray | None = None

    def meet(self, other: Block, least: float) -> None:
        """Compare the rows of two blocks (or of one with itself) and note for both what may be among their best.

        Where few are as near as ``least`` the product is made in tiles that stay in the processor's cache, of a block with itself above the diagonal only.
        """
        apart = self.field[0] != other.field[-1] or other.field[0] != self.field[-1]  # rows are in the order of fields
        bars = [b.bar(least) for b in (self, other)]
        n, wide = len(self.uid), len(other.uid)
        step = TILE if least > 0.3 else n
        for at in range(0, n, step):
            end = min(at + step, n)
            spans = [(at, end), (end, n)] if self is other else [(0, wide)]  # a tile with itself and with those after it
            for low, high in spans:
                if low == high or (self.guest[at:end].all() and other.guest[low:high].all()):
                    continue
                s = self.x[at:end] @ other.x[low:high].T
                if apart:
                    s[self.field[at:end, None] != other.field[None, low:high]] = -2
                own = self is other and low == at
                if own:
                    np.fill_diagonal(s, -2)
                a, b = bars[0][at:end], bars[1][low:high]
                if step == TILE:
                    self.near_ones(other, s, at, low, a, b, least, own)
                else:
                    self.best_ones(s, other.uid, a)
                    if not own:
                        other.best_ones(s.T, self.uid, b)

    def bar(self, least: float) -> np.ndarray:
        """How similar a vector must be to count for each row; the same until ``settle``."""
        if self.worst is None:
            self.worst = np.maximum(self.sim[:, -1], np.float32(least))
            self.worst[self.guest] = 2
        return self.worst

    def near_ones(self, other: Block, s: np.ndarray, at: int, low: int, a: np.ndarray, b: np.ndarray, least: float, own: bool) -> None:
        """Note what reaches the bars ``a`` and ``b`` of both sides, of similarities of the rows from ``at`` to those of ``other`` from ``low``; for the rows alone, if ``own``."""

        def hits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            flat = np.flatnonzero(mask)  # one stretch of memory: far faster to search than two dimensions
            return *np.divmod(flat, s.shape[1]), s.ravel()[flat]

        mask = s >= np.float32(least)
        few = np.count_nonzero(mask) * 16 < mask.size  # looked up once for both sides
        row, col, value = first = hits(mask if few else s >= a[:, None])
        keep = value >= a[row]
        self.noted.append((row[keep] + at, other.uid[col[keep] + low], value[keep]))
        if not own:
            row, col, value = first if few else hits(s >= b[None, :])
            keep = value >= b[col]
            other.noted.append((col[keep] + low, self.uid[row[keep] + at], value[keep]))

    def best_ones(self, s: np.ndarray, uid: np.ndarray, worst: np.ndarray) -> None:
        """Of similarities to the vectors ``uid`` keep those that may be among the best of a row."""
        k = min(self.k, s.shape[1])
        best = np.argpartition(-s, k - 1, axis=1)[:, :k]
        row, col = np.repeat(np.arange(len(s)), k), best.ravel()
        keep = (s[row, col] >= worst[row]) & (s[row, col] > -2)
        row, col = row[keep], col[keep]
        self.noted.append((row, uid[col], s[row, col]))

    def settle(self) -> None:
        """Take what was noted."""
        if self.noted:
            self.take(*[np.concatenate(x) for x in zip(*self.noted, strict=True)])
        self.noted, self.worst = [], None

    def take(self, row: np.ndarray, uid: np.ndarray, sim: np.ndarray) -> None:
        """Keep the best of what is known and of the candidates; which vectors they are is told by ``uid``."""
        fresh = np.ones(len(row), bool)  # most were found in an earlier pass too
        for i in range((self.sim > -2).sum(1).max()):
            fresh &= (self.near[row, i] != uid) | (self.sim[row, i] <= -2)
        row, uid, sim = row[fresh], uid[fresh], sim[fresh]
        if not len(row):
            return
        touched = np.zeros(len(self.sim), bool)
        touched[row] = True
        old_row, old_col = np.nonzero((self.sim > -2) & touched[:, None])
        row_all = np.concatenate([old_row, row])
        sim = np.concatenate([self.sim[old_row, old_col], sim])
        near = np.concatenate([self.near[old_row, old_col], uid])
        order = np.lexsort((near, -sim, row_all))
        row_all, sim, near = row_all[order], sim[order], near[order]
        pair = np.lexsort((near, row_all))  # met twice: the first of each stays
        again = np.zeros(len(pair), bool)
        again[pair[1:]] = (row_all[pair[1:]] == row_all[pair[:-1]]) & (near[pair[1:]] == near[pair[:-1]])
        row_all, sim, near = row_all[~again], sim[~again], near[~again]
        at = np.arange(len(row_all)) - np.searchsorted(row_all, row_all)
        keep = at < self.k
        self.sim[touched], self.near[touched] = -2, 0
        self.sim[row_all[keep], at[keep]] = sim[keep]
        self.near[row_all[keep], at[keep]] = near[keep]

    def lean(self, around: list[Block]) -> None:
        """Move the place of each row to the mean of itself and those of its neighbours that are around."""
        uid = np.concatenate([b.uid for b in around])
        order = np.argsort(uid)
        at = np.minimum(np.searchsorted(uid[order], self.near), len(uid) - 1)
        here = (uid[order][at] == self.near) & (self.sim > 0.3)
        n = here.sum(1)
        some = np.flatnonzero(n)
        if len(some):
            # each row itself, then its neighbours, summed in stretches
            starts = np.concatenate([[0], np.cumsum(n[some] + 1)[:-1]])
            which = np.empty(starts[-1] + n[some[-1]] + 1, np.int64)
            own = np.zeros(len(which), bool)
            own[starts] = True
            which[own] = some + sum(len(b.uid) for b in around[: around.index(self)])
            which[~own] = order[at[here]]
            self.mean[some] = np.add.reduceat(np.concatenate([b.x for b in around])[which], starts, axis=0)

    def rows(self, turn: int) -> pa.RecordBatch:
        """The block's own rows with their neighbours, placed for pass ``turn``."""
        mine = np.flatnonzero(~self.guest)
        have = (self.sim[mine] > -2).sum(1)
        bytes_ = self.word.itemsize
        per, near, sim = self.raw.shape[1] // bytes_, 8 // bytes_, 4 // bytes_
        ends = np.concatenate([[0], np.cumsum(per + (near + sim) * have)])
        data = np.empty(ends[-1], self.word)
        data[ends[:-1, None] + np.arange(per)] = self.raw[mine].view(self.word)
        row = np.repeat(np.arange(len(mine)), have)
        col = np.arange(len(row)) - np.repeat(np.cumsum(have) - have, have)
        at = ends[row] + per
        data[(at + near * col)[:, None] + np.arange(near)] = self.near[mine[row], col].view(self.word).reshape(-1, near)
        data[(at + near * have[row] + sim * col)[:, None] + np.arange(sim)] = self.sim[mine[row], col].view(self.word).reshape(-1, sim)
        state = pa.Array.from_buffers(pa.binary(), len(mine), [None, pa.py_buffer((ends * bytes_).astype(np.int32)), pa.py_buffer(data)])
        mean = self.mean[mine] / np.linalg.norm(self.mean[mine], axis=1, keepdims=True)
        return placed(self.field[mine], self.uid[mine], mean, state, turn)

    def found(self, k: int, least: float) -> pa.RecordBatch:
        """The neighbours of each of the block's own rows: ``k`` and what is as near as the last of them, but for ERROR.

        ``hard``: equal vectors are involved (odd uids), or ERROR may change which are the first ``k``.
        """
        mine = np.flatnonzero(~self.guest)
        sim, near = self.sim[mine], self.near[mine]
        last = sim[:, k - 1 : k] - 2 * ERROR
        have = (sim > -2) & (sim >= last)
        close = (have[:, k:].any(1) & (self.k > k)) | (have & (np.abs(sim - least) <= ERROR)).any(1)
        hard = close | (self.uid[mine] % 2 == 1) | (have & (near % 2 == 1)).any(1)
        offsets = pa.array(np.concatenate([[0], np.cumsum(have.sum(1))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x[have])) for x in (near, sim)]
        return pa.RecordBatch.from_arrays([pa.array(self.field[mine]), pa.array(self.uid[mine]), *lists, pa.array(hard)], ["field", "uid", "near", "sim", "hard"])


def placed(field: np.ndarray, uid: np.ndarray, x: np.ndarray, state: list[bytes] | pa.Array, turn: int) -> pa.RecordBatch:
    """Rows with their key in the order of pass ``turn``: field, place, and TIE bits of the uid, so that even equal places spread over ranges."""
    key = (((field.astype(np.int64) << PLACE) + place(x, turn)) << TIE) + (uid & ((1 << TIE) - 1))
    return pa.RecordBatch.from_arrays([pa.array(field), pa.array(uid), pa.array(key), state if isinstance(state, pa.Array) else pa.array(state, pa.binary())], STATE)


class Ranges:
    """Ranges of the keys of one pass, and the borders of the rows that visit the range below or above."""

    def __init__(self, keys: np.ndarray, parts: int, share: float, numbers: np.ndarray):
        at = np.arange(1, parts) / parts

        def cut(where: np.ndarray) -> np.ndarray:
            return np.quantile(keys, np.clip(where, 0, 1), method="nearest").astype(np.int64) if parts > 1 else np.zeros(0, np.int64)

        # numbers[i] is a slot that ``repartition`` leads to a partition of its own
        self.cuts, self.low, self.high, self.numbers = cut(at), cut(at - share), cut(at + share), numbers

    def route(self, keys: pa.Array) -> pa.Array:
        """For each key a list: twice the slot of its range, and again, plus one, those of the ranges it visits as a guest because their border is near."""
        key = keys.to_numpy()
        part = np.searchsorted(self.cuts, key, side="right")
        none = np.zeros(len(key), bool)
        below = (part > 0) & (key < self.high[np.maximum(part - 1, 0)]) if len(self.cuts) else none
        above = (part < len(self.cuts)) & (key >= self.low[np.minimum(part, len(self.cuts) - 1)]) if len(self.cuts) else none
        ends = np.concatenate([[0], np.cumsum(1 + below + above)])
        spot = np.empty(ends[-1], np.int64)
        spot[ends[:-1]] = self.numbers[part] * 2
        spot[ends[:-1][below] + 1] = self.numbers[part[below] - 1] * 2 + 1
        spot[ends[1:][above] - 1] = self.numbers[part[above] + 1] * 2 + 1
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(spot))


STATE = ["field", "uid", "key", "state"]
SCHEMA = "field int, uid bigint, key bigint, state binary"
FOUND = "field int, uid bigint, near array<bigint>, sim array<float>, hard boolean"


def quantised(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """``keep`` and ``vec``: the normalised ``vector``, 16 bits a number; null where it is null, all zero, not finite or not ``size`` long."""
    types = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keep))
            out: list[bytes | None] = [None] * batch.num_rows
            ok = np.flatnonzero((np.diff(lists.offsets.to_numpy()) == size) & lists.is_valid().to_numpy(zero_copy_only=False)) if len(lists) else []
            if len(ok):
                x = lists.take(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
                top = np.abs(x).max(axis=1)
                with np.errstate(all="ignore"):
                    small = np.round(x * (32767 / top)[:, None])
                good = np.isfinite(small).all(axis=1) & (top > 0)
                for i, line in zip(ok[good], small[good].astype(np.int16), strict=True):
                    out[i] = line.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], [*keep, "vec"])

    sized = F.when(F.size("vector") == size, F.col("vector")).alias("vector")
    return rows.select(*keep, sized).mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in keep) + ", vec binary")


def blocks(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[Block]:
    """Cut a stream of batches into blocks of BLOCK rows."""
    waiting: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, BLOCK - count)
            waiting.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == BLOCK:
                yield Block(joined(waiting), size, k)
                waiting, count = [], 0
    if count:
        yield Block(joined(waiting), size, k)


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def slot_numbers(spark, parts: int) -> np.ndarray:
    """For each i below ``parts`` a number that ``repartition(parts, slot)`` leads to partition i."""
    numbers = np.full(parts, -1, np.int64)
    tried = spark.range(40 * parts + 100).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    for row in tried:
        numbers[row["p"]] = row["id"]
    numbers[numbers < 0] = 0
    return numbers


def search(vectors: DataFrame, size: int, k: int, least: float, passes: int = PASSES) -> DataFrame:
    """(field, uid, near, sim, hard): the ``k`` nearest found for each vector within its field, best first, and what is as near (``Block.found``).

    ``vectors``: (field, uid, vec), no two rows equal in vec. Every pass is
    stored and the one before deleted.
    """
    spark = vectors.sparkSession

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vec = batch.column("vec").to_pylist()
                x = np.frombuffer(b"".join(vec), np.int16).reshape(-1, size).astype(np.float32)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                yield placed(batch.column("field").to_numpy(), batch.column("uid").to_numpy(), x, vec, 0)

    def compare(turn: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[Block] = []  # blocks of the window, in order
            waiting = 0  # those at the end that have not been compared yet

            def done(block: Block) -> pa.RecordBatch:
                block.settle()
                if turn == passes:
                    return block.found(k, least)
                block.lean(held[max(0, held.index(block) - REACH) : held.index(block) + REACH + 1])
                return block.rows(turn)

            for block in blocks(batches, size, k + MARGIN):
                held.append(block)
                for other in held[-REACH - 1 :]:
                    block.meet(other, least - ERROR)
                waiting += 1
                if waiting > REACH:
                    yield done(held[-waiting])
                    waiting -= 1
                held = held[-2 * REACH - 1 :]
            for i in range(waiting, 0, -1):
                yield done(held[-i])

        return run

    at = stored(vectors.select("field", "uid", "vec").mapInArrow(begin, SCHEMA), "curve")
    total = at.count()
    parts = max(1, round(total / PART))
    numbers = slot_numbers(spark, parts)
    for turn in range(1, passes + 1):
        keys = np.zeros(0, np.int64)
        if parts > 1:  # a few keys of each range; they only say where tasks begin
            keys = at.select("key").sample(min(1.0, SAMPLED * parts / total), seed=turn).toPandas()["key"].to_numpy()
        ranges = Ranges(keys, parts, BLOCK * REACH / max(total, 1), numbers)

        spots = F.explode(F.arrow_udf(ranges.route, "array<bigint>")("key")).alias("spot")  # only the key goes to Python
        rows = at.select(*STATE, spots).repartition(parts, F.shiftright("spot", 1)).sortWithinPartitions("key", "uid")
        rows = rows.select(*STATE, (F.col("spot").bitwiseAND(1) == 1).alias("guest"))
        new = stored(rows.mapInArrow(compare(turn), FOUND if turn == passes else SCHEMA), "curve")
        dropped(at)
        at = new
    return at


class Neighbours:
    """The ``k`` most similar of each vector: ``rows`` with ids, ``pairs`` without repetition.

    ``vectors``: (field int, id string, vec binary) as from ``quantised``, one
    row per field and id. ``exact``: given a frame (field, id), the given
    vectors (field, id, vector) of these. Similarities are rounded to 6 digits,
    equal ones rank by smaller id; those below ``least`` are left out.
    The similarity itself is exact to 2e-5, or to all digits with
    ``rerank_all``; ranks at the k-th place and the threshold are exact in
    either case. Vectors that are equal but for their length count as equal.
    An empty table gives an empty result.
    """

    def __init__(
        self, vectors: DataFrame, size: int, exact: Callable[[DataFrame], DataFrame], k: int = 10, least: float = -1.0, passes: int = PASSES, rerank_all: bool = False
    ):
        self.k, self.least = k, least
        uid = F.shiftleft(F.xxhash64("field", "id"), 1).alias("uid")  # even; odd stands for a class of equal vectors
        base = stored(vectors.select("field", uid, "id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64("vec", F.lit(1)).alias("h2")), "vectors")
        self.names = stored(base.select("uid", "id"), "names")
        # classes of equal vectors: (rep, uid, id, n, field); the member that stands for the class has the smallest id
        light = base.select("field", "h1", "h2", "uid", "id")
        many = light.groupBy("field", "h1", "h2").agg(F.min_by("uid", "id").alias("rep"), F.count("*").alias("n")).filter("n > 1")
        self.copies = stored(light.join(many, ["field", "h1", "h2"]).select("rep", "uid", "id", "n", "field"), "copies")
        # the few rows to leave out are joined by broadcast or shuffle, as Spark decides by their size
        once = base.select("field", "uid", "vec").join(self.copies.select("uid", "rep"), "uid", "left").filter("rep IS NULL OR rep = uid")
        once = once.select("field", (F.col("uid") + F.col("rep").isNotNull().cast("int")).alias("uid"), "vec")
        found = search(once, size, k, least, passes)
        dropped(base)
        hard = F.lit(True) if rerank_all else F.col("hard")
        plain = found.filter(~hard).select("field", F.col("uid").alias("a"), F.posexplode(F.slice(F.arrays_zip("near", "sim"), 1, k)).alias("r", "x"))
        plain = plain.select("field", "a", (F.col("r") + 1).alias("rank"), F.col("x.near").alias("m"), F.round(F.col("x.sim").cast("double"), 6).alias("s"))
        lone, classes = self._settled(found.filter(hard), exact, rerank_all)
        #: (field, a, rank, m, s): neighbours by uid
        self.by_uid = plain.unionByName(lone).unionByName(classes)

    def _settled(self, found: DataFrame, exact: Callable[[DataFrame], DataFrame], rerank_all: bool) -> tuple[DataFrame, DataFrame]:
        """Neighbours of vectors whose lists hold equal vectors or doubtful places: of single vectors, and of members of classes."""
        k, least, copies, names = self.k, self.least, self.copies, self.names
        first = copies.select("rep", "uid", "id", "field").withColumn("i", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("i") <= k + 1)
        links = found.select("field", F.col("uid").alias("a"), F.explode(F.arrays_zip("near", "sim")).alias("x"))
        links = links.select("field", F.col("a").bitwiseAND(-2).alias("a"), F.col("x.near").bitwiseAND(-2).alias("b"), F.col("x.sim").cast("double").alias("s"))
        whole = links.join(first.select(F.col("rep").alias("b"), F.col("uid").alias("m")), "b", "left").select("field", "a", F.coalesce("m", "b").alias("m"), "s")
        whole = whole.join(names.select(F.col("uid").alias("m"), F.col("id").alias("m_id")), "m")
        own = first.select("field", F.col("rep").alias("a"), F.col("uid").alias("m"), F.col("id").alias("m_id"), F.lit(1.0).alias("s"))
        whole = whole.select("field", "a", "m", "m_id", "s").unionByName(own)
        every = Window.partitionBy("a")
        ranked = whole.withColumn("r", F.row_number().over(every.orderBy(F.round("s", 6).desc(), "m_id"))).filter(F.col("r") <= 2 * k + MARGIN)
        edges = [F.abs(F.col("s") - F.max(F.when(F.col("r") == at, F.col("s"))).over(every)) <= ERROR for at in (k, k + 1)]
        tight = (F.coalesce(edges[0], F.lit(False)) | F.coalesce(edges[1], F.lit(False))) & (F.count("*").over(every) > k)
        unsure = (F.lit(True) if rerank_all else tight | (F.abs(F.col("s") - least) <= ERROR)) & (F.col("a") != F.col("m"))
        listed = stored(ranked.select("field", "a", "m", "m_id", "s", unsure.alias("unsure")), "lists")

        # exact similarities where the order is unsure
        doubt = stored(listed.filter("unsure").join(names.select(F.col("uid").alias("a"), F.col("id").alias("a_id")), "a").select("field", "a", "a_id", "m", "m_id"), "doubt")
        given = stored(exact(doubt.select("field", F.explode(F.array("a_id", "m_id")).alias("id")).distinct()), "exact")
        pair = doubt.join(given.select("field", F.col("id").alias("a_id"), F.col("vector").alias("va")), ["field", "a_id"])
        pair = pair.join(given.select("field", F.col("id").alias("m_id"), F.col("vector").alias("vm")), ["field", "m_id"])
        sure = pair.select("a", "m", vx.cosine(F.col("va"), F.col("vm")).alias("true_s"))
        final = listed.join(sure, ["a", "m"], "left").select("field", "a", "m", "m_id", F.round(F.coalesce("true_s", "s"), 6).alias("s"))
        final = final.withColumn("r", F.row_number().over(every.orderBy(F.col("s").desc(), "m_id")))
        final = stored(final.filter((F.col("r") <= k + 1) & (F.col("s") >= least)).select("field", "a", "m", "s", "r"), "final")
        dropped(listed, doubt, given)

        # vectors without an equal have the first k; of a class each member has the first k of the list but itself
        lone = final.join(copies.filter("uid = rep").select(F.col("rep").alias("a")), "a", "left_anti").filter(F.col("r") <= k)
        lone = lone.select("field", "a", F.col("r").alias("rank"), "m", "s")
        # a class of very many members is dealt to several tasks
        deals = (F.col("n") / MEMBERS).cast("long") + 1
        member = copies.select(F.col("rep").alias("a"), "uid", F.pmod(F.xxhash64("uid"), deals).alias("deal"))
        lists = final.join(copies.filter("uid = rep").select(F.col("rep").alias("a"), deals.alias("deals")), "a")
        lists = lists.withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)))
        mine = member.join(final.select("a", F.col("m").alias("uid"), F.col("r").alias("own")), ["a", "uid"], "left")
        each = mine.join(lists, ["a", "deal"]).filter("uid <> m").withColumn("rank", F.col("r") - F.when(F.col("own") < F.col("r"), 1).otherwise(0))
        return lone, each.filter(F.col("rank") <= k).select("field", F.col("uid").alias("a"), "rank", "m", "s")

    def _named(self, rows: DataFrame, column: str, out: str) -> DataFrame:
        return rows.join(self.names.select(F.col("uid").alias(column), F.col("id").alias(out)), column)

    def rows(self) -> DataFrame:
        """(field, id, rank, neighbour_id, similarity), rank from 1."""
        out = self._named(self._named(self.by_uid.withColumn("m", F.col("m").bitwiseAND(-2)), "a", "id"), "m", "neighbour_id")
        return out.select("field", "id", "rank", "neighbour_id", F.col("s").alias("similarity"))

    def pairs(self) -> DataFrame:
        """(field, id_a, id_b): pairs of which one is among the k nearest of the other."""
        both = self.by_uid.select("field", F.least("a", "m").alias("p"), F.greatest("a", "m").alias("q")).distinct()
        out = self._named(self._named(both, "p", "x"), "q", "y")
        return out.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
