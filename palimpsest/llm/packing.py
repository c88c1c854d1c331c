"""Filling containers of fixed capacity with items of varying length.

The lengths (in tokens) are counted into a histogram of at most ``CLASSES``
length classes. Patterns, that is combinations of up to four classes that fill
a container nearly, are enumerated; non-negative least squares fits how often
each pattern is used so that together they use up the histogram. The counts
are rounded down per shard of the items, each shard takes its patterns from its
own items, and what is left over is packed into the fullest container with
room. An item longer than the capacity is cut into full pieces and a rest; the
pieces keep the item's order and the rest is packed like an item.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Length classes of the histogram; a class stands for its longest length.
CLASSES = 48
#: Pieces in a shard, about; a shard is packed by one task. More shards, not larger ones, hold more items.
SHARD = 20_000
#: A pattern is given up in a shard once the room that its container would waste exceeds this share.
SLACK = 0.002


def class_ends(capacity: int, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Upper ends of the length classes: fine where much of the length lies."""
    mass = np.cumsum(lengths * counts)
    at = np.searchsorted(mass, np.linspace(0, mass[-1], CLASSES + 1)[1:] - 1e-9)
    return np.unique(np.append(lengths[np.minimum(at, len(lengths) - 1)], lengths[-1]))


def patterns(ends: np.ndarray, capacity: int) -> np.ndarray:
    """Counts per class of each pattern: one to four kinds of classes, filled up with the first kind, 97 % full or the fullest of its kind."""
    found: dict[tuple[int, ...], int] = {}
    size = len(ends)
    sizes = ends.astype(np.int64)

    def add(parts: dict[int, int]) -> None:
        row = [0] * size
        for c, n in parts.items():
            row[c] += n
        found.setdefault(tuple(row), int(sum(sizes[c] * n for c, n in parts.items())))

    for a in range(size):
        most = int(capacity // sizes[a])
        for n in sorted({most, max(1, most // 2), 1, 2} & set(range(1, most + 1))):
            rest = capacity - n * sizes[a]
            add({a: n})
            b = int(np.searchsorted(sizes, rest, "right")) - 1  # the longest that still fits
            for second in {b, b - 1, b // 2} & set(range(size)):
                left = rest - sizes[second]
                if left < 0:
                    continue
                parts = {a: n}
                parts[second] = parts.get(second, 0) + 1
                add(parts)
                third = int(np.searchsorted(sizes, left, "right")) - 1
                if third >= 0:
                    fill = dict(parts)
                    fill[third] = fill.get(third, 0) + int(left // sizes[third])
                    add(fill)
                    last = int(np.searchsorted(sizes, left - left // sizes[third] * sizes[third], "right")) - 1
                    if last >= 0:
                        fill = dict(fill)
                        fill[last] = fill.get(last, 0) + 1
                        add(fill)
    rows = np.array(list(found), np.float64).reshape(-1, size)
    full = rows @ sizes
    good = full >= 0.97 * capacity
    for c in range(size):  # every class needs a pattern
        mine = np.flatnonzero(rows[:, c] > 0)
        if len(mine):
            good[mine[np.argmax(full[mine])]] = True
    return rows[good & (full <= capacity)]


def nnls(a: np.ndarray, b: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative x that makes |a x - b| small: accelerated projected gradient steps."""
    gram, right = a.T @ a, a.T @ b
    rate = 1 / max(np.linalg.norm(gram, 2), 1e-12)
    x = y = np.zeros(a.shape[1])
    momentum = 1.0
    for _ in range(steps):
        new = np.maximum(y - rate * (gram @ y - right), 0)
        grown = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        y = new + (momentum - 1) / grown * (new - x)
        x, momentum = new, grown
    return x


def pack_shard(length: np.ndarray, ends: np.ndarray, plans: np.ndarray, share: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number and position of each piece of one shard, given each plan's use per item."""
    n = len(length)
    container, position = np.full(n, -1), np.zeros(n, np.int64)
    stock: dict[int, list[int]] = {}
    for i in np.argsort(length, kind="stable")[::-1]:
        stock.setdefault(int(length[i]), []).append(i)
    left = np.zeros(capacity + 1, np.int64)  # items left of each length
    for size, items in stock.items():
        left[size] = len(items)
    below = np.concatenate([[-1], ends[:-1]])
    fill: list[int] = []
    count: list[int] = []
    uses = np.floor(share * n).astype(int)
    for plan in np.argsort(-uses, kind="stable"):
        # longest first; the last item is the longest that fits the room there really is
        need = [c for c in np.flatnonzero(plans[plan])[::-1] for _ in range(int(plans[plan, c]))]
        for _ in range(uses[plan]):
            room, taken = capacity, []
            for no, c in enumerate(need):
                top = room if no == len(need) - 1 else min(room, int(ends[c]))
                low = 0 if no == len(need) - 1 else int(below[c]) + 1
                there = np.flatnonzero(left[low : top + 1])
                if not len(there):
                    break
                size = low + int(there[-1])
                left[size] -= 1
                taken.append(stock[size].pop())
                room -= size
            if len(taken) < len(need) or room > capacity * SLACK:
                for i in taken:  # the stock no longer has this pattern
                    left[length[i]] += 1
                    stock[int(length[i])].append(i)
                break
            container[taken], position[taken] = len(fill), np.arange(len(taken))
            fill.append(capacity - room)
            count.append(len(taken))
    placed = container >= 0
    # the rest, longest first, each into the fullest container that has room: lists of containers by room
    rest = np.flatnonzero(~placed)
    rest = rest[np.argsort(-length[rest], kind="stable")]
    by_room: dict[int, list[int]] = {}
    for c, used in enumerate(fill):
        by_room.setdefault(capacity - used, []).append(c)
    rooms = np.zeros(capacity + 1, np.int64)
    for room, cs in by_room.items():
        rooms[room] = len(cs)
    for i in rest:
        need = int(length[i])
        fits = np.flatnonzero(rooms[need:])[:1]
        if len(fits):
            room = need + int(fits[0])
            c = by_room[room].pop()
            rooms[room] -= 1
        else:
            c, room = len(fill), capacity
            fill.append(0)
            count.append(0)
        container[i], position[i] = c, count[c]
        count[c] += 1
        fill[c] += need
        by_room.setdefault(room - need, []).append(c)
        rooms[room - need] += 1
    return container, position


def pack(items: DataFrame, capacity: int, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece_no, start, length, container, position): where each item, or each piece of a long one, goes.

    ``items``: (doc_id bigint, n_tokens bigint), doc_id unique. Null lengths
    count as 0; items of length 0 take no room and are put into a container
    like others. ``container`` is a string unique over all shards. No container
    holds more than ``capacity``. An empty table gives an empty result.

    One shuffle: pieces go to shards by hash, so shards are alike and a hot
    length does no harm. Only the histogram of lengths, at most ``capacity``
    numbers, reaches the driver.
    """
    spark = items.sparkSession
    size = F.coalesce("n_tokens", F.lit(0)).cast("long")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(size - 1, F.lit(0)), F.lit(capacity).cast("long"))
    pieces = items.select("doc_id", size.alias("size"), F.posexplode(starts).alias("piece_no", "start"))
    pieces = pieces.select("doc_id", "piece_no", "start", F.least(F.col("size") - F.col("start"), F.lit(capacity)).cast("int").alias("length"))
    seen = pieces.groupBy("length").count().orderBy("length").toPandas()
    schema = "doc_id bigint, piece_no int, start bigint, length int, container string, position int"
    if seen.empty:
        return spark.createDataFrame([], schema)
    lengths, counts = np.maximum(seen["length"].to_numpy(), 1), seen["count"].to_numpy().astype(float)
    total = counts.sum()
    ends = class_ends(capacity, lengths, counts)
    plans = patterns(ends, capacity)
    histogram = np.bincount(np.searchsorted(ends, lengths), weights=counts, minlength=len(ends)) / total
    weight = ends / capacity  # a missed long item costs more than a short one
    share = nnls((plans * weight).T, histogram * weight)
    shards = max(1, round(total / shard))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece_no"]).reset_index(drop=True)
        where, position = pack_shard(pdf["length"].to_numpy(), ends, plans, share, capacity)
        names = np.char.add(f"{key[0]}-", where.astype(str))
        return pdf.drop(columns="shard").assign(container=names, position=position.astype(np.int32))

    spread = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(shards)).cast("int"))
    return spread.groupBy("shard").applyInPandas(run, schema)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """Containers used, the fewest possible, and the share of their room that is used."""
    total = packed.agg(F.sum("length").alias("n_tokens"), F.countDistinct("container").alias("n_containers"))
    least = F.ceil(F.col("n_tokens") / capacity).alias("least_containers")
    return total.select("n_tokens", "n_containers", least, (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("fill"))
